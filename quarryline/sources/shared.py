"""The folder that driver and executors share, tables written to it, and the size of what goes to Python."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset a local session gets a temporary folder of its own; any other
    session has to name one, as a machine's own folder isn't seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="quarryline-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later reads don't depend on any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *key: str) -> DataFrame:
    """df as a table in the shared folder, dealt out by key once: joins by key read it in place, without a shuffle of it."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, *key).write.option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(n, *key).saveAsTable(table)
    return spark.table(table)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to some megabytes, so that a worker's memory doesn't follow the texts' lengths."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = re.match(r"[0-9]+", conf.get(key) or "")
        if not now or int(now[0]) > most:
            conf.set(key, str(most))
    return df
