"""Reading tables, the shared folder and small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.shared import bounded_batches, new_path, shared_dir, written

__all__ = ["WORD", "bounded_batches", "fresh", "hash_sample", "new_path", "shared_dir", "table", "written"]

#: A word, as the contracts of the queries have it: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def hash_sample(df: DataFrame, most: int, *columns: str, seed: int = 11) -> DataFrame:
    """A sample of some `most` rows of df, as distinct rows of the columns with the number of their copies: the same at every run.

    Every row is drawn with the same chance, and equal rows one by one: of c equal rows floor(c * chance) are taken, and one
    more if their hash says so. So a row that makes up nearly all of the table makes up as much of the sample. A table
    of `most` rows or fewer is taken whole; of one with rows, one copy is taken at least.
    """
    groups = df.groupBy(*columns).agg(F.count("*").alias("copies"))
    n = df.count()
    if n <= most:
        return groups
    due = F.col("copies") * F.lit(most / n)
    unit = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = (F.floor(due) + (unit < due - F.floor(due)).cast("long")).cast("long")
    return groups.withColumn("copies", taken).where("copies > 0")
