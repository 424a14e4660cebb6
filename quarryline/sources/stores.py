"""Readers and writers of ledgers, campaigns, corpora, run records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.integrity import content_id, new_rows
from quarryline.operators.ledger import error_code, model_class
from quarryline.sources import schemas


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Event files, one record each or many: a malformed file fails the read, so does a stored id that isn't the record's content id."""
    rows = spark.read.schema(schemas.LEDGER_EVENT).option("mode", "FAILFAST").json(path)
    own = content_id([c for c in rows.columns if c not in ("event_id", "ts", "schema", "parent_event_ids", "tags")])
    good = (F.col("event_id").isNull()) | (F.col("event_id") == own)
    return rows.withColumn("event_id", F.when(good, own).otherwise(F.raise_error(F.lit("an event's id isn't its content id"))))


def valid_events(events: DataFrame) -> DataFrame:
    return error_code(events).where("error IS NULL").drop("error")


def append_ledger(events: DataFrame, path: str) -> int:
    """Adds the events that aren't stored yet and returns how many; a repeated append adds none."""
    spark = events.sparkSession
    try:
        stored = spark.read.parquet(path).select("event_id")
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = events.select("event_id").limit(0)
    added = new_rows(stored, events).persist()
    n = added.count()
    if n:
        added.write.mode("append").parquet(path)
    added.unpersist()
    return n


def read_campaign(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Trials, and responses with their place, of nested campaign documents: a file each, or a line each."""
    doc = spark.read.schema(schemas.CAMPAIGN).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    trials = doc.select("benchmark_id", F.explode("trials").alias("t")).select("benchmark_id", F.col("t.id").alias("trial"), "t.model_id", "t.condition", F.coalesce("t.diagnostic_mode", F.lit(False)).alias("diagnostic"), F.col("t.specimen.id").alias("specimen_id"), F.col("t.specimen.sha256").alias("specimen_sha"), "t.responses")
    responses = trials.select("trial", F.posexplode("responses").alias("pos", "r")).select("trial", F.col("r.question_id").alias("question"), F.col("r.text").alias("answer"), F.col("pos").cast("long").alias("pos"))
    return trials.drop("responses"), responses


def write_results(results: DataFrame, trials: DataFrame, path: str) -> None:
    """Result documents: of each trial of a campaign its fields and its results (question, layer, pass), one JSON line each; a path that exists is an error."""
    own = F.array_sort(F.collect_list(F.struct("question", "layer", "pass")))
    rows = trials.join(results.groupBy("trial").agg(own.alias("results")), "trial", "left")
    rows.withColumn("results", F.coalesce("results", F.array().cast(rows.schema["results"].dataType))).write.mode("errorifexists").json(path)


def observations(results: DataFrame, trials: DataFrame, synthetic: bool = False) -> DataFrame:
    """One observation for each (trial, question) result; placeholder models are left out, synthetic ones unless asked for."""
    kind = model_class(F.col("model_id"))
    own = trials.withColumn("evidence_class", F.when(kind == "REAL", "REAL_MODEL").otherwise(kind)).where(F.col("evidence_class").isin("REAL_MODEL", *(["SYNTHETIC"] if synthetic else [])))
    rows = results.join(own, "trial").select(F.lit("OBSERVATION").alias("kind"), "evidence_class", "model_id", "condition", "specimen_id", F.col("question").alias("question_id"), "layer", "pass")
    return rows.withColumn("event_id", content_id(rows.columns))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GROUNDING_CASE).option("mode", "FAILFAST").json(path)


def read_workers(spark: SparkSession, path: str) -> DataFrame:
    """A worker manifest with its defaults: trimmed names, no parameters, sorted contracts."""
    w = spark.read.schema(schemas.WORKER).option("mode", "FAILFAST").json(path)
    names = {c: F.trim(F.coalesce(c, F.lit(d))) for c, d in (("worker_id", ""), ("capability", ""), ("scope", "ANY"), ("domain", "GENERAL"), ("engine", "MODEL"))}
    lists = {c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in ("requires", "produces")}
    return w.withColumns(names | lists | {"params": F.coalesce("params", F.lit(0))}).where("worker_id <> ''")


def write_report_csv(rows: DataFrame, path: str) -> None:
    """A CSV report: doubles with six digits, a header, null as nothing."""
    cols = [F.format_string("%.6f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*[F.when(F.col(n).isNotNull(), c).alias(n) for n, c in zip(rows.columns, cols, strict=True)]).write.option("header", True).mode("errorifexists").csv(path)


def append_runs(records: DataFrame, path: str) -> None:
    """Run records by month of their observation; a run that is stored already fails the append."""
    spark = records.sparkSession
    named = records.withColumn("month", F.date_format("observed_at", "yyyy-MM"))
    try:
        if not named.join(spark.read.parquet(path).select("run_id"), "run_id", "left_semi").isEmpty():
            raise ValueError("a run of this id is stored already")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    named.write.partitionBy("month").mode("append").parquet(path)


def run_id(observed_at: str, env: str) -> Column:
    """The time of observation and the beginning of the environment's hash."""
    return F.concat_ws("-", F.date_format(observed_at, "yyyyMMdd'T'HHmmss"), F.substring(env, 1, 8))


def write_objects(objects: DataFrame, path: str) -> None:
    """Contents by their ids, fanned out by the first two digits; equal contents once, unequal ones of one id are an error."""
    clash = objects.groupBy("cid").agg(F.count_distinct("data").alias("n")).where("n > 1")
    if not clash.isEmpty():
        raise ValueError("different contents have one id")
    objects.dropDuplicates(["cid"]).withColumn("fan", F.substring("cid", 1, 2)).write.partitionBy("fan").mode("errorifexists").parquet(path)


def read_object(spark: SparkSession, path: str, cid: str) -> DataFrame:
    """One content by its id, from its fan-out folder only, checked against the id."""
    row = spark.read.parquet(path).where((F.col("fan") == cid[:2]) & (F.col("cid") == cid))
    return row.withColumn("data", F.when(F.sha2("data", 256) == F.col("cid"), F.col("data")).otherwise(F.raise_error(F.lit("the content isn't what its id says"))))


def append_external(observations: DataFrame, path: str) -> None:
    """External observations, by model family and key."""
    observations.write.partitionBy("family", "model_key").mode("append").parquet(path)


def dump_pages(pages: DataFrame, path: str, stride: int, limit: int) -> None:
    """Every stride-th page as JSON lines, limit of them at most: both are the dump's own parameters."""
    pages.where(F.pmod(F.col("page_id") - 1, F.lit(stride)) == 0).orderBy("page_id").limit(limit).write.mode("errorifexists").json(path)
