"""Queries that run a stream to its end over a table's file and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.plans.catalog import query
from quarryline.plans.inputs import LEDGER, LEDGER_SQL, read, select
from quarryline.sources.shared import new_path
from quarryline.streaming import appends as A
from quarryline.streaming import states as S


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stream(spark, sf_dir, "events", read(spark, sf_dir, "events").schema)


@query(f"WITH {LEDGER_SQL} SELECT event_id, kind, model_id FROM ledger")
def stream_idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-02, SRC-02: a stream appended twice; the second time adds nothing."""
    path = new_path(spark, "ledger")
    for _ in range(2):
        A.append_once(select(events(spark, sf_dir), LEDGER), path, new_path(spark, "offsets"))
    return spark.read.parquet(path).select("event_id", "kind", "model_id")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: windows of event time, over a batch read here; the same function runs on a stream with a watermark."""
    out = A.windowed(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query(f"WITH {LEDGER_SQL} SELECT count(*) AS events, count_if(kind = 'OBSERVATION')::BIGINT AS observations, count_if(kind = 'OBSERVATION' AND NOT coalesce(pass, false))::BIGINT AS failures FROM ledger")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-03: the counters as a stream keeps them, in output mode complete."""
    path = new_path(spark, "summary")
    rows = A.running_summary(select(events(spark, sf_dir), LEDGER))
    rows.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


_NEXT = "CASE WHEN pass THEN CASE phase WHEN 'CANDIDATE' THEN 'SHADOW' WHEN 'SHADOW' THEN 'ACTIVE' WHEN 'DEGRADED' THEN 'ACTIVE' ELSE phase END ELSE CASE phase WHEN 'ACTIVE' THEN 'DEGRADED' WHEN 'SHADOW' THEN 'CANDIDATE' WHEN 'DEGRADED' THEN 'RETIRED' ELSE phase END END"


@query(
    f"WITH RECURSIVE {LEDGER_SQL}, r AS MATERIALIZED (SELECT concat(model_id, '/', question_id) AS worker, pass, row_number() OVER (PARTITION BY model_id, question_id ORDER BY event_id) AS n FROM ledger WHERE pass IS NOT NULL), "
    f"s(worker, n, phase, moves) AS (SELECT DISTINCT worker, 0::BIGINT, 'CANDIDATE', 0::BIGINT FROM r UNION ALL SELECT worker, n, {_NEXT}, moves + CAST({_NEXT} <> phase AS BIGINT) FROM (SELECT s.worker, r.n, pass, phase, moves FROM s JOIN r ON r.worker = s.worker AND r.n = s.n + 1)) "
    "SELECT worker, max_by(phase, n) AS phase, max(moves) AS moves FROM s GROUP BY worker"
)
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-04, SP-45: the phase of each worker, a model on a question, moved by its successes and failures."""
    own = select(events(spark, sf_dir), LEDGER).where("pass IS NOT NULL").select(F.concat_ws("/", "model_id", "question_id").alias("worker"), "pass", F.col("event_id").alias("seq"))
    path = new_path(spark, "phases")
    S.run(S.lifecycle(own), path, new_path(spark, "offsets"))
    return S.latest(spark, path, "worker")


@query(
    r"WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, trim(regexp_replace(regexp_replace(unnest(ls), '[0-9]', '#', 'g'), '\s+', ' ', 'g')) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), "
    "k AS (SELECT doc_id, count(*) AS n_chunks, list(x ORDER BY i) FILTER (WHERE x <> '') AS ls FROM l GROUP BY doc_id) SELECT doc_id, n_chunks, coalesce(len(ls) >= 2 AND len(list_distinct(ls[-2:])) = 1, false) AS degenerate FROM k".replace("\\\\", "\\")
)
def stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-01: every document's lines as a stream of chunks, guarded against ends of one shape; two lines here, as these texts have few."""
    docs = A.stream(spark, sf_dir, "documents", read(spark, sf_dir, "documents").schema)
    chunks = docs.select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    path = new_path(spark, "guard")
    S.run(S.guarded(chunks, 2), path, new_path(spark, "offsets"))
    return S.latest(spark, path, "key").withColumnRenamed("key", "doc_id")
