"""Queries that write a table in the form of a source and read it back by the source's reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.plans.catalog import query
from quarryline.plans.inputs import read
from quarryline.sources import stores as S
from quarryline.sources.shared import new_path

_MODEL = "concat('m', conv_id % 7)"


def _campaign(spark: SparkSession, sf_dir: str) -> str:
    """A campaign document for each dialogue of a model: its turns are the responses of a trial."""
    c = read(spark, sf_dir, "conversations")
    answers = F.array_sort(F.collect_list(F.struct("turn", "text")))
    t = c.groupBy("conv_id").agg(F.transform(answers, lambda a: F.struct(F.concat(F.lit("Q"), (a["turn"] % 9).cast("string")).alias("question_id"), a["text"].alias("text"), a["turn"].alias("latency_ms"))).alias("responses"))
    trial = F.struct(
        F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("id"), F.expr(_MODEL).alias("model_id"), F.lit("NATIVE").alias("condition"), F.when(F.col("conv_id") % 3 == 0, True).alias("diagnostic_mode"),
        F.struct(F.lit("s1").alias("id"), F.lit("ab").alias("sha256")).alias("specimen"), "responses",
    )
    path = new_path(spark, "campaign")
    t.select(F.lit("r0").alias("schema"), F.lit("b1").alias("benchmark_id"), F.array(trial).alias("trials")).write.json(path)
    return path


@query(f"SELECT concat('t', conv_id) AS trial, {_MODEL} AS model_id, conv_id % 3 = 0 AS diagnostic, concat('Q', turn % 9) AS question, text AS answer FROM conversations")
def campaign_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: campaigns read from nested documents, as trials with their responses."""
    trials, responses = S.read_campaign(spark, _campaign(spark, sf_dir), lines=True)
    return trials.select("trial", "model_id", "diagnostic").join(responses, "trial").select("trial", "model_id", "diagnostic", "question", "answer")


@query(f"SELECT concat('t', conv_id) AS trial, {_MODEL} AS model_id, count(*) AS results, count_if(length(text) > 200)::BIGINT AS passed FROM conversations GROUP BY ALL")
def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: results written as one document a trial, and read again."""
    trials, responses = S.read_campaign(spark, _campaign(spark, sf_dir), lines=True)
    path = new_path(spark, "results")
    S.write_results(responses.select("trial", "question", F.lit("P").alias("layer"), (F.length("answer") > 200).alias("pass")), trials, path)
    back = spark.read.schema("trial string, model_id string, results array<struct<question: string, layer: string, pass: boolean>>").json(path)
    return back.select("trial", "model_id", F.size("results").cast("long").alias("results"), F.size(F.filter("results", lambda r: r["pass"])).cast("long").alias("passed"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text AS evidence, lang AS family, length(text) AS chars FROM documents")
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: a corpus scanned from JSON lines, texts whole."""
    path = new_path(spark, "lines")
    read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("evidence"), F.col("lang").alias("family")).write.json(path)
    return S.read_corpus(spark, path).select("id", "evidence", "family", F.length("evidence").cast("long").alias("chars"))


@query("SELECT o_orderkey AS k, printf('%.6f', o_totalprice / 7) AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: a CSV report with doubles of six digits, null as nothing."""
    path = new_path(spark, "report")
    k = F.col("o_orderkey")
    S.write_report_csv(read(spark, sf_dir, "orders").select(k.alias("k"), (F.col("o_totalprice") / 7).alias("price"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("priority")), path)
    return spark.read.option("header", True).schema("k long, price string, priority string").csv(path)


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'DEEPSEEK' WHEN 1 THEN 'QWEN' ELSE 'UNKNOWN' END AS family, concat('k', c_nationkey) AS model_key, 2 * count(*) AS n FROM customer GROUP BY ALL")
def external_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18: observations from outside appended by model family and key, twice."""
    path = new_path(spark, "external")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "deepseek-vl").when(k % 3 == 1, "Qwen2").otherwise("other")
    rows = read(spark, sf_dir, "customer").select("c_custkey", X.model_family(name).alias("family"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("model_key"))
    for _ in range(2):
        S.append_external(rows, path)
    return spark.read.parquet(path).groupBy("family", "model_key").agg(F.count("*").alias("n"))


@query("SELECT s_name AS worker_id, CASE WHEN s_suppkey % 2 = 0 THEN 'ANSWER' ELSE '' END AS capability, CASE WHEN s_suppkey % 3 = 0 THEN 'PAGE' ELSE 'ANY' END AS scope, 'GENERAL' AS domain, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey ELSE 0 END AS params, CASE WHEN s_suppkey % 4 = 0 THEN 'A,B' ELSE '' END AS requires FROM supplier WHERE s_suppkey % 7 <> 3")
def worker_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20, SP-60: workers read from a manifest, with defaults, trimmed names and sorted contracts; one without a name is none."""
    k = F.col("s_suppkey")
    path = new_path(spark, "workers")
    read(spark, sf_dir, "supplier").select(
        F.when(k % 7 == 3, "  ").otherwise(F.concat(F.lit(" "), "s_name")).alias("worker_id"), F.when(k % 2 == 0, "ANSWER ").alias("capability"), F.when(k % 3 == 0, " PAGE").alias("scope"), F.when(k % 5 == 0, k).alias("params"),
        F.when(k % 4 == 0, F.array(F.lit("B"), F.lit("A"), F.lit("B"))).alias("requires"),
    ).write.json(path)
    return S.read_workers(spark, path).select("worker_id", "capability", "scope", "domain", "params", F.array_join("requires", ",").alias("requires"))
