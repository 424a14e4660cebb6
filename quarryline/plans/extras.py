"""Queries of the remaining derivations: normal forms, answer features, heading pairs, corpus builds, candidate templates and rule names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import grounding as G
from quarryline.operators import integrity as I
from quarryline.operators import ledger as L
from quarryline.operators import records as P
from quarryline.operators import retrieval as R
from quarryline.plans.catalog import query
from quarryline.plans.inputs import read
from quarryline.plans.retrieval import POSTINGS, blocks
from quarryline.plans.text import answered
from quarryline.sources.shared import new_path


@query(r"SELECT conv_id, turn, trim(regexp_replace(upper(replace(text, 'ß', 'SS')), '\s+', ' ', 'g')) AS spaced, trim(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^\p{L}\p{Nd}_]+', ' ', 'g')) AS tokens FROM conversations")
def upper_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-04, SF-05: the two upper-case normal forms."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.upper_spaced(F.col("text")).alias("spaced"), X.upper_tokens_text(F.col("text")).alias("tokens"))


_FW = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)
_W = "regexp_extract_all(lower(%s), '[a-záéíóúñü0-9]+')"
_COS = "list_cosine_similarity(CAST(%s AS DOUBLE[]), CAST(%s AS DOUBLE[]))"
_SHARE = "coalesce(len(list_intersect(list_distinct(list_filter(%s, lambda w: w NOT IN ({0}))), %s)) / nullif(len(list_distinct(list_filter(%s, lambda w: w NOT IN ({0})))), 0), 0)".replace("{0}", _FW)


@query(
    f"WITH p AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations), "
    f"c AS (SELECT p.conv_id, p.turn, trim(answer) AS a, trim(question) AS q, trim(d.text) AS g, v1.embedding AS qv, v2.embedding AS av, v3.embedding AS gv, v4.embedding AS hv FROM p JOIN documents d ON doc_id = conv_id JOIN embeddings v1 ON v1.vec_id = (conv_id * 7 + turn) % 500 JOIN embeddings v2 ON v2.vec_id = (conv_id * 11 + turn) % 500 JOIN embeddings v3 ON v3.vec_id = conv_id % 500 JOIN embeddings v4 ON v4.vec_id = (conv_id + 1) % 500 WHERE question IS NOT NULL), "
    f"t AS (SELECT *, {_W % 'a'} AS x, {_W % 'q'} AS y, {_W % 'g'} AS z, greatest({_COS % ('av', 'gv')}, {_COS % ('av', 'hv')}) AS s1, greatest({_COS % ('qv', 'gv')}, {_COS % ('qv', 'hv')}) AS s2 FROM c), "
    "u AS (SELECT *, list_transform(range(1, greatest(len(x) - 1, 1)), lambda i: array_to_string(x[i : i + 2], ' ')) AS x3, list_transform(range(1, greatest(len(z) - 1, 1)), lambda i: array_to_string(z[i : i + 2], ' ')) AS z3 FROM t) "
    f"SELECT conv_id, turn, round({_COS % ('av', 'gv')}, 5) AS cos_answer_passage, round({_COS % ('qv', 'gv')}, 5) AS cos_question_passage, round({_COS % ('qv', 'av')}, 5) AS cos_question_answer, round((s1 + s2) / 2, 5) AS support_mean, round(least(s1, s2), 5) AS support_min, round(greatest(s1, s2), 5) AS support_max, "
    f"round({_SHARE % ('x', 'z', 'x')}, 6) AS answer_in_passage, round({_SHARE % ('y', 'x', 'y')}, 6) AS question_in_answer, round(coalesce(len(list_filter(x3, lambda w: list_contains(z3, w))) / nullif(len(x3), 0), 0), 6) AS verbatim_triples, "
    f"round(least(2.0, length(a) / greatest(length(g), 1)), 6) AS length_ratio, round(coalesce(len(list_distinct(x)) / nullif(len(x), 0), 0), 6) AS type_token, round(coalesce(len(list_filter(x, lambda w: w IN ({_FW}))) / nullif(len(x), 0), 0), 6) AS function_words FROM u"
)
def answer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-31: the twelve features of every turn as an answer to the one before, over a document; vectors of the embeddings stand for those of the texts."""
    # the vectors that the rows ask for are those of 500 ids, so they are sent to the rows; whole texts are dealt out once, and meet no other shuffle
    e = F.broadcast(read(spark, sf_dir, "embeddings").where("vec_id > -500 AND vec_id < 500").select("vec_id", "embedding"))
    k, t = F.col("conv_id"), F.col("turn")
    p = answered(spark, sf_dir).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("passage")), "conv_id")
    for name, at in (("qv", (k * 7 + t) % 500), ("av", (k * 11 + t) % 500), ("gv", k % 500), ("hv", (k + 1) % 500)):
        p = p.withColumn(f"{name}_at", at).join(e.select(F.col("vec_id").alias(f"{name}_at"), F.col("embedding").alias(name)), f"{name}_at")
    own = G.answer_features(F.trim("content"), F.trim("answer"), F.trim("passage"), F.col("qv"), F.col("av"), F.col("gv"), F.array("av", "qv"), F.array("gv", "hv"))
    return p.select("conv_id", "turn", *own)


@query("WITH h AS (SELECT o_custkey AS doc, o_orderkey AS place, o_orderpriority AS heading FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT doc, heading AS a, lead(heading) OVER (PARTITION BY doc ORDER BY place) AS b FROM h) SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY a, b")
def heading_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-03: headings that follow each other, across page ends."""
    h = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("a"))
    n = h.withColumn("b", F.lead("a").over(Window.partitionBy("doc").orderBy("place")))
    return n.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS} SELECT 'blocks' AS part, count(*) AS n FROM documents UNION ALL SELECT 'objects', count(DISTINCT text) FROM documents UNION ALL SELECT 'postings', count(*) FROM postings UNION ALL SELECT 'terms', count(DISTINCT term) FROM postings")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SRC-11, SRC-12: a corpus written as tables of blocks, objects and postings, and opened again."""
    root = new_path(spark, "corpus")
    own = blocks(spark, sf_dir)
    R.with_cost(own).write.parquet(f"{root}/blocks")
    own.select(F.sha2("text", 256).alias("cid"), "text").dropDuplicates(["cid"]).withColumn("fan", F.substring("cid", 1, 1)).write.partitionBy("fan").parquet(f"{root}/objects")
    R.postings(own).write.parquet(f"{root}/postings")
    post = spark.read.parquet(f"{root}/postings")
    parts = [("blocks", spark.read.parquet(f"{root}/blocks")), ("objects", spark.read.parquet(f"{root}/objects")), ("postings", post), ("terms", post.select("term").distinct())]
    out = None
    for name, table in parts:
        row = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionAll(row)
    return out


_KINDS = ", ".join(f"('{t}', '{k}', {i + 1})" for t, ks in L.TARGET_KINDS.items() for i, k in enumerate(ks.split()))


@query(f"WITH k(target, mutation, place) AS (VALUES {_KINDS}) SELECT n_nationkey AS intent, sha256(concat_ws(chr(1), concat('v', target), concat('v', mutation))) AS candidate_id, mutation, CAST(place AS INTEGER) AS place FROM nation JOIN k ON target = CASE n_nationkey % 3 WHEN 0 THEN 'T2_NAVIGATION' WHEN 1 THEN 'BOOT' ELSE 'TEMPORAL_PROGRAM' END WHERE place <= 3")
def synthesised_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-23, SP-29, SP-17: candidates made from templates, up to an intent's budget."""
    k = F.col("n_nationkey")
    t = F.when(k % 3 == 0, "T2_NAVIGATION").when(k % 3 == 1, "BOOT").otherwise("TEMPORAL_PROGRAM")
    j = read(spark, sf_dir, "nation").select(k.alias("intent"), t.alias("target")).join(F.broadcast(L.kind_table(spark)), "target").where("place <= 3")
    return j.select("intent", I.content_id(["target", "mutation"]).alias("candidate_id"), "mutation", "place")


@query("SELECT o_orderkey AS build, CASE WHEN o_orderkey % 23 = 0 THEN 'SCHEMA' WHEN o_orderkey % 17 = 0 THEN 'CANDIDATE' WHEN o_orderkey % 5 = 0 THEN 'PROGRAM' WHEN o_totalprice < 20000 THEN 'PAYLOAD' WHEN o_orderkey % 7 = 0 THEN 'ARTIFACT' ELSE 'VALID' END AS state FROM orders")
def build_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-26: a build's provenance against its candidate, by the first rule it breaks."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(
        k.alias("build"), F.when(k % 23 == 0, "old").otherwise("build-1").alias("schema"), F.when(k % 17 != 0, "c1").alias("candidate_id"), F.lit("c1").alias("wanted_candidate_id"), F.when(k % 5 == 0, "x").otherwise("p").alias("program"),
        F.lit("p").alias("wanted_program"), F.when(F.col("o_totalprice") >= 20000, "d").alias("payload"), F.lit("d").alias("wanted_payload"), F.lit("a").alias("artifact"), F.when(k % 7 != 0, 10).otherwise(0).alias("artifact_bytes"),
    )
    return o.select("build", P.build_state("build-1").alias("state"))


@query("WITH f AS (SELECT concat('rule.r', c_custkey % 40, '.', CASE c_custkey % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'from' ELSE 'requires' END) AS key, concat('cell', c_custkey % 5, '=ON') AS value FROM customer) SELECT regexp_extract(key, '^rule[.]([^.]+)[.]', 1) AS rule, string_agg(DISTINCT replace(replace(value, 'cell', 'C'), '=', ' is '), ';' ORDER BY replace(replace(value, 'cell', 'C'), '=', ' is ')) AS visible FROM f GROUP BY 1")
def visible_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-27, SP-28, FLT-31: rule names of dotted keys, and their conditions in visible names."""
    k = F.col("c_custkey")
    facts = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("rule.r"), (k % 40).cast("string"), F.lit("."), F.when(k % 3 == 0, "target").when(k % 3 == 1, "from").otherwise("requires")).alias("key"), F.concat(F.lit("cell"), (k % 5).cast("string"), F.lit("=ON")).alias("value")
    )
    names = F.create_map(*[F.lit(x) for i in range(5) for x in (f"cell{i}", f"C{i}")])
    return facts.groupBy(P.rule_of(F.col("key")).alias("rule")).agg(F.array_join(F.array_sort(F.collect_set(P.visible_requires(F.col("value"), names))), ";").alias("visible"))


@query("SELECT n_nationkey AS base, CAST(s AS INTEGER) AS stage, concat(n_name, '/', s) AS case_id FROM nation, range(0, 6) t(s) WHERE s <= n_nationkey % 6")
def curriculum_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-46, UD-06: the cases of each stage up to a limit, one row made into many."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("base"), "n_name", F.explode(F.sequence(F.lit(0), F.col("n_nationkey") % 6)).alias("stage"))
    return n.select("base", "stage", F.concat_ws("/", "n_name", F.col("stage").cast("string")).alias("case_id"))
