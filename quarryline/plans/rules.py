"""Queries of rules over records: events, artifacts, producers, regressions, plans, promotions, names and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import rules as R
from quarryline.plans.catalog import query
from quarryline.plans.inputs import read


@query(
    "WITH e AS (SELECT event_id AS i, CASE event_id % 4 WHEN 0 THEN 'OBSERVATION' WHEN 1 THEN 'CHANGE' WHEN 2 THEN 'OUTCOME' ELSE CASE WHEN event_id % 3 = 0 THEN 'NOTE' ELSE 'OBSERVATION' END END AS kind, event_id % 5 AS f, event_id % 7 AS p, event_id % 11 AS s, event_id % 13 = 0 AS odd FROM events) "
    "SELECT i AS event_id, CASE WHEN kind = 'NOTE' THEN 'UNKNOWN_EVENT_TYPE' WHEN kind = 'OBSERVATION' AND f = 0 THEN 'OBSERVATION_NEEDS_NAMES' WHEN kind = 'OBSERVATION' AND s = 0 THEN 'OBSERVATION_NEEDS_PASS' WHEN kind = 'CHANGE' AND f IN (1, 2) THEN 'CHANGE_NEEDS_CANDIDATE_AND_SUMMARY' "
    "WHEN kind = 'CHANGE' AND p = 0 THEN 'CHANGE_NEEDS_PARENTS' WHEN kind = 'OUTCOME' AND f = 1 THEN 'OUTCOME_NEEDS_CANDIDATE' WHEN kind = 'OUTCOME' AND p < 2 THEN 'OUTCOME_NEEDS_TWO_PARENTS' WHEN kind = 'OUTCOME' AND s = 1 THEN 'OUTCOME_NEEDS_SCORES' WHEN odd THEN 'UNKNOWN_EVIDENCE_CLASS' ELSE '' END AS error FROM e"
)
def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02: the first rule that each event breaks, with the parents and scores that an outcome needs."""
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "OBSERVATION").when(i % 4 == 1, "CHANGE").when(i % 4 == 2, "OUTCOME").when(i % 3 == 0, "NOTE").otherwise("OBSERVATION")
    parents = F.transform(F.slice(F.array(*[F.lit(x) for x in range(7)]), 1, (i % 7).cast("int")), lambda x: x.cast("string"))
    e = read(spark, sf_dir, "events").select(
        i.alias("event_id"), kind.alias("kind"), F.when(i % 5 != 0, "b").alias("benchmark_id"), F.lit("t").alias("trial_id"), F.lit("q").alias("question_id"), F.when(i % 11 != 0, True).alias("pass"), F.when(i % 5 != 1, "c").otherwise("").alias("candidate_id"),
        F.when(i % 5 == 2, " ").otherwise("s").alias("change_summary"), parents.alias("parents"), F.col("value").alias("score_before"), F.when(i % 11 != 1, F.col("value")).alias("score_after"), F.when(i % 13 == 0, "RUMOUR").otherwise("CI").alias("evidence_class"),
    )
    return e.select("event_id", R.event_error().alias("error"))


@query(
    "WITH a AS (SELECT p_brand AS family, concat('a', p_partkey) AS candidate_id, p_partkey % 4 AS level, p_partkey % 17 <> 0 AS prompt, p_size / 50.0 AS fidelity, p_partkey % 10 / 10.0 AS pass_rate, p_partkey % 12 / 20.0 AS regression_rate, p_partkey % 9 AS clean_trials, p_partkey % 3 = 0 AS deps, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 700 END AS tokens FROM part), "
    "r AS (SELECT *, concat_ws(',', CASE WHEN NOT prompt THEN 'PROMPT_REQUIRED' END, CASE WHEN fidelity < 0.3 THEN 'FIDELITY_BELOW' END, CASE WHEN pass_rate < 0.2 THEN 'PASS_RATE_BELOW' END, CASE WHEN regression_rate > 0.4 THEN 'REGRESSION_ABOVE' END, CASE WHEN clean_trials < 3 THEN 'TOO_FEW_CLEAN_TRIALS' END, CASE WHEN level = 0 AND deps THEN 'DEPENDENCIES_OF_A_PROMPT' END) AS reasons FROM a), "
    "b AS (SELECT family, arg_min(candidate_id, (level, CASE WHEN tokens > 0 THEN tokens ELSE 1000000000000 END, -fidelity, candidate_id)) AS best FROM r WHERE reasons = '' GROUP BY family) SELECT r.family, candidate_id, reasons, reasons = '' AS eligible, coalesce(candidate_id = best, false) AS selected FROM r LEFT JOIN b USING (family)"
)
def portable_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13, TK-10: every reason against an artifact, and each family's least demanding one of those without any."""
    k = F.col("p_partkey")
    level = F.element_at(F.array(*[F.lit(x) for x in R.LEVELS]), (k % 4 + 1).cast("int"))
    a = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("family"), F.concat(F.lit("a"), k.cast("string")).alias("candidate_id"), level.alias("level"), F.when(k % 17 == 0, " ").otherwise("do it").alias("prompt"), (F.col("p_size") / 50.0).alias("fidelity"), (k % 10 / 10.0).alias("pass_rate"),
        (k % 12 / 20.0).alias("regression_rate"), (k % 9).alias("clean_trials"), F.when(k % 3 == 0, F.array(F.lit("tool"))).otherwise(F.array().cast("array<string>")).alias("dependencies"), F.when(k % 5 == 0, 0).otherwise(k % 700).cast("long").alias("tokens"),
    )
    return R.portable(a, 0.3, 0.2, 0.4, 3, ["family"])


@query(
    "WITH q AS (SELECT c_custkey AS request, c_nationkey AS product, c_custkey % 3 + 1 AS k, CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 100 END AS pinned, c_custkey % 7 AS skip FROM customer), o AS (SELECT s_suppkey AS worker, s_nationkey AS product, CAST(floor(s_acctbal / 1000) AS BIGINT) AS score, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey * 3 END AS params FROM supplier), "
    "j AS (SELECT request, worker, k, row_number() OVER (PARTITION BY request ORDER BY score DESC, params <> 0, params, worker) AS place FROM q JOIN o USING (product) WHERE worker % 7 <> skip AND (pinned IS NULL OR pinned = worker)) SELECT request, worker, CAST(place AS INTEGER) AS place FROM j WHERE place <= k"
)
def producer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09, SP-55, SP-56, SP-57: who makes each request's product: up to k workers, without the excluded, or the pinned one alone."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    requests = read(spark, sf_dir, "customer").select(c.alias("request"), F.col("c_nationkey").alias("product"), (c % 3 + 1).alias("k"), F.when(c % 10 == 0, c % 100).alias("pinned"), (c % 7).alias("list"))
    own = read(spark, sf_dir, "supplier")
    offers = own.select(s.alias("worker"), F.col("s_nationkey").alias("product"), F.floor(F.col("s_acctbal") / 1000).alias("score"), F.when(s % 4 == 0, 0).otherwise(s * 3).alias("params"))
    return R.producers(requests, offers, own.select((s % 7).alias("list"), s.alias("worker")))


@query(
    "WITH c AS (SELECT c_custkey AS candidate, c_custkey % 9 = 0 AS two, c_custkey % 11 = 0 AS moved, c_custkey % 13 = 0 AS payload FROM customer), f AS (SELECT o_custkey AS candidate, bool_and(o_orderkey % 3 = 0 OR o_orderkey % 50 <> 1) AS frozen FROM orders GROUP BY 1) "
    "SELECT candidate, concat_ws(',', CASE WHEN two THEN 'ONE_PRIMARY_MUTATION' END, CASE WHEN moved THEN 'PROGRAM_SHA_PRESERVED' END, CASE WHEN payload THEN 'PAYLOAD_SHA_PRESERVED' END, CASE WHEN NOT coalesce(frozen, true) THEN 'FROZEN_TEMPORAL_SEMANTICS' END) AS failed, NOT (two OR moved OR payload OR NOT coalesce(frozen, true)) AS ok FROM c LEFT JOIN f USING (candidate)"
)
def regression_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-30: what a candidate has to leave as it was before it is tried."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    candidates = read(spark, sf_dir, "customer").select(
        k.alias("candidate"), F.when(k % 9 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("changed"), F.lit("p").alias("expected_program"), F.lit("p").alias("build_program"), F.when(k % 11 == 0, "q").otherwise("p").alias("visible_program"),
        F.when(k % 2 == 0, "z").when(k % 13 == 0, "z").otherwise("").alias("payload"), F.when(k % 13 == 0, "y").otherwise("z").alias("build_payload"),
    )
    value = F.col("o_orderpriority")
    facts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate"), o.alias("key"), value.alias("expected"), F.when(o % 50 == 1, F.lower(value)).otherwise(value).alias("actual"), (o % 3 == 0).alias("declared"))
    return R.regression_preconditions(candidates, facts)


@query(
    "WITH c AS (SELECT l_orderkey AS plan, l_linenumber AS candidate, l_suppkey % 6 AS n, l_partkey % 5 AS m, l_partkey % 4 AS expected FROM lineitem), i AS (SELECT o_orderkey AS plan, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('m', o_orderkey % 2) END AS module FROM orders), "
    "e AS (SELECT plan, candidate, CASE WHEN coalesce(module, '') = '' THEN 'NO_MUTABLE_MODULE' WHEN n < 2 THEN 'NOT_ONE_PRIMARY_MUTATION' WHEN concat('m', m) <> module THEN 'OUTSIDE_INTENT' WHEN expected = 0 THEN 'NO_EXPECTED_CHANGES' ELSE '' END AS error FROM c LEFT JOIN i USING (plan)) SELECT * FROM e WHERE error <> ''"
)
def plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-32: candidates that change other than their plan's one module."""
    li = read(spark, sf_dir, "lineitem")
    own, n = F.concat(F.lit("m"), (F.col("l_partkey") % 5).cast("string")), F.col("l_suppkey") % 6
    changed = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(own, F.lit("x"))).otherwise(F.array(own))
    candidates = li.select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("candidate"), changed.alias("changed"), (F.col("l_partkey") % 4).alias("expected_changes"))
    o = F.col("o_orderkey")
    intents = read(spark, sf_dir, "orders").select(o.alias("plan"), F.when(o % 10 == 0, "").otherwise(F.concat(F.lit("m"), (o % 2).cast("string"))).alias("module"))
    return R.plan_violations(candidates, intents)


@query(
    "WITH e AS (SELECT s_suppkey AS worker, CASE s_suppkey % 4 WHEN 0 THEN 'CANDIDATE' ELSE 'SHADOW' END AS phase, CASE WHEN s_suppkey % 7 = 0 THEN 'ECE too high' ELSE '' END AS refused, CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN s_suppkey % 6 = 1 THEN 'DEGRADED' ELSE 'ACTIVE' END END AS proposed, CASE WHEN s_suppkey % 2 = 0 THEN 'steady' ELSE '' END AS why FROM supplier), "
    "r AS (SELECT *, CASE WHEN phase <> 'SHADOW' THEN 'NOT_SHADOW' WHEN proposed IS NULL THEN 'NO_ASSESSMENT' WHEN proposed <> 'ACTIVE' THEN 'NOT_PROPOSED' WHEN refused <> '' THEN 'CALIBRATION: ' || refused ELSE '' END AS no FROM e) "
    "SELECT worker, CASE WHEN no = '' THEN 'ACTIVE' ELSE phase END AS phase, CASE WHEN no <> '' THEN no WHEN why = '' THEN 'calibration gate + assessment cleared' ELSE why END AS reason FROM r"
)
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-44: workers in SHADOW that an assessment and their calibration let become ACTIVE."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier")
    entries = s.select(k.alias("worker"), F.when(k % 4 == 0, "CANDIDATE").otherwise("SHADOW").alias("phase"), F.when(k % 7 == 0, "ECE too high").otherwise("").alias("refused"))
    assessments = s.where(k % 5 != 0).select(k.alias("worker"), F.when(k % 6 == 1, "DEGRADED").otherwise("ACTIVE").alias("proposed"), F.when(k % 2 == 0, "steady").otherwise("").alias("why"))
    return R.promotions(entries, assessments)


@query(
    r"WITH n AS (SELECT p_partkey, concat(' ', p_name, ' / ', p_brand, ':', p_type, '_', p_partkey % 3, ' ') AS name FROM part), l AS (SELECT p_partkey, lower(trim(name)) AS x, trim(name) AS y, name FROM n), b AS (SELECT *, left(trim(regexp_replace(x, '[^a-z0-9]+', '-', 'g'), '-'), 48) AS segment FROM l) "
    r"SELECT p_partkey, trim(regexp_replace(lower(name), '[^\p{L}\p{Nd}]+', '-', 'g'), '-') AS slug_id, trim(regexp_replace(x, '[^a-z0-9_-]', '-', 'g'), '-') AS run_slug, segment, segment || '-' || left(sha256(y), 12) AS model_key, translate(x, '/ _:', '----') AS sanitized FROM b"
)
def slug_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-29: the four forms in which names become parts of ids and paths."""
    name = F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_brand", F.lit(":"), "p_type", F.lit("_"), (F.col("p_partkey") % 3).cast("string"), F.lit(" "))
    return read(spark, sf_dir, "part").select("p_partkey", *R.slug_forms(name))


_STOP = ", ".join(f"'{w}'" for w in R.QUESTION_STOP)


@query(
    f"WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), '.') AS ps FROM documents), k AS (SELECT doc_id, list_filter(list_transform(ps[1:2], lambda p: list_filter(list_transform(string_split_regex(lower(p), '\\s+'), lambda w: trim(w, '.,;:!?')), lambda w: strlen(w) > 3 AND w NOT IN ({_STOP}))[1]), lambda w: w IS NOT NULL) AS ws, len(ps) > 2 AS several FROM s), "
    f"q AS (SELECT doc_id, list_concat([{', '.join(repr(q).replace(chr(34), chr(39)) for q in R.QUESTIONS)}], CASE WHEN several THEN list_transform(ws, lambda w: '¿Cómo se relaciona ''' || w || ''' con el contenido de la página %d?') ELSE [] END) AS qs FROM k) "
    "SELECT doc_id, CAST(generate_subscripts(qs, 1) - 1 AS INTEGER) AS place, replace(unnest(qs), '%d', CAST(doc_id AS VARCHAR)) AS question FROM q"
)
def page_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-27: the questions of each page, the fixed ones and those of its first sentences' keywords."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.posexplode(R.page_questions(F.col("doc_id"), F.col("text"))).alias("place", "question"))
