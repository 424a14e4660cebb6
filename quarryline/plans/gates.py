"""Queries of the gate family, over parts, suppliers, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators import gates as G
from quarryline.operators import ledger as L
from quarryline.operators.joins import one_to_one
from quarryline.plans.catalog import query
from quarryline.plans.inputs import LEDGER_SQL, ledger, read, select
from quarryline.sources.shared import written

BASE = {"units": 40.0, "bytes": 1000.0, "recognition_ms": 300.0, "bootstrap_steps": 4.0, "decode_steps": 6.0}
POLICY = {"roundtrip": 0.2, "index_rate": 0.3, "answer_rate": 0.1, "evidence": 0.2, "routing": 0.1, "bytes": 1900.0, "trials": 3.0}

#: Candidates with their metrics: parts read as candidates.
METRICS = {
    "candidate_id": "concat('c', lpad(CAST(p_partkey AS string), 9, '0'))", "roundtrip": "p_partkey % 10 / CAST(9 AS DOUBLE)", "boot": "p_partkey % 7 / CAST(6 AS DOUBLE)", "index_rate": "p_partkey % 9 / CAST(8 AS DOUBLE)", "answer_rate": "p_size / CAST(50 AS DOUBLE)",
    "routing": "p_partkey % 11 / CAST(10 AS DOUBLE)", "evidence": "p_partkey % 5 / CAST(4 AS DOUBLE)", "transport": "p_size % 4 / CAST(3 AS DOUBLE)", "context": "p_size % 6 / CAST(5 AS DOUBLE)", "units": "CAST(p_size AS DOUBLE)", "bytes": "p_retailprice",
    "recognition_ms": "CAST(p_partkey % 900 AS DOUBLE)", "bootstrap_steps": "CAST(p_size % 9 AS DOUBLE)", "decode_steps": "CAST(p_size % 12 AS DOUBLE)", "trials": "p_partkey % 8", "false_exact": "CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END",
    "contaminated": "p_partkey % 31 = 0", "peak_tokens": "p_partkey % 5000", "tool_cost": "p_size / CAST(10 AS DOUBLE)",
}
_METRICS = "m AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in METRICS.items()).replace(" AS string)", " AS VARCHAR)") + " FROM part)"
_CLAMP = lambda c: f"least(greatest({c}, 0.0), 1.0)"
_SCORE = (
    " + ".join(f"{w} * {_CLAMP(n)}" for n, w in G.SCORE_RATES.items())
    + f" + {G.SCORE_DENSITY} * CASE WHEN units > 0 AND bytes > 0 THEN (units / bytes) / (units / bytes + {BASE['units'] / BASE['bytes']}) ELSE 0.5 END"
    + "".join(f" + {w} * CASE WHEN {n} > 0 THEN {BASE[n]} / ({n} + {BASE[n]}) ELSE 0.5 END" for n, w in G.SCORE_LOWER.items())
)
_GATES = [("SEMANTIC_ROUNDTRIP", "roundtrip >= 0.2"), ("NATIVE_INDEX", "index_rate >= 0.3"), ("NATIVE_ANSWER", "answer_rate >= 0.1"), ("VERIFIED_EVIDENCE", "evidence >= 0.2"), ("ROUTING", "routing >= 0.1"), ("CARRIER_SIZE", "bytes > 0 AND bytes <= 1900"), ("TRIALS", "trials >= 3"), ("FALSE_EXACT_ZERO", "false_exact = 0")]
_FAILED = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({r}) THEN '{n}' END" for n, r in _GATES) + ")"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(read(spark, sf_dir, "part"), METRICS)


@query(f"WITH {_METRICS}, s AS (SELECT candidate_id, round(CAST({_SCORE} AS DOUBLE), 6) AS score, {_FAILED} AS failed FROM m) SELECT candidate_id, score, failed, failed = '' AS eligible, CAST(row_number() OVER (ORDER BY failed = '' DESC, score DESC, candidate_id) AS INTEGER) AS place FROM s")
def weighted_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-34, SF-35, FLT-12, TK-07, JN-05: gated candidates ranked by a weighted score."""
    own = metrics(spark, sf_dir)
    return G.tournament(one_to_one(own.select("candidate_id"), own, ["candidate_id"], "candidate", "evidence"), BASE, POLICY)


_FIT = {"bootstrap": "boot", "rosetta": "roundtrip", "navigation": "routing", "correctness": "answer_rate", "evidence": "evidence", "unknown": "index_rate"}
_TOTAL = " + ".join(f"{w} * {_FIT[n]}" for n, w in G.FITNESS.items())


@query(f"WITH {_METRICS}, r AS (SELECT *, CASE WHEN contaminated THEN 'CONTAMINATED' WHEN false_exact <> 0 THEN 'FALSE_EXACT' WHEN peak_tokens > 4096 THEN 'BUDGET' END AS reason FROM m) SELECT candidate_id, coalesce(reason, '') AS reason, round(CAST(CASE WHEN reason IS NULL THEN {_TOTAL} - 0.001 * tool_cost ELSE 0 END AS DOUBLE), 6) AS score FROM r")
def receiver_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-36, TK-08, SP-32: receivers with their hard gates."""
    own = metrics(spark, sf_dir).select("candidate_id", "contaminated", "false_exact", "peak_tokens", "tool_cost", *[F.col(c).alias(n) for n, c in _FIT.items()])
    score, reason = G.fitness(4096)
    return own.select("candidate_id", F.coalesce(reason, F.lit("")).alias("reason"), F.round(score, 6).alias("score"))


@query(f"WITH {_METRICS}, r AS (SELECT candidate_id, CASE WHEN trials % 4 = 0 THEN 'PROMPT' WHEN trials % 4 = 1 THEN 'HYBRID' WHEN trials % 4 = 2 THEN 'ADAPTER' ELSE 'MODEL' END AS level, CASE WHEN peak_tokens % 3 = 0 THEN 0 ELSE peak_tokens END AS tokens, answer_rate AS fidelity FROM m) SELECT level, candidate_id, tokens FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY coalesce(nullif(tokens, 0), 1000000000), fidelity DESC, candidate_id) AS n FROM r) WHERE n = 1")
def portable_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13, TK-10, SP-31: of each level the least demanding artifact; unknown token counts come last."""
    t = F.col("trials") % 4
    level = F.when(t == 0, "PROMPT").when(t == 1, "HYBRID").when(t == 2, "ADAPTER").otherwise("MODEL")
    r = metrics(spark, sf_dir).select("candidate_id", level.alias("level"), F.when(F.col("peak_tokens") % 3 == 0, 0).otherwise(F.col("peak_tokens")).alias("tokens"), F.col("answer_rate").alias("fidelity"))
    n = F.row_number().over(Window.partitionBy("level").orderBy(F.coalesce(F.nullif("tokens", F.lit(0)), F.lit(1_000_000_000)), F.desc("fidelity"), "candidate_id"))
    return r.withColumn("n", n).where("n = 1").select("level", "candidate_id", "tokens")


_WORKERS = "w AS (SELECT s_suppkey AS worker_id, CASE WHEN s_suppkey % 2 = 0 THEN 'ANSWER' ELSE 'ROUTE' END AS capability, CASE s_suppkey % 3 WHEN 0 THEN 'PAGE' WHEN 1 THEN 'ANY' ELSE 'DOC' END AS scope, CASE WHEN s_nationkey % 2 = 0 THEN 'GENERAL' ELSE 'LEGAL' END AS domain, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey * 3 END AS params, CASE WHEN s_suppkey % 4 = 0 THEN 'RULES' ELSE 'MODEL' END AS engine FROM supplier)"


@query(f"WITH {_WORKERS}, e AS (SELECT *, 100 * CAST(scope = 'PAGE' AS INT) + 50 * CAST(domain = 'LEGAL' AS INT) + 25 * CAST(params = 0 AS INT) + 10 * CAST(engine = 'RULES' AS INT) AS score FROM w WHERE capability = 'ANSWER' AND params <= 200 AND scope IN ('PAGE', 'ANY') AND domain IN ('LEGAL', 'GENERAL')) SELECT worker_id, score, params, CAST(row_number() OVER (ORDER BY score DESC, params <> 0, params, worker_id) AS INTEGER) AS place FROM e")
def worker_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08, FLT-09, TK-09, SP-54 to SP-57, UD-03: eligible workers, best first."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    w = s.select(
        k.alias("worker_id"), F.when(k % 2 == 0, "ANSWER").otherwise("ROUTE").alias("capability"), F.when(k % 3 == 0, "PAGE").when(k % 3 == 1, "ANY").otherwise("DOC").alias("scope"),
        F.when(F.col("s_nationkey") % 2 == 0, "GENERAL").otherwise("LEGAL").alias("domain"), F.when(k % 5 == 0, 0).otherwise(k * 3).alias("params"), F.when(k % 4 == 0, "RULES").otherwise("MODEL").alias("engine"),
    )
    return G.worker_rank(w, "ANSWER", "PAGE", "LEGAL", 200)


_FACTS = "e AS (SELECT concat('f', c_custkey) AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 7 <> 0), a AS (SELECT concat('f', c_custkey) AS key, CASE WHEN c_custkey % 5 = 0 THEN upper(substr(c_mktsegment, 1, 3)) ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 11 <> 0), d AS (SELECT concat('f', c_custkey) AS key, CASE WHEN c_custkey % 2 = 0 THEN upper(substr(c_mktsegment, 1, 3)) ELSE '' END AS value FROM customer WHERE c_custkey % 10 < 2)"


@query(f"WITH {_FACTS}, j AS (SELECT coalesce(e.key, a.key, d.key) AS key, coalesce(e.value, '') AS e, coalesce(a.value, '') AS a, coalesce(d.value, '') AS d, d.key IS NOT NULL AS dd FROM e FULL JOIN a ON e.key = a.key FULL JOIN d ON d.key = coalesce(e.key, a.key)) SELECT key, e AS expected, a AS actual, CASE WHEN e = a THEN CASE WHEN dd THEN 'DECLARED_UNCHANGED' ELSE 'SAME' END WHEN dd AND d = a THEN 'DECLARED' ELSE 'DRIFT' END AS state FROM j")
def fact_parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15, ST-05, FLT-30, FLT-31: expected, actual and declared facts side by side."""
    c = read(spark, sf_dir, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    key = F.concat(F.lit("f"), k.cast("string")).alias("key")
    cut = F.upper(F.substring(seg, 1, 3))
    return G.parity(
        c.where(k % 7 != 0).select(key, seg.alias("value")), c.where(k % 11 != 0).select(key, F.when(k % 5 == 0, cut).otherwise(seg).alias("value")),
        c.where(k % 10 < 2).select(key, F.when(k % 2 == 0, cut).otherwise("").alias("value")),
    )


@query("WITH r AS (SELECT DISTINCT c_nationkey AS model FROM customer), t AS (SELECT c_nationkey AS model, o_totalprice > 150000 AS pass FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_nationkey % 5 <> 0), g AS (SELECT model, count_if(pass) AS passes, count(*) AS runs FROM t GROUP BY model) SELECT CAST(r.model AS INTEGER) AS model, CAST(coalesce(passes, 0) AS BIGINT) AS passes, CAST(coalesce(runs, 0) AS BIGINT) AS runs, coalesce(passes, 0) * 2 > coalesce(runs, 0) AS ok FROM r LEFT JOIN g ON r.model = g.model")
def panel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16, AG-38: a required panel, whose members without trials fail."""
    c = read(spark, sf_dir, "customer")
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(c.where("c_nationkey % 5 <> 0"), F.col("o_custkey") == F.col("c_custkey"))
    return G.panel(c.select(F.col("c_nationkey").alias("model")), o.select(F.col("c_nationkey").alias("model"), (F.col("o_totalprice") > 150000).alias("pass")))


@query(f"WITH {LEDGER_SQL}, b AS (SELECT case_key, bool_and(pass) AS p FROM ledger WHERE run_id = 'r0' AND pass IS NOT NULL GROUP BY 1), a AS (SELECT case_key, bool_and(pass) AS p FROM ledger WHERE run_id = 'r1' AND pass IS NOT NULL GROUP BY 1), j AS (SELECT b.case_key, b.p AS before, coalesce(a.p, false) AS after FROM b LEFT JOIN a USING (case_key)) SELECT CASE WHEN before AND NOT after THEN 'REGRESSED' WHEN NOT before AND after THEN 'IMPROVED' ELSE 'SAME' END AS state, count(*) AS n FROM j GROUP BY 1")
def outcome_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-17: assertions before and after a change; a missing one has not passed."""
    own = ledger(spark, sf_dir).where("pass IS NOT NULL")
    side = lambda r, n: own.where(F.col("run_id") == r).groupBy("case_key").agg(F.bool_and("pass").alias(n))
    j = side("r0", "before").join(side("r1", "after"), "case_key", "left").withColumn("after", F.coalesce("after", F.lit(False)))
    state = F.when(F.col("before") & ~F.col("after"), "REGRESSED").when(~F.col("before") & F.col("after"), "IMPROVED").otherwise("SAME")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {LEDGER_SQL}, c AS (SELECT model_id, count(*) AS runs, count_if(pass = false) AS failures, count_if(pass) AS recoveries, max(score) AS top FROM ledger WHERE kind = 'OBSERVATION' GROUP BY model_id) SELECT model_id, CASE WHEN top > 0.979 THEN 'RETIRED' WHEN runs >= 5 AND failures > recoveries THEN 'DEGRADED' ELSE 'ACTIVE' END AS phase FROM c")
def worker_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-39, AG-40, SM-04, SP-45: each worker's phase by its record."""
    return G.monitored(ledger(spark, sf_dir).where("kind = 'OBSERVATION'"), 0.979)


@query(
    f"WITH {LEDGER_SQL}, p AS (SELECT concat(model_id, '/', condition) AS profile, case_key, bool_and(pass) AS pass FROM ledger WHERE kind = 'OBSERVATION' AND pass IS NOT NULL GROUP BY 1, 2), "
    "a AS (SELECT profile AS m, 0.6 * round(avg(CAST(pass AS DOUBLE)), 6) AS q FROM p GROUP BY 1), "
    "n AS (SELECT a.profile AS x, b.profile AS y, round(coalesce(count_if(a.pass <> b.pass) / nullif(count_if(NOT a.pass OR NOT b.pass), 0), 0), 6) AS c FROM p a JOIN p b ON a.case_key = b.case_key AND a.profile <> b.profile GROUP BY 1, 2), "
    "p1 AS (SELECT m FROM a ORDER BY round(q, 9) DESC, m LIMIT 1), "
    "p2 AS (SELECT a.m FROM a LEFT JOIN n ON y = a.m AND x IN (SELECT m FROM p1) WHERE a.m NOT IN (SELECT m FROM p1) ORDER BY round(q + 0.4 * coalesce(c, 0), 9) DESC, a.m LIMIT 1), p12 AS (SELECT m FROM p1 UNION ALL SELECT m FROM p2), "
    "p3 AS (SELECT a.m FROM a LEFT JOIN (SELECT y, avg(c) AS c FROM n WHERE x IN (SELECT m FROM p12) GROUP BY y) t ON y = a.m WHERE a.m NOT IN (SELECT m FROM p12) ORDER BY round(q + 0.4 * coalesce(c, 0), 9) DESC, a.m LIMIT 1) "
    "SELECT 1 AS place, m AS member FROM p1 UNION ALL SELECT 2, m FROM p2 UNION ALL SELECT 3, m FROM p3"
)
def greedy_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-11, DG-07, SP-58: profiles picked one at a time for quality and for what they add to those picked."""
    p = written(L.profiles(ledger(spark, sf_dir)), "profiles")
    quality = written(L.accuracy(p).select(F.col("profile").alias("member"), F.col("accuracy").alias("q")), "quality")
    pairs = written(L.pairwise(p).select("a", "b", F.col("complementarity").alias("c")), "pairs")
    return spark.createDataFrame([(i + 1, m) for i, m in enumerate(G.ensemble(quality, pairs, 3))], "place int, member string")


@query("WITH s AS (SELECT o_orderpriority AS module, o_orderkey % 4 AS cls, min(o_orderkey) AS id, CAST(avg(o_totalprice) AS BIGINT) % 97 AS priority FROM orders GROUP BY ALL) SELECT string_agg(concat(module, '/', cls), '>' ORDER BY priority DESC, id) AS rendered FROM s")
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-15, SP-62: sections in the order of their priority, then id."""
    s = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("module"), (F.col("o_orderkey") % 4).alias("cls")).agg(F.min("o_orderkey").alias("id"), (F.round(F.avg("o_totalprice"), 0).cast("long") % 97).alias("priority"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "id", F.concat_ws("/", "module", F.col("cls").cast("string")).alias("name"))))
    return s.agg(F.array_join(F.transform(rows, lambda r: r["name"]), ">").alias("rendered"))


@query("WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_suppkey, CAST(s_nationkey AS INTEGER) AS s_nationkey, round(CASE WHEN n > 1 THEN 1 - rank / (n - 1) ELSE 1 END, 6) AS prior FROM r")
def rank_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-37: a prior by rank."""
    from quarryline.functions.numeric import rank_prior as prior

    w = Window.partitionBy("s_nationkey")
    r = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.row_number().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey")) - 1).alias("rank"), F.count("*").over(w).alias("n"))
    return r.select("s_suppkey", "s_nationkey", F.round(prior(F.col("rank"), F.col("n")), 6).alias("prior"))


@query("WITH a AS (SELECT p_partkey AS key, p_brand AS value FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 30 = 0 THEN 'other' ELSE p_brand END AS value FROM part WHERE p_partkey % 3 = 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT key, min(value) AS value, count(DISTINCT value) > 1 AS clash FROM u GROUP BY key")
def keyed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-06, ST-08, SP-63: a union by key; equal copies are one, unequal ones a clash."""
    p = read(spark, sf_dir, "part")
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value"))
    b = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 30 == 0, "other").otherwise(F.col("p_brand")).alias("value"))
    return a.unionByName(b).groupBy("key").agg(F.min("value").alias("value"), (F.count_distinct("value") > 1).alias("clash"))


@query("WITH s AS (SELECT o_custkey % 50 AS base, o_orderdate, o_orderkey % 6 AS stage, avg(CAST(o_orderkey % 7 >= o_orderkey % 6 AS INT)) OVER (PARTITION BY o_custkey % 50, o_orderkey % 6) AS acc FROM orders), t AS (SELECT base, stage, min(acc) AS acc FROM s GROUP BY ALL), f AS (SELECT base, min(stage) FILTER (WHERE acc < 0.7) AS bad FROM t GROUP BY base) SELECT t.base, max(t.stage) FILTER (WHERE f.bad IS NULL OR t.stage < f.bad) AS frontier FROM t JOIN f USING (base) GROUP BY t.base")
def competence_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-17, SP-46: the last stage cleared before the first failed one."""
    t = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("base"), (F.col("o_orderkey") % 6).alias("stage")).agg(F.avg((F.col("o_orderkey") % 7 >= F.col("o_orderkey") % 6).cast("int")).alias("acc"))
    bad = t.groupBy("base").agg(F.min(F.when(F.col("acc") < 0.7, F.col("stage"))).alias("bad"))
    return t.join(bad, "base").groupBy("base").agg(F.max(F.when(F.col("bad").isNull() | (F.col("stage") < F.col("bad")), F.col("stage"))).alias("frontier"))
