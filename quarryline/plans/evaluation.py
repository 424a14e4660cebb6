"""Queries of full evaluations, checked imports and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import addresses as A
from quarryline.operators import evaluation as V
from quarryline.operators import gates as G
from quarryline.operators import joins as J
from quarryline.plans.catalog import query
from quarryline.plans.inputs import LEDGER_SQL, ledger, read, select

PROFILE = "base"
BASELINE = {
    "roundtrip": 0.95, "boot": 0.5, "index_rate": 0.9, "answer_rate": 0.85, "routing": 0.9, "evidence": 0.9, "transport": 0.5, "context": 0.5, "units": 20.0, "bytes": 300000.0, "recognition_ms": 300.0,
    "bootstrap_steps": 4.0, "decode_steps": 6.0, "mechanical_dependencies": 0.0, "unverified_claims": 1.0, "false_exact": 0.0, "budget_violations": 1.0, "unknown_violations": 0.0,
}
#: Some thresholds are left to the defaults.
POLICY = {"roundtrip": 0.9, "index_rate": -1.0, "bytes": 0.0, "trials": 5.0}

_d = lambda x: f"CAST({x} AS DOUBLE)"
EVIDENCE = {
    "candidate_id": "concat('c', lpad(CAST(p_partkey AS string), 9, '0'))", "roundtrip": f"CASE WHEN p_partkey % 10 = 0 THEN {_d('0.8')} ELSE {_d('1')} END", "boot": f"p_partkey % 7 / {_d('6')}",
    "index_rate": f"CASE WHEN p_partkey % 9 = 0 THEN {_d('0.5')} ELSE {_d('0.95')} END", "answer_rate": f"CASE WHEN p_partkey % 8 = 0 THEN {_d('0.4')} ELSE {_d('0.92')} END", "routing": f"CASE WHEN p_size = 7 THEN {_d('0.1')} ELSE {_d('0.97')} END",
    "evidence": f"CASE WHEN p_partkey % 12 = 5 THEN {_d('0.93')} ELSE {_d('1')} END", "transport": f"p_size % 4 / {_d('3')}", "context": f"p_size % 6 / {_d('5')}", "units": _d("p_size"), "bytes": "p_retailprice * 300",
    "recognition_ms": _d("p_partkey % 900"), "bootstrap_steps": _d("p_size % 9"), "decode_steps": _d("p_size % 12"), "trials": "p_partkey % 40", "real_models": "p_partkey % 9", "context_tokens": "p_partkey % 4200", "reveal_rate": f"p_partkey % 4 / {_d('3')}",
    "mechanical_dependencies": "CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END", "unverified_claims": "CASE WHEN p_partkey % 31 = 0 THEN 2 ELSE 0 END", "false_exact": "CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END",
    "budget_violations": "CASE WHEN p_partkey % 37 = 0 THEN 1 ELSE 0 END", "unknown_violations": "CASE WHEN p_partkey % 41 = 0 THEN 1 ELSE 0 END",
}
_KIND = "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(V.KINDS)) + " END"
_CLAMP = lambda c: f"least(greatest({c}, 0.0), 1.0)"
_RATIO = BASELINE["units"] / BASELINE["bytes"]
_RAW = (
    " + ".join(f"{w} * {_CLAMP(n)}" for n, w in G.SCORE_RATES.items())
    + f" + {G.SCORE_DENSITY} * CASE WHEN units > 0 AND bytes > 0 THEN (units / bytes) / (units / bytes + {_RATIO}) ELSE 0.5 END"
    + "".join(f" + {w} * CASE WHEN {n} > 0 THEN {BASELINE[n]} / ({n} + {BASELINE[n]}) ELSE 0.5 END" for n, w in G.SCORE_LOWER.items())
)
_BASE = sum(w * min(max(BASELINE[n], 0), 1) for n, w in G.SCORE_RATES.items()) + 0.5 * (G.SCORE_DENSITY + sum(G.SCORE_LOWER.values()))
# the rules of each gate in words of SQL, with the thresholds as they stand after the defaults
_GATES = [
    ("SEMANTIC_ROUNDTRIP", "roundtrip >= 0.9"), ("NATIVE_T2_INDEX", "index_rate >= 0.95"), ("NATIVE_SEMANTIC_ANSWER", "answer_rate >= 0.9"), ("NO_MECHANICAL_DEPENDENCY", "mechanical_dependencies = 0"),
    ("NO_UNVERIFIED_MECHANICAL_CLAIMS", "unverified_claims = 0"), ("FALSE_EXACT_ZERO", "false_exact = 0"), ("BUDGET_ZERO", "budget_violations = 0"), ("UNKNOWN_DISCIPLINE", "unknown_violations = 0"),
    ("CARRIER_SIZE", "bytes > 0 AND bytes <= 512000"), ("CONTEXT_BOUND", "context_tokens BETWEEN 0 AND 4000"), ("VERIFIED_EVIDENCE", "evidence >= 0.95"), ("ROUTING", "routing >= 0.95"),
    ("PERCEPTUAL_REVEAL", "kind NOT IN ('INTERFERENCE_STRUCTURE', 'DEPTH_STRUCTURE', 'TEMPORAL_STRUCTURE', 'EMERGENT_STRUCTURE') OR reveal_rate >= 0.95"), ("REAL_MODELS", "real_models >= 3"), ("TRIALS", "trials >= 5"),
    ("CRITICAL_NON_REGRESSION", "roundtrip >= 0.95 AND index_rate >= 0.9 AND answer_rate >= 0.85 AND evidence >= 0.9 AND routing >= 0.9 AND mechanical_dependencies <= 0 AND unverified_claims <= 1 AND false_exact <= 0 AND budget_violations <= 1 AND unknown_violations <= 0"),
    ("MEASURABLE_IMPROVEMENT", f"raw - {_BASE!r} >= 0.01"),
]
_FAILED = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({r}) THEN '{n}' END" for n, r in _GATES) + ")"


@query(
    f"WITH m AS (SELECT {', '.join(f'{e} AS {n}' for n, e in EVIDENCE.items()).replace(' AS string)', ' AS VARCHAR)')}, {_KIND} AS kind FROM part), r AS (SELECT *, CAST({_RAW} AS DOUBLE) AS raw FROM m), "
    f"f AS (SELECT candidate_id, round(raw, 6) AS score, round(raw - {_BASE!r}, 6) AS improvement, {_FAILED} AS failed FROM r) "
    "SELECT *, failed = '' AS eligible, CASE WHEN failed = '' THEN 'RECOMMEND_FOR_VALIDATION' ELSE 'REJECT_OR_CONTINUE_EXPERIMENT' END AS recommendation, place = 1 AND failed = '' AS winner "
    "FROM (SELECT *, row_number() OVER (ORDER BY failed = '' DESC, score DESC, candidate_id) AS place FROM f)"
)
def gated_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, SP-66, JN-05, SF-34, SF-35, TK-07: candidates by all seventeen gates, joined one to one to their evidence, and ranked."""
    parts = read(spark, sf_dir, "part")
    candidates = parts.selectExpr(f"{EVIDENCE['candidate_id']} AS candidate_id", f"'{PROFILE}' AS base_profile", f"array('PROMPT', {_KIND}) AS mutations")
    return V.ranked(V.evaluated(candidates, select(parts, EVIDENCE), PROFILE, BASELINE, POLICY))


@query(
    f"WITH {LEDGER_SQL}, t AS (SELECT concat(model_id, '/', condition, '/', specimen_id) AS trial_id, max(evidence_class) AS evidence_class, count(*) AS planned FROM ledger GROUP BY 1) "
    "SELECT event_id, concat(model_id, '/', condition, '/', specimen_id) AS trial_id, question_id, coalesce(pass, false) AS pass, t.planned, CASE WHEN failure_code IS NOT NULL THEN failure_code WHEN NOT coalesce(pass, false) THEN 'BENCHMARK_ASSERTION_FAILED' ELSE '' END AS failure_code "
    "FROM ledger JOIN t ON t.trial_id = concat(model_id, '/', condition, '/', specimen_id) WHERE kind = 'OBSERVATION'"
)
def checked_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01, SRC-07: every result joined to the trial it comes from; a result of an unknown trial, or of one that is there twice, raises."""
    own = ledger(spark, sf_dir).withColumn("trial_id", F.concat_ws("/", "model_id", "condition", "specimen_id"))
    trials = own.groupBy("trial_id").agg(F.count("*").alias("planned"))
    results = own.where("kind = 'OBSERVATION'").select("event_id", "trial_id", "question_id", "pass", "failure_code")
    j = J.many_to_one(results, trials, ["trial_id"], "trial")
    code = F.coalesce("failure_code", F.when(~F.coalesce("pass", F.lit(False)), "BENCHMARK_ASSERTION_FAILED").otherwise(""))
    return j.withColumn("failure_code", code).withColumn("pass", F.coalesce("pass", F.lit(False)))


#: Lines of a block, and blocks of a page, of a document read as a store of pages.
LINES, BLOCKS = 3, 4


def address_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of four blocks of three lines each; a page's lines are its regions, every seventh line a figure."""
    lines = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "x"))
    page, block = F.floor(F.col("line") / (LINES * BLOCKS)) + 1, F.floor(F.col("line") / LINES) % BLOCKS + 1
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x"))), lambda r: r["x"]), "\n")
    blocks = lines.groupBy("doc", page.alias("page"), block.alias("number")).agg(one.alias("text"))
    regions = lines.select("doc", page.alias("page"), (F.col("line") % (LINES * BLOCKS) + 1).alias("number"), F.when(F.col("line") % 7 == 6, "figure").otherwise("text").alias("region_kind"), F.col("x").alias("text"))
    return A.indexed(A.objects(blocks, regions))


_ADDRESSES = r"""
WITH l AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
b AS (SELECT doc_id, line // 12 + 1 AS page, line // 3 % 4 + 1 AS block, string_agg(x, chr(10) ORDER BY line) AS text FROM l GROUP BY ALL),
k AS (SELECT doc_id, page, block, strlen(text) AS bytes, (strlen(text) + 3) // 4 AS cost FROM b),
p AS (SELECT doc_id, page, (sum(bytes) + 3) // 4 AS cost, list(cost ORDER BY block) AS costs, count(*) AS n FROM k GROUP BY ALL),
s AS (SELECT doc_id, (sum(bytes) + 3) // 4 AS cost FROM k GROUP BY doc_id),
q AS (SELECT doc_id, doc_id % 7 AS kind, doc_id % 3 + 1 AS page, doc_id % 4 + 1 AS block, doc_id % 12 + 1 AS region, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 40 + doc_id % 11 * 40 END AS asked, CASE WHEN doc_id % 2 = 0 THEN 'exact' ELSE 'low' END AS fidelity FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, CASE WHEN asked > 0 THEN asked ELSE 4000 END AS budget, 'store://carrier/docs/' || doc_id || '/pages/' || lpad(CAST(page AS VARCHAR), 6, '0') AS addr FROM q),
f AS (SELECT r.*, p.cost, p.costs, p.n, p.costs[1] <= budget AS t1 FROM r LEFT JOIN p USING (doc_id, page)),
g AS (SELECT *, budget - CASE WHEN t1 THEN costs[1] ELSE 0 END AS b1 FROM f), h AS (SELECT *, n >= 2 AND costs[2] <= b1 AS t2 FROM g), i AS (SELECT *, b1 - CASE WHEN t2 THEN costs[2] ELSE 0 END AS b2 FROM h),
j AS (SELECT *, n >= 3 AND costs[3] <= b2 AS t3 FROM i), m AS (SELECT *, b2 - CASE WHEN t3 THEN costs[3] ELSE 0 END AS b3 FROM j), o AS (SELECT *, n >= 4 AND costs[4] <= b3 AS t4 FROM m), u AS (SELECT *, b3 - CASE WHEN t4 THEN costs[4] ELSE 0 END AS b4 FROM o),
e AS (
  SELECT doc_id, 'INVALID_ADDRESS' AS reason, 0 AS used, '' AS taken, '' AS refs FROM r WHERE kind = 6
  UNION ALL SELECT r.doc_id, CASE WHEN s.cost > budget THEN 'BUDGET_EXCEEDED_EXACT_SOURCE' ELSE 'SOURCE_NOT_GIVEN' END, 0, '', '' FROM r JOIN s USING (doc_id) WHERE kind = 5
  UNION ALL SELECT r.doc_id, CASE WHEN k.cost IS NULL THEN 'NOT_FOUND' WHEN k.cost > budget THEN CASE WHEN fidelity = 'exact' THEN 'BUDGET_EXCEEDED_EXACT' ELSE 'BUDGET_EXCEEDED' END ELSE '' END, CASE WHEN k.cost <= budget THEN k.cost ELSE 0 END,
    CASE WHEN k.cost <= budget THEN addr || '/blocks/' || lpad(CAST(r.block AS VARCHAR), 4, '0') ELSE '' END, '' FROM r LEFT JOIN k ON k.doc_id = r.doc_id AND k.page = r.page AND k.block = r.block WHERE kind = 4
  UNION ALL SELECT doc_id, CASE WHEN cost IS NULL THEN 'NOT_FOUND' WHEN cost > budget THEN 'BUDGET_EXCEEDED_EXACT' ELSE '' END, CASE WHEN cost <= budget THEN cost ELSE 0 END, CASE WHEN cost <= budget THEN addr || '/regions/' || lpad(CAST(region AS VARCHAR), 4, '0') ELSE '' END, ''
    FROM (SELECT r.*, CASE WHEN l.line % 7 = 6 THEN 64 ELSE (strlen(l.x) + 3) // 4 END AS cost FROM r LEFT JOIN l ON l.doc_id = r.doc_id AND l.line = (r.page - 1) * 12 + r.region - 1 WHERE kind = 3)
  UNION ALL SELECT doc_id, CASE WHEN cost IS NULL THEN 'NOT_FOUND' WHEN cost > budget THEN 'BUDGET_EXCEEDED_EXACT' ELSE '' END, CASE WHEN cost <= budget THEN cost ELSE 0 END, CASE WHEN cost <= budget THEN addr ELSE '' END,
    CASE WHEN cost > budget THEN array_to_string(list_transform(range(1, n + 1), lambda x: addr || '/blocks/000' || x), ',') ELSE '' END FROM u WHERE kind < 3 AND fidelity = 'exact'
  UNION ALL SELECT doc_id, CASE WHEN cost IS NULL THEN 'NOT_FOUND' WHEN NOT (t1 OR t2 OR t3 OR t4) THEN 'NO_BLOCK_FITS' ELSE '' END, CASE WHEN cost IS NULL OR NOT (t1 OR t2 OR t3 OR t4) THEN 0 ELSE budget - b4 END,
    concat_ws(',', CASE WHEN t1 THEN addr || '/blocks/0001' END, CASE WHEN t2 THEN addr || '/blocks/0002' END, CASE WHEN t3 THEN addr || '/blocks/0003' END, CASE WHEN t4 THEN addr || '/blocks/0004' END),
    concat_ws(',', CASE WHEN n >= 1 AND NOT t1 THEN addr || '/blocks/0001' END, CASE WHEN n >= 2 AND NOT t2 THEN addr || '/blocks/0002' END, CASE WHEN n >= 3 AND NOT t3 THEN addr || '/blocks/0003' END, CASE WHEN n >= 4 AND NOT t4 THEN addr || '/blocks/0004' END)
    FROM u WHERE kind < 3 AND fidelity = 'low')
SELECT doc_id AS request_id, CASE WHEN reason = '' THEN 'GIVEN' ELSE 'UNKNOWN' END AS status, reason, CAST(used AS BIGINT) AS used, taken, refs FROM e
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each document: pages, blocks, regions, sources, and addresses that are none."""
    k = F.col("doc_id")
    kind, pad = k % 7, lambda c, n: F.lpad(c.cast("string"), n, "0")
    doc = F.concat(F.lit(f"{A.PREFIX}/docs/"), k.cast("string"))
    page = F.concat(doc, F.lit("/pages/"), pad(k % 3 + 1, 6))
    address = (
        F.when(kind < 3, page).when(kind == 3, F.concat(page, F.lit("/regions/"), pad(k % 12 + 1, 4))).when(kind == 4, F.concat(page, F.lit("/blocks/"), pad(k % 4 + 1, 4)))
        .when(kind == 5, F.concat(doc, F.lit("/source"))).otherwise(F.concat(doc, F.lit("/pages/one")))
    )
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        k.alias("request_id"), address.alias("address"), F.when(k % 2 == 0, "").otherwise("low").alias("fidelity"), F.when(k % 5 == 0, 0).otherwise(40 + k % 11 * 40).alias("max_tokens"),
    )


@query(_ADDRESSES)
def address_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-01: a table of addresses resolved in one join with the index, whole or not at all where they have to be exact, packed under their budgets elsewhere."""
    out = A.expanded(address_index(spark, sf_dir), requests(spark, sf_dir))
    return out.withColumn("taken", F.array_join("taken", ",")).withColumn("refs", F.array_join("refs", ","))
