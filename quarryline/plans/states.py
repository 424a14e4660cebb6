"""Queries of states that spread, settle, are reviewed, retried or patched, and of fusion by policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import checks as K
from quarryline.operators import claims as C
from quarryline.operators import states as S
from quarryline.plans.catalog import query
from quarryline.plans.inputs import CLAIMS_SQL, LEDGER_SQL, claims, ledger, read

_N = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_KEYED = f"k AS (SELECT *, {_N.format('subject')} AS s, {_N.format('predicate')} AS p, {_N.format('object')} AS o, predicate = 'IS_R' AS single FROM claims)"


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy for each predicate that is claimed: IS_R has one value, by its cardinality; IS_A is exact by its fusion; the rest has none."""
    seen = claims(spark, sf_dir).select("predicate").distinct().where("predicate <> 'IS_N'")
    return seen.select(F.concat(F.lit(" "), F.lower("predicate")).alias("predicate"), F.when(F.col("predicate") == "IS_R", "one").alias("cardinality"), F.when(F.col("predicate") == "IS_A", "EXACT").alias("fusion"))


@query(
    f"WITH {CLAIMS_SQL}, {_KEYED} SELECT s, p, CASE WHEN single AND count(DISTINCT (polarity, o)) > 1 THEN '' ELSE min(o) END AS o, CASE WHEN single THEN 'SINGLE_VALUE' ELSE 'EXACT' END AS fusion, CASE WHEN count(DISTINCT (polarity, o)) > 1 THEN 'CONFLICT' ELSE 'ACCEPTED' END AS status, "
    "count(DISTINCT (polarity, o)) AS values, count(*) AS n, count_if(polarity)::BIGINT AS yes, count_if(NOT polarity)::BIGINT AS no, round(max(confidence), 6) AS confidence, min(candidate_id) AS first_id, count(DISTINCT address) AS evidence FROM k GROUP BY s, p, single, CASE WHEN NOT single THEN o END"
)
def claim_fusion_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD-04, SP-06, SP-07, SP-08: claims fused by the policy of their predicate, both kinds in one aggregation."""
    return C.fused_by_policy(claims(spark, sf_dir), policies(spark, sf_dir))


@query(
    f"WITH {CLAIMS_SQL}, {_KEYED}, g AS (SELECT s, p, CASE WHEN NOT single THEN o END AS key FROM k GROUP BY s, p, single, CASE WHEN NOT single THEN o END HAVING count(DISTINCT (polarity, o)) > 1) "
    "SELECT k.s, k.p, k.o, candidate_id, CASE WHEN polarity THEN '+' ELSE '-' END AS side FROM k JOIN g ON k.s = g.s AND k.p = g.p AND CASE WHEN NOT single THEN o END IS NOT DISTINCT FROM g.key"
)
def claim_conflict_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-08, AG-30: the candidates of each conflict, and which side each takes."""
    return C.conflict_members(claims(spark, sf_dir), policies(spark, sf_dir))


@query("SELECT event_id, '{\"a\":{\"b\":{\"c\":{\"props\":' || props || ',\"s\":\"} \\\\\" {\"}}}}' AS first, CAST(2 AS BIGINT) AS n, props AS second, '' AS whole FROM events".replace("\\\\", "\\"))
def json_objects_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-40: objects nested deep in prose, with braces and quotes in strings; taken from the first brace to the last they are no JSON."""
    props = F.col("props")
    deep = F.concat(F.lit('{"a":{"b":{"c":{"props":'), props, F.lit(',"s":"} \\" {"}}}}'))
    text = F.concat(F.lit('it said "so}: '), deep, F.lit(" and then "), props, F.lit("."))
    found = K.json_objects(text)
    return read(spark, sf_dir, "events").select("event_id", K.json_object(text).alias("first"), F.size(found).cast("long").alias("n"), F.get(found, F.lit(1)).alias("second"), F.coalesce(K.json_between(text), F.lit("")).alias("whole"))


@query(
    r"""SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[\p{L}\p{Nd}_]+'))), ' '), '') AS evidence, CASE WHEN turn % 2 = 0 THEN '{"turn":' || turn || '}' ELSE '"said ' || turn || ' \"so\"' || chr(92) || 'n."' END AS observation FROM conversations"""
)
def evidence_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-41, SP-38: free evidence in its normal form, and answers as JSON, those that hold no object as a JSON string."""
    t = F.col("turn").cast("string")
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('here: {"turn" : '), t, F.lit("} ok"))).otherwise(F.concat(F.lit(" said "), t, F.lit(' "so"\n.\n')))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", K.normal_evidence(F.col("text")).alias("evidence"), K.structured_observation(answer).alias("observation"))


@query(
    f"WITH {LEDGER_SQL}, o AS (SELECT event_id, question_id, coalesce(pass, false) AS ok, CASE event_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN ' pass' WHEN 2 THEN 'UNKNOWN' ELSE 'FAIL' END AS status FROM ledger WHERE kind = 'OBSERVATION') "
    "SELECT event_id, CASE WHEN ok THEN upper(trim(status)) <> 'PASS' AND NOT (question_id = 'Q8' AND status = 'UNKNOWN') ELSE upper(trim(status)) = 'PASS' END AS mismatch FROM o"
)
def trace_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18: answers held against the status of their debug trace."""
    i = F.col("event_id")
    status = F.when(i % 4 == 0, "PASS").when(i % 4 == 1, " pass").when(i % 4 == 2, "UNKNOWN").otherwise("FAIL")
    return ledger(spark, sf_dir).where("kind = 'OBSERVATION'").select("event_id", K.trace_mismatch(F.col("pass"), F.col("question_id"), status).alias("mismatch"))


#: Plans from the orders, one for each customer: the i-th order waits for the orders i / 2, i - 1 and i - 2; some fail, some edges tolerate that.
_SPREAD = """
WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey AS plan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
n AS (SELECT plan, i AS node, CASE i % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'ANY' ELSE 'QUORUM' END AS kind, o_orderkey % 11 = 0 AS fails, CASE WHEN o_orderkey % 4 = 0 THEN 'TOLERATED' ELSE 'STRICT' END AS policy FROM o),
e AS MATERIALIZED (SELECT DISTINCT plan, src, node AS dst, (src + node) % 5 = 0 AS tolerated FROM (SELECT plan, node, unnest([node // 2, node - 2, node - 1]) AS src FROM n) WHERE src >= 1 AND src < node),
k AS MATERIALIZED (SELECT n.plan, n.node, n.kind, n.fails, count(e.src) AS deps, list({'src': e.src, 't': e.tolerated}) FILTER (WHERE e.src IS NOT NULL) AS ds FROM n LEFT JOIN e ON e.plan = n.plan AND e.dst = n.node GROUP BY ALL),
-- node by node in the order of i: dead is a string with a 1 for each dead node so far
r(plan, i, dead, blocked) AS (
  SELECT DISTINCT plan, CAST(0 AS BIGINT), '', '' FROM n
  UNION ALL
  SELECT plan, i + 1, dead || CASE WHEN b OR fails THEN '1' ELSE '0' END, blocked || CASE WHEN b THEN '1' ELSE '0' END
  FROM (SELECT r.plan, r.i, r.dead, r.blocked, k.fails, deps > 0 AND deps - len(list_filter(coalesce(ds, []), lambda d: NOT d.t AND r.dead[d.src] = '1')) < CASE kind WHEN 'ALL' THEN deps WHEN 'ANY' THEN 1 ELSE deps // 2 + 1 END AS b
        FROM r JOIN k ON k.plan = r.plan AND k.node = r.i + 1)),
z AS (SELECT plan, max_by(dead, i) AS dead, max_by(blocked, i) AS blocked FROM r GROUP BY plan),
s AS (SELECT n.plan, n.node, n.policy, CASE WHEN z.blocked[n.node] = '1' THEN 'BLOCKED' WHEN n.fails THEN 'FAILED' ELSE 'COMPLETED' END AS state FROM n JOIN z USING (plan))
"""


def _failing_plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    from quarryline.sources.shared import written

    plan = F.col("o_custkey").alias("plan")
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    own = written(read(spark, sf_dir, "orders").select(plan, i.alias("node"), "o_orderkey"), "plans")
    k, n = F.col("o_orderkey"), F.col("node")
    kind = F.when(n % 3 == 0, "ALL").when(n % 3 == 1, "ANY").otherwise("QUORUM")
    nodes = own.select("plan", "node", kind.alias("join_kind"), F.lit(0).alias("quorum"), (k % 11 == 0).alias("fails"), F.when(k % 4 == 0, "TOLERATED").otherwise(" ").alias("policy"))
    src = F.explode(F.array(F.floor(n / 2), n - 2, n - 1)).alias("src")
    edges = own.select("plan", src, n.alias("dst")).where("src >= 1 AND src < dst").withColumn("tolerated", (F.col("src") + F.col("dst")) % 5 == 0)
    return nodes, edges


@query(_SPREAD + "SELECT plan, node, state FROM s")
def failure_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG-04: failures spread through plans with diamonds, along strict edges alone, by each node's barrier."""
    return S.spread(*_failing_plans(spark, sf_dir))


@query(_SPREAD + "SELECT plan, bool_and(state = 'COMPLETED' OR policy = 'TOLERATED') AS ok, count_if(state = 'FAILED')::BIGINT AS failed, count_if(state = 'BLOCKED')::BIGINT AS blocked FROM s GROUP BY plan")
def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG-04, DG-05: what became of each plan's run, where nodes may tolerate their own failure."""
    nodes, edges = _failing_plans(spark, sf_dir)
    return S.run_verdicts(S.spread(nodes, edges), nodes)


#: A small rule system for each customer: three cells in a chain; some lack a cell, some write one cell twice.
_SYSTEMS = (
    "WITH c AS (SELECT c_custkey AS key, c_custkey % 13 = 0 AS lacks, c_custkey % 17 = 0 AS clashes, c_custkey % 5 = 0 AS held FROM customer), "
    "x AS (SELECT key, CASE WHEN lacks THEN 'UNKNOWN_CELL' WHEN clashes THEN 'CONFLICTING_WRITES' ELSE '' END AS error, held FROM c) "
)


def _systems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k.alias("key"), (k % 13 == 0).alias("lacks"), (k % 17 == 0).alias("clashes"), (k % 5 == 0).alias("held"))
    pick = lambda names, *rows: c.select("key", F.inline(F.filter(F.array(*[F.when(cond, F.struct(*[F.lit(v).alias(n) for n, v in zip(names, vals, strict=True)])) for cond, vals in rows]), lambda r: r.isNotNull())))
    yes = F.lit(True)
    cells = pick(["cell", "state"], (yes, ("A", "IDLE")), (yes, ("B", "IDLE")), (~F.col("lacks"), ("C", "IDLE")))
    rules = pick(
        ["rule", "target", "from_state", "to_state"], (yes, ("r1", "A", "IDLE", "DONE")), (yes, ("r2", "B", "IDLE", "DONE")), (yes, ("r3", "C", "IDLE", "DONE")), (yes, ("r4", "A", "DONE", "DONE")),
        (F.col("clashes"), ("r5", "B", "IDLE", "LOST")),
    )
    requires = pick(["rule", "cell", "state"], (yes, ("r2", "A", "DONE")), (F.col("clashes"), ("r5", "A", "DONE")), (yes, ("r3", "B", "DONE")), (F.col("held"), ("r3", "A", "IDLE")), (yes, ("r4", "A", "DONE")))
    return cells, rules, requires


@query(
    _SYSTEMS + "SELECT key, error, CASE WHEN error <> '' THEN '' WHEN held THEN 'A DONE; B DONE; C IDLE' ELSE 'A DONE; B DONE; C DONE' END AS answer FROM x"
)
def many_fixpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-39, FX-01: every customer's rule system run to its end in one loop, and what keeps the others from one."""
    done, errors = S.settled(*_systems(spark, sf_dir))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "state"))), lambda r: F.concat_ws(" ", r["cell"], r["state"])), "; ")
    answers = done.groupBy("key").agg(listed.alias("answer"))  # the cells of one system
    return answers.select("key", F.lit("").alias("error"), "answer").unionByName(errors.select("key", "error", F.lit("").alias("answer")))


@query(
    "WITH v AS (SELECT user_id, event_type AS role, '{\"k\":' || CASE WHEN user_id % 3 = 0 THEN 1 ELSE event_id % 4 END || '}' AS value, value > 8 AS ok FROM events), c AS (SELECT user_id, role, value, count(*) AS n, bool_and(ok) AS ok FROM v GROUP BY ALL), "
    "b AS (SELECT user_id, role, sum(n) AS total, bool_and(ok) AS ok, max(n) AS most FROM c GROUP BY ALL), t AS (SELECT c.user_id, c.role, count(*) AS ties, min(c.value) AS value FROM c JOIN b ON b.user_id = c.user_id AND b.role = c.role AND c.n = b.most GROUP BY ALL), "
    "j AS (SELECT b.*, t.ties, t.value, CAST((2 * total + 2) // 3 AS BIGINT) AS needed FROM b JOIN t USING (user_id, role)) "
    "SELECT user_id, role, CASE WHEN ok AND ties = 1 AND most >= needed THEN 'CONFIRMED' ELSE 'UNKNOWN' END AS status, coalesce(CASE WHEN ok AND ties = 1 AND most >= needed THEN value END, 'UNKNOWN') AS answer, CAST(CASE WHEN ok THEN most ELSE 0 END AS BIGINT) AS votes, needed FROM j"
)
def consensus_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-39, AG-23: the consensus of structured observations for each subject and role as its answer; any that is out of contract leaves it UNKNOWN."""
    raw = F.concat(F.lit('so: {"k" : '), F.when(F.col("user_id") % 3 == 0, 1).otherwise(F.col("event_id") % 4).cast("string"), F.lit("} "))
    v = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("role"), K.structured_observation(raw).alias("value"), (F.col("value") > 8).alias("valid"))
    return S.consensus(v, ["user_id", "role"]).select("user_id", "role", "status", F.coalesce("value", F.lit("UNKNOWN")).alias("answer"), "votes", "needed")


_PANEL = r"""
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'READ' WHEN 1 THEN 'MOVE' ELSE 'DELETE' END END AS cap, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 5 END AS risk,
  CASE WHEN o_orderkey % 7 = 0 THEN '/tmp/x' WHEN o_orderkey % 7 = 1 THEN '/data/../x' WHEN o_orderkey % 7 = 2 THEN 'plain' ELSE '/data/x' END AS path, CASE o_orderkey % 6 WHEN 0 THEN 'DEFERRED' WHEN 1 THEN 'ANSWERED' END AS verdict,
  o_custkey % 9 AS told, o_orderkey % 10 AS split FROM orders),
c AS (
  SELECT k, 1 AS place, 'permission-sentinel' AS sentinel, 'sentinel_error' AS kind, 3 AS level FROM s WHERE cap IS NOT NULL AND risk IS NULL
  UNION ALL SELECT k, 1, 'permission-sentinel', 'risk_over_ceiling', 3 FROM s WHERE cap IS NOT NULL AND risk > 3
  UNION ALL SELECT k, 1, 'permission-sentinel', 'capability_not_allowed', 3 FROM s WHERE cap = 'DELETE'
  UNION ALL SELECT k, 2, 'scope-sentinel', 'path_out_of_scope', 3 FROM s WHERE cap IS NOT NULL AND path IN ('/tmp/x', '/data/../x')
  UNION ALL SELECT k, 3, 'conflict-sentinel', 'observation_conflict', 2 FROM s WHERE split = 0
  UNION ALL SELECT k, 4, 'ood-sentinel', 'out_of_distribution', 2 FROM s WHERE verdict = 'DEFERRED'
  UNION ALL SELECT k, 4, 'ood-sentinel', 'not_calibrated', 1 FROM s WHERE cap IS NULL AND verdict IS NULL
  UNION ALL SELECT k, 5, 'numeric-consistency-sentinel', 'unsupported_number', 2 FROM s WHERE told >= 5),
w AS (SELECT k, count(*) AS concerns, count_if(level > 1)::BIGINT AS failed_checks, max(level) AS level, arg_min(sentinel, (-level, place, kind)) AS sentinel, arg_min(kind, (-level, place, kind)) AS kind FROM c GROUP BY k)
SELECT s.k AS subject, CASE level WHEN 3 THEN 'BLOCKED' WHEN 2 THEN 'WARNED' ELSE 'CLEAR' END AS verdict, CASE WHEN level > 1 THEN sentinel ELSE '' END AS decided_by, CASE WHEN level > 1 THEN w.kind ELSE '' END AS kind, coalesce(concerns, 0) AS concerns, coalesce(failed_checks, 0) AS failed_checks
FROM s LEFT JOIN w USING (k)
"""


@query(_PANEL)
def sentinel_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-25, SP-49: what five sentinels find in proposed actions and their answers, folded to a verdict and the sentinel that decided it."""
    k = F.col("o_orderkey")
    cap = F.when(k % 3 != 0, F.when(k % 4 == 0, "READ").when(k % 4 == 1, "MOVE").otherwise("DELETE"))
    path = F.when(k % 7 == 0, "/tmp/x").when(k % 7 == 1, "/data/../x").when(k % 7 == 2, "plain").otherwise("/data/x")
    orders = read(spark, sf_dir, "orders")
    subjects = orders.select(
        k.alias("subject"), cap.alias("capability"), F.when(k % 29 != 0, k % 5).alias("risk"), F.create_map(F.lit("path"), path).alias("args"), F.lit(3).alias("max_risk"), F.array(F.lit("READ"), F.lit("MOVE")).alias("allowed"),
        F.array(F.lit("/data")).alias("roots"), F.when(k % 6 == 0, "DEFERRED").when(k % 6 == 1, "ANSWERED").alias("verdict"),
        F.concat(F.lit("some 7 or "), (F.col("o_custkey") % 9 + 10).cast("string"), F.lit(", not more")).alias("answer"), F.lit("it was 10, 11, 12, 13 or 14.").alias("evidence"),
    )
    seen = orders.select(k.alias("subject"), F.lit("size").alias("key"), F.explode(F.array(F.lit("a"), F.when(k % 10 == 0, "b").otherwise("a"))).alias("value"))
    return S.reviewed(subjects, S.concerns(subjects, seen))


@query(
    "WITH q(question) AS (SELECT unnest(range(0, 5))), a AS (SELECT o_custkey AS trial, o_orderkey % 5 AS question, bool_and(o_totalprice > 60000) AS pass FROM orders GROUP BY ALL), f AS (SELECT trial FROM a GROUP BY trial HAVING count(*) = 5), "
    "k AS (SELECT a.* FROM a JOIN f USING (trial)), z AS (SELECT o_custkey AS trial, o_orderkey % 5 AS question, bool_and(o_totalprice > 40000) AS pass FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL), "
    "g AS (SELECT k.trial, k.question, z.pass FROM k LEFT JOIN z USING (trial, question) WHERE NOT k.pass), w AS (SELECT trial FROM g GROUP BY trial HAVING count(*) = count(pass)) "
    "SELECT trial, question, pass, false AS diagnostic FROM k UNION ALL SELECT trial, question, pass, true FROM g JOIN w USING (trial)"
)
def diagnostic_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-15: trials kept only if every question is answered, and one retry of their failed questions, kept only if it is complete."""
    o = read(spark, sf_dir, "orders")
    row = lambda least: [F.col("o_custkey").alias("trial"), (F.col("o_orderkey") % 5).alias("question"), (F.col("o_totalprice") > least).alias("pass")]
    return S.retried(o.select(F.col("o_custkey").alias("trial")), o.select(*row(60000)), o.where("o_orderkey % 3 = 0").select(*row(40000)), spark.range(5).withColumnRenamed("id", "question"))


@query(
    "WITH s AS (SELECT l_orderkey AS prompt, l_linenumber AS place, l_partkey % 40 AS id, l_shipdate::VARCHAR AS text FROM lineitem), p AS (SELECT l_orderkey AS prompt, l_linenumber AS place, l_suppkey % 40 AS id, concat('new ', l_linenumber, ' ', l_suppkey) AS text FROM lineitem WHERE l_suppkey % 40 <> 7), "
    "f AS (SELECT prompt, id, min(place) AS first FROM s GROUP BY ALL), n AS (SELECT prompt, id, min(place) AS came, arg_max(text, (place, text)) AS text FROM p GROUP BY ALL), e AS (SELECT prompt, max(place) AS last FROM s GROUP BY prompt), "
    "a AS (SELECT n.prompt, e.last + row_number() OVER (PARTITION BY n.prompt ORDER BY came, n.id) AS place, n.id, n.text FROM n JOIN e USING (prompt) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.prompt = n.prompt AND f.id = n.id)) "
    "SELECT s.prompt, CAST(s.place AS BIGINT) AS place, s.id, CASE WHEN s.place = f.first AND n.text IS NOT NULL THEN n.text ELSE left(s.text, 10) END AS text FROM s JOIN f ON f.prompt = s.prompt AND f.id = s.id LEFT JOIN n ON n.prompt = s.prompt AND n.id = s.id UNION ALL SELECT prompt, place, id, text FROM a"
)
def section_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-63, SP-21: every order's lines as sections of a prompt, patched in place by id or appended; a protected section isn't patched."""
    li = read(spark, sf_dir, "lineitem")
    place = F.col("l_linenumber").cast("long").alias("place")
    prompt = F.col("l_orderkey").alias("prompt")
    sections = li.select(prompt, place, (F.col("l_partkey") % 40).alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("text"))
    patches = li.select(prompt, place, (F.col("l_suppkey") % 40).alias("id"), F.concat_ws(" ", F.lit("new"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("text"))
    shields = li.select(prompt, F.lit(7).cast("long").alias("id"))
    return S.patched(sections, patches, ["prompt"], ["text"], shields)


@query(
    "WITH m AS (SELECT DISTINCT l_orderkey AS plan, concat('m', l_linenumber) AS module FROM lineitem WHERE l_quantity > 25), r AS (SELECT l_orderkey AS plan, l_linenumber AS place, CASE l_suppkey % 3 WHEN 0 THEN 'PRESERVE' WHEN 1 THEN 'AVOID' ELSE 'REQUIRE' END AS kind, concat('m', l_partkey % 7) AS target, concat('learned ', l_linenumber) AS reason FROM lineitem), "
    "n AS (SELECT plan, 99 AS place, 'PRESERVE' AS kind, module AS target, 'protected by prompt genome' AS reason FROM m JOIN orders ON o_orderkey = plan WHERE module <> concat('m', o_orderkey % 7)) SELECT plan, kind, target, arg_min(reason, (place, reason)) AS reason FROM (SELECT * FROM r UNION ALL SELECT * FROM n) GROUP BY ALL"
)
def genome_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-21: the protected modules of each plan's genome become rules of it, but for its own target; a rule that is there stays."""
    li, k = read(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    plan, module = F.col("l_orderkey").alias("plan"), lambda n: F.concat(F.lit("m"), n.cast("string"))
    kind = F.when(k % 3 == 0, "PRESERVE").when(k % 3 == 1, "AVOID").otherwise("REQUIRE")
    rules = li.select(plan, F.col("l_linenumber").alias("place"), kind.alias("kind"), module(F.col("l_partkey") % 7).alias("target"), F.concat(F.lit("learned "), F.col("l_linenumber").cast("string")).alias("reason"))
    modules = li.select(plan, module(F.col("l_linenumber")).alias("module"), (F.col("l_quantity") > 25).alias("protected"))
    return S.protected(rules, modules, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan"), module(F.col("o_orderkey") % 7).alias("own")))
