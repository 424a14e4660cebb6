"""Queries of the graph and fixpoint family: plans from orders, cells from customers, traces from conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators import graphs as D
from quarryline.plans.catalog import query
from quarryline.plans.inputs import read

#: A plan derived from the orders: node i depends on i / 2 and i / 3, so it has no cycle; each customer's orders are a plan of their own where plans are told apart.
_NODES = "n AS (SELECT CAST(o_orderkey AS BIGINT) AS node, CAST(o_custkey AS BIGINT) AS plan, CAST(10 + o_orderkey * 7 % 13 AS BIGINT) AS cost, CASE o_orderkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'ANY' ELSE 'QUORUM' END AS join_kind, 2 AS quorum FROM orders)"
_EDGES = "e AS (SELECT DISTINCT plan, src, dst FROM (SELECT plan, node // 2 AS src, node AS dst FROM n WHERE node > 0 UNION ALL SELECT plan, node // 3, node FROM n WHERE node > 0))"


def plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey").cast("long")
    kind = F.when(k % 3 == 0, "ALL").when(k % 3 == 1, "ANY").otherwise("QUORUM")
    nodes = read(spark, sf_dir, "orders").select(k.alias("node"), F.col("o_custkey").cast("long").alias("plan"), (10 + k * 7 % 13).alias("cost"), kind.alias("join_kind"), F.lit(2).alias("quorum"))
    return nodes, links(nodes.select("plan", "node").distinct())


def links(nodes: DataFrame) -> DataFrame:
    """What each node depends on: each once, if nodes are."""
    k = F.col("node")
    return nodes.where("node > 0").select("plan", F.explode(F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3)))).alias("src"), k.alias("dst"))


@query(f"WITH {_NODES}, {_EDGES}, d AS (SELECT plan, dst AS node, count(*) AS deps FROM e GROUP BY ALL) SELECT plan, node, 'QUORUM_TOO_LARGE' AS error FROM n LEFT JOIN d USING (plan, node) WHERE quorum > coalesce(deps, 0) UNION ALL SELECT DISTINCT e.plan, dst, 'UNKNOWN_DEPENDENCY' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.plan = e.plan AND n.node = e.src) UNION ALL SELECT DISTINCT plan, dst, 'OWN_DEPENDENCY' FROM e WHERE src = dst")
def plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG-01: rules that a plan breaks."""
    nodes, _ = plan(spark, sf_dir)
    return D.plan_errors(nodes, links(nodes))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, p(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM p JOIN e ON src = node) SELECT node, CAST(max(level) AS BIGINT) AS level FROM p GROUP BY node")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG-02, FX-06, DG-05: the level of each node, and none for nodes on a cycle."""
    return D.levels(*plan(spark, sf_dir))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, p(node, finish) AS (SELECT node, cost FROM n UNION SELECT dst, finish + n.cost FROM p JOIN e ON src = p.node JOIN n ON n.node = dst) SELECT node, max(finish) AS finish FROM p GROUP BY node")
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-02: the longest chain up to each node."""
    return D.critical_path(*plan(spark, sf_dir))


@query(f"WITH {_NODES}, {_EDGES}, s AS (SELECT node, CASE WHEN node % 5 = 0 THEN 'FAILED' WHEN node % 2 = 0 THEN 'SUCCEEDED' ELSE 'RUNNING' END AS state FROM n), d AS (SELECT dst AS node, count(*) AS k, count_if(state = 'SUCCEEDED') AS good, count_if(state IN ('FAILED', 'BLOCKED')) AS bad FROM e JOIN s ON s.node = src GROUP BY dst), r AS (SELECT n.node, k, good, bad, CASE join_kind WHEN 'ALL' THEN k WHEN 'ANY' THEN 1 ELSE quorum END AS needed FROM n JOIN d USING (node)) SELECT node, CASE WHEN good >= needed THEN 'READY' WHEN k - bad < needed THEN 'IMPOSSIBLE' ELSE 'WAITING' END AS state FROM r")
def dag_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG-03, DG-04: which nodes may start, and which never will."""
    nodes, edges = plan(spark, sf_dir)
    k = F.col("node")
    return D.barriers(nodes, edges, nodes.select("node", F.when(k % 5 == 0, "FAILED").when(k % 2 == 0, "SUCCEEDED").otherwise("RUNNING").alias("state")))


_SUMS = "sha256(concat_ws(':', count(*), sum(CAST('0x' || substr(sha256(x), 1, 15) AS BIGINT)), sum(CAST('0x' || substr(sha256(x), 17, 15) AS BIGINT))))"


@query(f"WITH {_NODES}, {_EDGES}, d AS (SELECT plan, dst AS node, count(*) AS deps FROM e GROUP BY ALL), s AS (SELECT plan, {_SUMS} AS shape FROM (SELECT plan, concat(coalesce(deps, 0), ':', join_kind) AS x FROM n LEFT JOIN d USING (plan, node)) GROUP BY plan), h AS (SELECT plan, {_SUMS} AS edges FROM (SELECT plan, concat(src, '>', dst) AS x FROM e) GROUP BY plan) SELECT plan, edges, shape FROM s LEFT JOIN h USING (plan)")
def plan_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG-08: each plan's hash and that of its shape."""
    return D.topology_hash(*plan(spark, sf_dir))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, g AS (SELECT plan AS goal, max(node) AS node FROM n GROUP BY plan), p(goal, node, depth) AS (SELECT goal, node, 0 FROM g UNION SELECT goal, src, depth + 1 FROM p JOIN e ON e.dst = p.node WHERE src <> 1) SELECT goal, node, CAST(min(depth) AS BIGINT) AS depth FROM p GROUP BY goal, node")
def goal_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG-06: the producers that each customer's last order needs, by chaining backwards from it to the end; what node 1 gives is there already."""
    nodes, edges = plan(spark, sf_dir)
    producers = nodes.select(F.col("node").alias("product"), F.col("node").alias("worker"), F.lit(0).alias("rank"))
    needs = edges.select(F.col("dst").alias("worker"), F.col("src").alias("product"))
    goals = nodes.groupBy(F.col("plan").alias("goal")).agg(F.max("node").alias("product"))
    return D.resolved(goals, needs, producers, spark.range(1, 2).withColumnRenamed("id", "product")).withColumnRenamed("worker", "node")


@query(
    "WITH RECURSIVE c AS (SELECT c_custkey + 1 AS cell, (c_custkey + 1) % 7 = 5 AS blocked FROM customer), d(cell) AS (SELECT cell FROM c WHERE cell = 1 UNION SELECT c.cell FROM c JOIN d ON c.cell // 2 = d.cell WHERE NOT blocked) "
    "SELECT c.cell, CASE WHEN d.cell IS NOT NULL THEN 'DONE' WHEN blocked THEN 'BLOCKED' ELSE 'IDLE' END AS state FROM c LEFT JOIN d USING (cell)"
)
def rule_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-01, SP-39: a cell for each customer: it is done once the cell of half its number is; blocked cells have no rule and hold up what is behind them."""
    k = F.col("c_custkey").cast("long") + 1
    own = read(spark, sf_dir, "customer").select(k.alias("cell"), (k % 7 == 5).alias("blocked"))
    cells = own.select("cell", F.when(F.col("blocked"), "BLOCKED").otherwise("IDLE").alias("state"))
    rules = own.where("NOT blocked").select(F.col("cell").alias("rule"), F.col("cell").alias("target"), F.lit("IDLE").alias("from_state"), F.lit("DONE").alias("to_state"))
    behind = rules.where("target > 1").select("rule", F.floor(F.col("target") / 2).alias("cell"), F.lit("DONE").alias("state"))
    return D.rule_fixpoint(cells, rules, behind)


@query("WITH s AS (SELECT turn AS step, role AS target, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn) AS from_state, role AS to_state FROM conversations) SELECT target, from_state, to_state, count(*) AS n, min(step) AS first_step FROM s GROUP BY ALL")
def trace_distill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-46, SP-30: the rules behind the conversations' turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = read(spark, sf_dir, "conversations").select(F.col("turn").alias("step"), F.col("role").alias("target"), F.lag("role", 1, "start").over(w).alias("from_state"), F.col("role").alias("to_state"))
    return D.distilled(s)


@query("WITH s AS (SELECT lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn) AS state, text AS token, role AS action, role AS next_state FROM conversations) SELECT state, token, min(action) AS action, min(next_state) AS next_state, count(DISTINCT (action, next_state)) = 1 AS deterministic, count(*) AS n FROM s GROUP BY ALL")
def receiver_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-47: a receiver's rules by state and whole text, and where its trace is not deterministic."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = read(spark, sf_dir, "conversations").select(F.lag("role", 1, "start").over(w).alias("state"), F.col("text").alias("token"), F.col("role").alias("action"), F.col("role").alias("next_state"))
    return D.receiver_rules(s)


_BR = "b AS (SELECT user_id AS state_id, event_type AS label, sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) AS re, sum(value / 10) AS im FROM events GROUP BY ALL), c AS (SELECT state_id, label, re / sqrt(sum(re * re + im * im) OVER (PARTITION BY state_id)) AS re, im / sqrt(sum(re * re + im * im) OVER (PARTITION BY state_id)) AS im FROM b WHERE sqrt(re * re + im * im) > 1e-12)"


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    return D.interfered(read(spark, sf_dir, "events").select(F.col("user_id").alias("state_id"), F.col("event_type").alias("label"), sign.alias("re"), (F.col("value") / 10).alias("im")))


@query(f"WITH {_BR} SELECT state_id, label, round(re * re + im * im, 6) AS p FROM c")
def branch_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QS-01, AG-50: interfering branches and their probabilities."""
    return D.probabilities(branches(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query(f"WITH {_BR}, m(label, to_label, a, b) AS (VALUES ('view', 'read', 1.0, 0.0), ('click', 'read', 0.0, 1.0), ('purchase', 'buy', 1.0, 0.0), ('signup', 'buy', -1.0, 0.0), ('error', 'fail', 1.0, 0.0)), j AS (SELECT state_id, to_label AS label, sum(re * CAST(a AS DOUBLE) - im * CAST(b AS DOUBLE)) AS re, sum(re * CAST(b AS DOUBLE) + im * CAST(a AS DOUBLE)) AS im FROM c JOIN m USING (label) GROUP BY ALL) SELECT state_id, label, round((re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY state_id), 6) AS p FROM j")
def branch_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QS-02: a linear map of the branches."""
    m = [("view", "read", 1.0, 0.0), ("click", "read", 0.0, 1.0), ("purchase", "buy", 1.0, 0.0), ("signup", "buy", -1.0, 0.0), ("error", "fail", 1.0, 0.0)]
    linear = spark.createDataFrame(m, "label string, to_label string, m_re double, m_im double")
    return D.probabilities(D.transformed(branches(spark, sf_dir), F.broadcast(linear))).withColumn("p", F.round("p", 6))


@query(f"WITH {_BR}, k AS (SELECT state_id, label, re * re + im * im AS p FROM c WHERE label IN ('view', 'click')) SELECT state_id, label, round(p / sum(p) OVER (PARTITION BY state_id), 6) AS p FROM k")
def branch_constrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QS-03: only allowed labels, scaled again."""
    return D.probabilities(D.interfered(branches(spark, sf_dir).where(F.col("label").isin("view", "click")))).withColumn("p", F.round("p", 6))


@query(f"WITH {_BR}, r AS (SELECT state_id, label, sum(re * re + im * im) OVER (PARTITION BY state_id ORDER BY label ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT state_id, min(label) AS label FROM r WHERE run >= 0.37 - 1e-12 GROUP BY state_id")
def branch_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QS-04, WN-09: what an observation at a given draw finds."""
    return D.observed(branches(spark, sf_dir), 0.37)


@query("SELECT CAST(sum(o_orderkey % 50) AS BIGINT) AS work, max(o_orderkey % 977 + o_orderkey % 50) - min(o_orderkey % 977) AS wall, CAST(sum(o_custkey) AS BIGINT) AS bytes, round(sum(o_orderkey % 50) / (max(o_orderkey % 977 + o_orderkey % 50) - min(o_orderkey % 977)), 6) AS efficiency, greatest(0, max(o_orderkey % 977 + o_orderkey % 50) - min(o_orderkey % 977) - 400) AS overhead FROM orders")
def dag_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-36, AG-37: work, wall time, efficiency and overhead of a run."""
    k = F.col("o_orderkey")
    x = read(spark, sf_dir, "orders").select((k % 50).alias("work"), (k % 977).alias("start"), (k % 977 + k % 50).alias("end"), F.col("o_custkey").alias("bytes"))
    return D.accounting(x, 400)


@query("WITH r AS (SELECT role, n, row_number() OVER (ORDER BY role, n) AS k FROM (SELECT DISTINCT role FROM conversations), range(0, 4) t(n)) SELECT role, n AS replica, (k - 1) % 5 AS worker FROM r")
def replica_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-42, SP-11: roles by replicas, dealt round to worker slots."""
    r = read(spark, sf_dir, "conversations").select("role").distinct().select("role", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("replica"))
    return r.withColumn("worker", F.pmod(F.row_number().over(Window.orderBy("role", "replica")) - 1, F.lit(5)).cast("long"))
