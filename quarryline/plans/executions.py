"""Queries of executions' records, contracts of answers, plans of ensembles and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import executions as E
from quarryline.operators import ledger as L
from quarryline.plans.catalog import query
from quarryline.plans.inputs import LEDGER_SQL, ledger, read

_RUNS = (
    "r AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 3 = 0 THEN 'consolidate_claims' ELSE 'READ' END AS capability, CASE WHEN o_orderkey % 5 = 0 THEN 'UNRESOLVED' ELSE concat('w', o_custkey) END AS worker, o_orderkey % 1000 AS ms, (o_orderkey % 11) / 10.0::DOUBLE AS confidence, CASE WHEN o_orderstatus = 'P' THEN 'lost \"it\"' ELSE '' END AS error, o_orderkey % 2 = 0 AS output FROM orders), "
    "s AS (SELECT l_orderkey AS node, l_linenumber AS place, CASE WHEN l_partkey % 50 = 0 THEN '' WHEN l_linenumber % 2 = 0 THEN concat('Decision.', l_suppkey) ELSE concat('seen.', l_suppkey) END AS key, l_suppkey % 40 = 3 AS broken, l_partkey, CASE WHEN l_partkey % 37 = 0 THEN 1.5 ELSE (l_partkey % 10) / 10.0::DOUBLE END AS confidence FROM lineitem), "
    "e AS (SELECT *, CASE WHEN key = '' THEN 'KEY_REQUIRED' WHEN broken THEN 'VALUE_NOT_JSON' WHEN confidence > 1 THEN 'CONFIDENCE_OUT_OF_RANGE' ELSE '' END AS error FROM s), b AS (SELECT node, min(place) AS place FROM e WHERE error <> '' AND node IN (SELECT node FROM r) GROUP BY node) "
)


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as executions, their lines as what these observe."""
    k, p, s, n = F.col("o_orderkey"), F.col("l_partkey"), F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    runs = read(spark, sf_dir, "orders").select(
        k.alias("node"), F.when(k % 3 == 0, "consolidate_claims").otherwise("READ").alias("capability"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("o_custkey").cast("string"))).alias("worker"), (k % 1000).alias("duration_ms"),
        (k % 11 / 10.0).alias("confidence"), F.when(F.col("o_orderstatus") == "P", 'lost "it"').otherwise("").alias("error"), F.when(k % 2 == 0, '{ "done" : true }').alias("output"),
    )
    key = F.when(p % 50 == 0, "  ").when(n % 2 == 0, F.concat(F.lit(" Decision."), s)).otherwise(F.concat(F.lit("seen."), s, F.lit("\n")))
    seen = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("node"), n.alias("place"), key.alias("key"), F.when(F.col("l_suppkey") % 40 == 3, '{"q": ').otherwise(F.concat(F.lit('{"q":'), p.cast("string"), F.lit("}"))).alias("value"),
        F.when(p % 37 == 0, 1.5).otherwise(p % 10 / 10.0).alias("confidence"), F.array(F.lit(" b"), F.lit("a"), F.lit("b"), F.lit(" ")).alias("references"),
    )
    return runs, seen


@query(
    f"WITH {_RUNS}, o AS (SELECT e.node, CASE WHEN capability <> 'READ' AND key LIKE 'Decision.%' THEN 'DECISION' ELSE 'OBSERVATION' END AS entry, worker, key, concat('{{\"q\":', l_partkey, '}}') AS value, e.confidence, 'a,b' AS refs FROM e JOIN r USING (node) LEFT JOIN b USING (node) WHERE b.place IS NULL OR e.place < b.place), "
    "g AS (SELECT * FROM r WHERE node NOT IN (SELECT node FROM b)), f AS (SELECT node, 'FAILURE' AS entry, worker, 'node.failure' AS key, '{\"error\":\"lost \\\"it\\\"\"}' AS value, 0.0::DOUBLE AS confidence, '' AS refs FROM g WHERE error <> ''), "
    "m AS (SELECT node, 'METRIC' AS entry, worker, 'node.execution' AS key, concat('{\"duration_ms\":', ms, CASE WHEN error <> '' THEN ',\"error\":\"lost \\\"it\\\"\"' ELSE '' END, CASE WHEN confidence <> 0 THEN concat(',\"confidence\":', confidence) ELSE '' END, CASE WHEN output THEN ',\"output\":{\"done\":true}' ELSE '' END, '}') AS value, confidence, '' AS refs FROM g) "
    "SELECT * FROM o UNION ALL SELECT * FROM f UNION ALL SELECT * FROM m".replace("{{", "{").replace("}}", "}")
)
def execution_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-11, SP-10: the observations, decisions, failures and metrics of every execution."""
    records, _ = E.recorded(*_runs(spark, sf_dir))
    return records.withColumn("refs", F.array_join("references", ",")).drop("references")


@query(f"WITH {_RUNS} SELECT node, place, min(error) AS error FROM e JOIN b USING (node, place) WHERE error <> '' GROUP BY node, place")
def broken_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-11: executions whose records break off, and at which observation."""
    return E.recorded(*_runs(spark, sf_dir))[1]


_ANSWERS = {
    "rosetta": ['{"box":"B","arrow":"A","ring":"R","x_time":"T","semantic_film_not_video":true}', '{"box":"B","arrow":"A","ring":" ","x_time":"T"}', '{"box":"B","arrow":"A","ring":1,"x_time":"T"}'],
    "cells": ['{"cells":[{"id":"N","initial_state":"ON"},{"id":"M","initial_state":"OFF"}]}', '{"cells":[]}', '{"cells":[{"id":"n1","initial_state":"ON"},{"id":" N1","initial_state":"OFF"}]}'],
    "transitions": [
        '{"rules":[{"target_cell":"N","from_state":"A","to_state":"B"}]}', '{"rules":[{"target_cell":"N","from_state":"A","to_state":"B","requires":[{"cell_id":"N","state":""}]}]}',
        '{"rules":[{"target_cell":"N","from_state":"A","to_state":"B","note":"x"}]}',
    ],
    "timeline": ['{"checkpoints":["N","2"]}', '{"checkpoints":["N",null]}', '{"checkpoints":["N"]} and so on'],
    "painter": ["{}"] * 3,
}
_WRONG = [["", "BLANK_FIELD", "UNKNOWN_FIELD_OR_TYPE"], ["", "NO_ENTRIES", "REPEATED_CELL"], ["", "BLANK_FIELD", "UNKNOWN_FIELD_OR_TYPE"], ["", "BLANK_FIELD", "NOT_ONE_OBJECT"], ["UNKNOWN_ROLE"] * 3]


@query(
    f"WITH a AS (SELECT o_orderkey, o_orderkey % 5 AS r, (o_orderkey // 5) % 3 AS v FROM orders) SELECT o_orderkey, {list(_ANSWERS)}[r + 1] AS role, {_WRONG}[r + 1][v + 1] AS error FROM a"
)
def role_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-38: answers held against the contract of their role: one object, its fields and no other, something in each of them."""
    k = F.col("o_orderkey")
    roles = F.array(*[F.lit(r) for r in _ANSWERS])
    bodies = F.array(*[F.array(*[F.lit(a) for a in answers]) for answers in _ANSWERS.values()])
    at, which = (k % 5).cast("int"), (F.floor(k / 5) % 3).cast("int")
    # an N in an answer is the order's own number, so that answers differ
    value = F.replace(F.get(F.get(bodies, at), which), F.lit('"N"'), F.concat(F.lit('"n'), k.cast("string"), F.lit('"')))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.get(roles, at).alias("role"), value.alias("value")).select("o_orderkey", "role", E.contract_error(F.col("role"), F.col("value")).alias("error"))


@query(
    "WITH a AS (SELECT o_orderkey AS k, o_orderkey % 4 AS v, 'c' || o_custkey AS clerk FROM orders) SELECT k AS o_orderkey, CASE v WHEN 2 THEN 'UNKNOWN_FIELD_OR_TYPE' WHEN 3 THEN 'NO_OBJECT' ELSE '' END AS error, CASE WHEN v < 2 THEN clerk END AS probe_top, "
    "CASE v WHEN 0 THEN 'x/' || k WHEN 1 THEN '' END AS boot, CASE v WHEN 0 THEN '{\"n\":[' || k || ']}' END AS t3 FROM a"
)
def strict_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-69: models' answers read strictly, with or without a code fence, prose around the object or a field too many."""
    k, clerk = F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    body = F.concat(F.lit('{"boot_text":["x","'), k, F.lit('"],"probe_top":" '), clerk, F.lit('","t3":{"n":['), k, F.lit("]}}"))
    answer = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('I see: {"probe_top":"'), clerk, F.lit('"}. Done')))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit('{"probe_side":"'), clerk, F.lit('"}'))).otherwise(F.concat(F.lit("nothing to see at "), clerk))
    )
    p = E.parsed_observation(answer)
    return read(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.error", "p.probe_top", F.when(F.col("p.error") == "", F.array_join(F.coalesce("p.boot_text", F.array().cast("array<string>")), "/")).alias("boot"), "p.t3")


_ENSEMBLES = (
    "g AS (SELECT c_custkey AS goal, concat('N', c_nationkey) AS capability, 1 + c_custkey % 4 AS members, concat('N', c_custkey % 29) AS fusion_capability, CASE c_custkey % 5 WHEN 0 THEN 'ALL' WHEN 1 THEN 'ANY' WHEN 2 THEN 'QUORUM' WHEN 3 THEN 'QUORUM' ELSE 'ALL' END AS join_kind, CASE c_custkey % 5 WHEN 3 THEN c_custkey % 6 ELSE 0 END AS quorum FROM customer), "
    "h AS (SELECT *, CASE WHEN join_kind = 'QUORUM' AND quorum = 0 THEN members // 2 + 1 ELSE quorum END AS needed FROM g), w AS (SELECT concat('s', s_suppkey) AS worker, concat('N', s_nationkey) AS capability, s_suppkey % 9 = 0 AS bound, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC, s_suppkey % 4 <> 0, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey END, concat('s', s_suppkey)) AS place FROM supplier), "
    "m AS (SELECT goal, list_sort(list(worker)) AS workers FROM h JOIN w USING (capability) WHERE place <= members GROUP BY goal), "
    "j AS (SELECT h.*, workers, f.worker AS fusion, CASE WHEN members < 2 THEN 'TOO_FEW_MEMBERS' WHEN needed > members THEN 'QUORUM_ABOVE_MEMBERS' WHEN coalesce(len(workers), 0) < members THEN 'NOT_ENOUGH_WORKERS' WHEN f.worker IS NULL THEN 'NO_FUSION_WORKER' WHEN f.bound THEN 'FUSION_NOT_ATOMIC' ELSE '' END AS error FROM h LEFT JOIN m USING (goal) LEFT JOIN w f ON f.capability = h.fusion_capability AND f.place = 1) "
)


def _ensembles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda x: F.concat(F.lit(" n"), x.cast("string"))
    join = F.when(c % 5 == 0, "").when(c % 5 == 1, "any").when((c % 5).isin(2, 3), "Quorum ").otherwise("ALL")
    goals = read(spark, sf_dir, "customer").select(
        c.alias("goal"), name(F.col("c_nationkey")).alias("capability"), (1 + c % 4).alias("members"), name(c % 29).alias("fusion_capability"), join.alias("join_kind"), F.when(c % 5 == 3, c % 6).otherwise(0).alias("quorum"),
    )
    workers = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), s.cast("string")).alias("worker"), name(F.col("s_nationkey")).alias("capability"), F.floor(F.col("s_acctbal") / 1000).alias("score"), F.when(s % 4 == 0, 0).otherwise(s).alias("params"),
        F.when(s % 9 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("requires"),
    )
    return E.ensembles(goals, workers)


@query(
    f"WITH {_ENSEMBLES}, ok AS (SELECT * FROM j WHERE error = ''), one AS (SELECT goal, unnest(workers) AS worker FROM ok) SELECT goal, 'ensemble-member-' || worker AS node, worker, 'TOLERATED' AS policy, '' AS depends, 'ALL' AS join_kind, 0::BIGINT AS needed FROM one "
    "UNION ALL SELECT goal, 'ensemble-fusion', fusion, 'STRICT', array_to_string(list_transform(workers, lambda x: 'ensemble-member-' || x), ','), join_kind, needed FROM ok"
)
def ensemble_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG-07: for every goal its members and the node that fuses what they say."""
    return _ensembles(spark, sf_dir)[0].withColumn("depends", F.array_join("depends", ","))


@query(f"WITH {_ENSEMBLES} SELECT goal, error FROM j WHERE error <> ''")
def ensemble_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DG-07: goals that get no ensemble, and why."""
    return _ensembles(spark, sf_dir)[1]


@query(
    f"WITH {LEDGER_SQL}, c AS (SELECT DISTINCT candidate_id, mutation FROM ledger WHERE kind = 'CHANGE'), q AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) AS place FROM (SELECT DISTINCT candidate_id FROM c WHERE candidate_id <> 'c0')), "
    "p AS (SELECT string_agg(event_id, ',' ORDER BY ts, event_id) AS parents FROM (SELECT event_id, min(ts) AS ts FROM ledger WHERE candidate_id = 'c0' AND kind = 'OBSERVATION' GROUP BY 1 ORDER BY 2, 1 LIMIT 20)) "
    "SELECT candidate_id, place::INTEGER AS place, parents, 'closed-loop,exploration,' || string_agg('mutation:' || mutation, ',' ORDER BY mutation) AS tags FROM q JOIN c USING (candidate_id) CROSS JOIN p GROUP BY ALL"
)
def exploration_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-14: records of change for queued candidates that have no evidence yet, resting on the baseline's first observations."""
    own = ledger(spark, sf_dir)
    changes = own.where("kind = 'CHANGE'").select("candidate_id", "mutation").distinct()
    even = changes.select("mutation").distinct().withColumn("weight", F.lit(0.0))
    queue = L.queue(changes.where("candidate_id <> 'c0'"), even).select("candidate_id", "place")
    rows = E.exploration_changes(queue, changes, own.where("candidate_id = 'c0'"))
    return rows.select("candidate_id", "place", F.array_join(F.transform("parents", lambda p: p.cast("string")), ",").alias("parents"), F.array_join("tags", ",").alias("tags"))
