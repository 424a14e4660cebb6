"""Plans by rounds, plans told apart, and streams whose states Spark keeps."""

from __future__ import annotations

import random
import shutil

import numpy as np
import pytest

from quarryline.operators import graphs as G
from quarryline.streaming import states as S


def plain_levels(nodes, edges):
    deps = {}
    for s, d in set(edges):
        deps.setdefault(d, set()).add(s)
    out, open_ = {}, set(nodes)
    while True:
        ready = [n for n in open_ if deps.get(n, set()) <= out.keys()]
        if not ready:
            return out
        for n in ready:
            above = [out[s] for s in deps.get(n, ())]
            out[n] = (max((a[0] for a in above), default=-1) + 1, max((a[1] for a in above), default=0) + nodes[n])
            open_.discard(n)


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_chains_trees_diamonds_and_cycles(spark, seed):
    rng = random.Random(seed)
    nodes = {i: rng.randint(0, 9) for i in range(60)}
    edges = [(s, i) for i in range(1, 40) for s in rng.sample(range(i), min(i, rng.choice([1, 1, 1, 2, 3])))]
    edges += [(40, 41), (41, 42), (42, 40), (42, 43), (44, 44), (45, 44)]  # cycles of nodes with one dependency and with two, and what is behind them
    edges += [(46 + i, 47 + i) for i in range(10)] + [(56, 57), (12, 57)]
    n = spark.createDataFrame(list(nodes.items()), "node long, cost long")
    e = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: (r["level"], r["finish"]) for r in G._peeled(n, e).collect()} == plain_levels(nodes, edges)
    with pytest.raises(G.Cyclic):
        G.critical_path(n, e)


def test_a_long_chain_is_a_short_plan(spark):
    n = spark.range(1000).selectExpr("id AS node", "id % 7 AS cost")
    done = G._peeled(n, spark.range(999).selectExpr("id AS src", "id + 1 AS dst"))
    last = done.where("node = 999").first()
    assert (last["level"], last["finish"]) == (999, sum(i % 7 for i in range(1000)))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Relation ") <= 4


def test_another_plan_leaves_a_plan_s_hashes_and_errors_alone(spark):
    nodes = [("p", "a", "ALL", 1), ("p", "b", "ANY", 1)]
    edges = [("p", "a", "b")]
    more_nodes = [*nodes, ("q", "a", "ALL", 2), ("q", "b", "ALL", 0), ("q", "c", "ANY", 1), ("q", "c", "ANY", 1)]
    more_edges = [*edges, ("q", "c", "a"), ("q", "b", "a"), ("q", "x", "b"), ("q", "c", "c")]
    frame = lambda n, e: (spark.createDataFrame(n, "plan string, node string, join_kind string, quorum int"), spark.createDataFrame(e, "plan string, src string, dst string"))
    alone = {tuple(r) for r in G.topology_hash(*frame(nodes, edges)).collect()}
    both = {tuple(r) for r in G.topology_hash(*frame(more_nodes, more_edges)).collect()}
    assert alone < both and len(both) == 2
    bindings = spark.createDataFrame([("q", "a", "b"), ("q", "a", "a"), ("p", "b", "c")], "plan string, node string, source string")
    errors = {tuple(r) for r in G.plan_errors(*frame(more_nodes, more_edges), bindings).collect()}
    assert errors == {
        ("p", "a", "QUORUM_TOO_LARGE"), ("p", "b", "UNBOUND_INPUT"), ("q", "b", "QUORUM_TOO_SMALL"), ("q", "b", "UNKNOWN_DEPENDENCY"), ("q", "c", "DUPLICATE"), ("q", "c", "OWN_DEPENDENCY"), ("q", "a", "UNBOUND_INPUT"),
    }


def test_a_label_without_a_mapping_raises(spark):
    state = spark.createDataFrame([(1, "x", 0.6, 0.0), (1, "y", 0.8, 0.0)], "state_id int, label string, re double, im double")
    linear = spark.createDataFrame([("x", "z", 1.0, 0.0)], "label string, to_label string, m_re double, m_im double")
    with pytest.raises(Exception, match="no mapping for label: y"):
        G.transformed(state, linear).collect()


def step(phase, ok):
    up, down = {"CANDIDATE": "SHADOW", "SHADOW": "ACTIVE", "DEGRADED": "ACTIVE"}, {"ACTIVE": "DEGRADED", "SHADOW": "CANDIDATE", "DEGRADED": "RETIRED"}
    return (up if ok else down).get(phase, phase)


def test_outcomes_compose_as_they_apply_one_by_one():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 7, 64, 101):
        outcomes = [rng.randint(0, 1) for _ in range(n)]
        for start in range(5):
            phase, moves = S.PHASES[start], 0
            for ok in outcomes:
                after = step(phase, ok)
                moves, phase = moves + (after != phase), after
            assert S.moved(start, np.array(outcomes, dtype=np.int64)) == (S.PHASES.index(phase), moves)


def test_a_stream_s_states_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"w{rng.randint(0, 4)}", rng.random() < 0.6, i) for i in range(300)]
    src, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    schema = "worker string, pass boolean, seq long"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        S.run(S.lifecycle(stream), out, offsets)
        return {r["worker"]: (r["phase"], r["moves"]) for r in S.latest(spark, out, "worker").collect()}

    def plain(rows):
        states = {}
        for w, ok, _ in rows:
            phase, moves = states.get(w, ("CANDIDATE", 0))
            after = step(phase, ok)
            states[w] = (after, moves + (after != phase))
        return states

    spark.createDataFrame(rows[:100][::-1], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == plain(rows[:100])
    assert run() == plain(rows[:100])  # nothing new
    for part in (rows[100:200], rows[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        got = run()
    assert got == plain(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != S.ROCKSDB
    # what was written is the changes; the states themselves are Spark's, a row for each key
    state = spark.read.format("statestore").load(offsets)
    assert state.count() == len(plain(rows))
    # the same rows from the start, by the written changes alone being gone
    shutil.rmtree(out)
    shutil.rmtree(offsets)
    assert run().keys() == plain(rows).keys()


def test_a_guard_keeps_the_last_lines_whatever_their_order(spark, tmp_path):
    src, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    schema = "key long, seq long, line string"
    rows = [(1, i, f"item {i}") for i in range(40)] + [(2, i, f"text {'x' * i}") for i in range(40)] + [(3, i, "a") for i in range(3)] + [(4, i, None if i % 2 else "b  7") for i in range(60)]
    random.Random(1).shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.run(S.guarded(stream, 16), out, offsets)
    got = {r["key"]: (r["n_chunks"], r["degenerate"]) for r in S.latest(spark, out, "key").collect()}
    assert got == {1: (40, True), 2: (40, False), 3: (3, False), 4: (60, True)}
