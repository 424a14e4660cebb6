"""Records of executions, contracts of answers, ensembles and exploration against plain Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import executions as E

RUN = "node int, capability string, worker string, duration_ms long, confidence double, error string, output string"
SEEN = "node int, place int, key string, value string, confidence double, references array<string>"


def test_records_of_odd_executions(spark):
    runs = spark.createDataFrame([
        (1, "consolidate", "w", 5, 0.5, "", '{ "a" : [1, null] }'), (2, "read", " ", None, None, 'bad "x"\n', None), (3, "read", None, 1, 0.0, None, "no json"), (4, "read", "w", 1, 1.0, "late", None), (5, None, "w", 0, 1.0, "", None),
    ], RUN)
    seen = spark.createDataFrame([
        (1, 1, " Decision.a ", "1", 0.0, ["b ", "a", "", "b", None]), (1, 2, "decided", '"x"', 1.0, None), (2, 1, "decision.b", "null", 0.3, []), (4, 1, "ok", "true", 0.1, []), (4, 2, "k", "{}  x", 0.1, []), (4, 3, "never", "1", 0.1, []),
        (5, 1, "k", "{}", float("nan"), []), (9, 1, "nobody", "1", 0.1, []),
    ], SEEN)
    records, broken = E.recorded(runs, seen)
    got = {(r["node"], r["entry"], r["worker"], r["key"], r["value"], r["confidence"], tuple(r["references"])) for r in records.collect()}
    assert got == {
        (1, "DECISION", "w", "Decision.a", "1", 0.0, ("a", "b")), (1, "OBSERVATION", "w", "decided", '"x"', 1.0, ()), (1, "METRIC", "w", "node.execution", '{"duration_ms":5,"confidence":0.5,"output":{"a":[1,null]}}', 0.5, ()),
        (2, "OBSERVATION", "UNRESOLVED", "decision.b", "null", 0.3, ()), (2, "FAILURE", "UNRESOLVED", "node.failure", json.dumps({"error": 'bad "x"\n'}, separators=(",", ":")), 0.0, ()),
        (2, "METRIC", "UNRESOLVED", "node.execution", '{"duration_ms":0,"error":"bad \\"x\\"\\n"}', 0.0, ()), (3, "METRIC", "UNRESOLVED", "node.execution", '{"duration_ms":1}', 0.0, ()), (4, "OBSERVATION", "w", "ok", "true", 0.1, ()),
    }
    assert {tuple(r) for r in broken.collect()} == {(4, 2, "VALUE_NOT_JSON"), (5, 1, "CONFIDENCE_OUT_OF_RANGE")}
    assert E.recorded(runs.limit(0), seen)[0].count() == 0


@pytest.mark.parametrize("role, value, error", [
    ("cells", ' {"cells":[{"initial_state":"ON","id":"a"}]}\n', ""), ("cells", '{"cells":[{"id":"a","initial_state":"ON"},null]}', "BLANK_FIELD"), ("cells", '{"cells":[{"id":"a","initial_state":"ON","x":1}]}', "UNKNOWN_FIELD_OR_TYPE"),
    ("cells", '{"cells":[{"id":7,"initial_state":"ON"}]}', "UNKNOWN_FIELD_OR_TYPE"), ("cells", '{"cells":[{"id":"a","initial_state":"ON"},3]}', "UNKNOWN_FIELD_OR_TYPE"), ("cells", '{"cells":null}', "NO_ENTRIES"), ("cells", "{}", "NO_ENTRIES"),
    ("cells", '[{"id":"a"}]', "NOT_ONE_OBJECT"), ("cells", None, "NOT_ONE_OBJECT"), ("cells", '{"cells":[', "NOT_ONE_OBJECT"), ("cells", "{} {}", "NOT_ONE_OBJECT"), (None, "{}", "UNKNOWN_ROLE"), ("timeline", '{"checkpoints":["a","\\t"]}', "BLANK_FIELD"),
    ("timeline", '{"checkpoints":["a"],"cells":[]}', "UNKNOWN_FIELD_OR_TYPE"), ("rosetta", '{"x_time":"t","ring":"r","box":"b","arrow":"a"}', ""), ("rosetta", '{"x_time":"t","ring":"r","box":"b"}', "BLANK_FIELD"),
    ("rosetta", '{"x_time":"t","ring":"r","box":"b","arrow":"a","semantic_film_not_video":"yes"}', "UNKNOWN_FIELD_OR_TYPE"), ("transitions", '{"rules":[{"target_cell":"a","from_state":"b","to_state":"c","requires":[{"cell_id":"d","state":"e"}]}]}', ""),
    ("transitions", '{"rules":[{"target_cell":"a","from_state":"b","to_state":"c","requires":null}]}', ""), ("transitions", '{"rules":[{"target_cell":"a","from_state":"b","to_state":"c","requires":[{"state":"e"}]}]}', "BLANK_FIELD"),
    ("transitions", '{"rules":[{"target_cell":"a","from_state":"b"}]}', "BLANK_FIELD"), ("rosetta", '{"box":{"a":"b>, x"}}', "UNKNOWN_FIELD_OR_TYPE"), ("timeline", '{"check points>":["a"]}', "UNKNOWN_FIELD_OR_TYPE"),
])
def test_contracts(spark, role, value, error):
    d = spark.createDataFrame([(role, value)], "role string, value string")
    assert d.select(E.contract_error(F.col("role"), F.col("value"))).first()[0] == error


@pytest.mark.parametrize("answer, want", [
    ('```json\n{"probe_top":" a ","t3":[1,{"b":null}]}\n```', ("", None, "a", '[1,{"b":null}]')), ('```\n{"boot_text":["x"," y"]}', ("", ["x", " y"], "", None)), ('```{"probe_top":"a"}```', ("", None, "a", None)),
    ('so: {"probe_top":"}{","t3":null} {"x":1}', ("", None, "}{", "null")), ("nothing", ("NO_OBJECT", None, None, None)), (None, ("NO_OBJECT", None, None, None)), ('{"probe_top":}', ("NOT_JSON", None, None, None)), ('{"probe_top":1}', ("UNKNOWN_FIELD_OR_TYPE", None, None, None)),
    ('{"boot_text":"x"}', ("UNKNOWN_FIELD_OR_TYPE", None, None, None)), ('{"other":"x"}', ("UNKNOWN_FIELD_OR_TYPE", None, None, None)), ("{}", ("", None, "", None)),
])
def test_strict_observations(spark, answer, want):
    r = spark.createDataFrame([(answer,)], "a string").select(E.parsed_observation(F.col("a")).alias("p")).first()["p"]
    assert (r["error"], r["boot_text"], r["probe_top"], r["t3"]) == want


def plain_ensembles(goals, workers):
    nodes, errors = set(), {}
    for goal, cap, members, fusion, join, quorum in goals:
        cap, fusion, join = ((x or "").strip().upper() for x in (cap, fusion, join))
        join = join or "ALL"
        if join == "QUORUM" and quorum <= 0:
            quorum = members // 2 + 1
        best = lambda c: sorted((-s, p != 0, p, w, r) for w, k, s, p, r in workers if k.strip().upper() == c)
        own, last = best(cap)[:members], best(fusion)[:1]
        error = (
            "CAPABILITY_REQUIRED" if not cap else "TOO_FEW_MEMBERS" if members < 2 else "FUSION_REQUIRED" if not fusion else "UNKNOWN_JOIN" if join not in ("ALL", "ANY", "QUORUM")
            else "QUORUM_ABOVE_MEMBERS" if join == "QUORUM" and quorum > members else "QUORUM_WITHOUT_ITS_JOIN" if join != "QUORUM" and quorum else "NOT_ENOUGH_WORKERS" if len(own) < members
            else "NO_FUSION_WORKER" if not last else "FUSION_NOT_ATOMIC" if last[0][4] else ""
        )
        if error:
            errors[goal] = error
            continue
        names = sorted(x[3] for x in own)
        nodes |= {(goal, "ensemble-member-" + n, n, "TOLERATED", (), "ALL", 0) for n in names}
        nodes.add((goal, "ensemble-fusion", last[0][3], "STRICT", tuple("ensemble-member-" + n for n in names), join, quorum))
    return nodes, errors


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ensembles_as_in_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    workers = [(f"w{i}", rng.choice([" a", "B ", "c", "d"]), rng.randint(0, 2), rng.choice([0, 0, 5, 9]), rng.choice([[], [], ["x"]])) for i in range(14)]
    goals = [(i, rng.choice(["A", "b", "C", "", None]), rng.randint(0, 5), rng.choice(["a", "b", "d", "e", ""]), rng.choice(["", "all", "any", " quorum", "quorum", "most", None]), rng.choice([0, 0, 1, 3])) for i in range(120)]
    g = spark.createDataFrame(goals, "goal int, capability string, members int, fusion_capability string, join_kind string, quorum int")
    w = spark.createDataFrame(workers, "worker string, capability string, score int, params int, requires array<string>")
    nodes, errors = E.ensembles(g, w)
    want = plain_ensembles(goals, workers)
    assert {(*r[:4], tuple(r["depends"]), r["join_kind"], r["needed"]) for r in nodes.collect()} == want[0] and want[0]
    assert {r["goal"]: r["error"] for r in errors.collect()} == want[1]
    assert E.ensembles(g.limit(0), w)[0].count() == 0


def test_exploration_rests_on_the_first_observations(spark):
    queue = spark.createDataFrame([("a", 1), ("b", 2), ("none", 3)], "candidate_id string, place int")
    changes = spark.createDataFrame([("a", "PROMPT"), ("a", "LAYOUT"), ("a", "PROMPT"), ("b", "LAYOUT")], "candidate_id string, mutation string")
    base = spark.createDataFrame([(i, 100 - i // 2, "OBSERVATION" if i % 5 else "CHANGE") for i in range(40)] * 2, "event_id int, ts int, kind string")
    rows = {r["candidate_id"]: r for r in E.exploration_changes(queue, changes, base).collect()}
    first = sorted((100 - i // 2, i) for i in range(40) if i % 5)[:20]
    assert set(rows) == {"a", "b"} and rows["a"]["parents"] == [i for _, i in first]
    assert rows["a"]["tags"] == ["closed-loop", "exploration", "mutation:LAYOUT", "mutation:PROMPT"]
    assert E.exploration_changes(queue, changes, base.where("kind = 'CHANGE'")).count() == 0
