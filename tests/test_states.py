"""States that spread, settle, are reviewed, retried and patched; fusion by policy; JSON inside texts."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.operators import checks as K
from quarryline.operators import claims as C
from quarryline.operators import states as S


def plain_spread(nodes, edges):
    """States by going over all nodes until nothing changes."""
    deps = {}
    for plan, src, dst, tolerated in set(edges):
        deps.setdefault((plan, dst), []).append(((plan, src), tolerated))
    dead, blocked = {n[:2] for n in nodes if n[4]}, set()
    while True:
        before = len(dead), len(blocked)
        for plan, node, kind, quorum, _ in nodes:
            d = deps.get((plan, node), [])
            bad = sum(s in dead and not t for s, t in d)
            needed = 0 if not d else len(d) if kind == "ALL" else 1 if kind == "ANY" else quorum if quorum > 0 else len(d) // 2 + 1
            if len(d) - bad < needed:
                blocked.add((plan, node))
                dead.add((plan, node))
        if before == (len(dead), len(blocked)):
            return {n[:2]: "BLOCKED" if n[:2] in blocked else "FAILED" if n[4] else "COMPLETED" for n in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_failures_spread_as_in_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    nodes, edges = [], []
    for plan in ("p", "q"):  # both plans have nodes of the same names
        for i in range(30):
            nodes.append((plan, i, rng.choice(["ALL", "ANY", "QUORUM"]), rng.choice([0, 1, 2, 9]), rng.random() < 0.25))
            edges += [(plan, s, i, rng.random() < 0.3) for s in rng.sample(range(i), min(i, rng.randint(0, 3)))]
    edges.append(("p", 29, 28, False))  # a cycle
    edges.append(("p", 28, 29, False))
    n = spark.createDataFrame(nodes, "plan string, node int, join_kind string, quorum int, fails boolean")
    e = spark.createDataFrame(edges, "plan string, src int, dst int, tolerated boolean")
    assert {(r["plan"], r["node"]): r["state"] for r in S.spread(n, e).collect()} == plain_spread(nodes, edges)


def test_a_run_tolerates_what_its_nodes_do(spark):
    states = spark.createDataFrame([("p", 1, "FAILED"), ("p", 2, "BLOCKED"), ("q", 1, "FAILED"), ("r", 1, "COMPLETED")], "plan string, node int, state string")
    nodes = spark.createDataFrame([("p", 1, " tolerated"), ("p", 2, "TOLERATED"), ("q", 1, None), ("r", 1, "")], "plan string, node int, policy string")
    assert {tuple(r) for r in S.run_verdicts(states, nodes).collect()} == {("p", True, 1, 1), ("q", False, 1, 0), ("r", True, 0, 0)}
    with pytest.raises(Exception, match="unsupported failure policy: LAX"):
        S.run_verdicts(states, nodes.withColumn("policy", F.lit("lax"))).collect()


def systems(spark, cells, rules, requires, **more):
    done, errors = S.settled(
        spark.createDataFrame(cells, "key string, cell string, state string"), spark.createDataFrame(rules, "key string, rule string, target string, from_state string, to_state string"),
        spark.createDataFrame(requires, "key string, rule string, cell string, state string"), **more,
    )
    return {tuple(r) for r in done.collect()}, {tuple(r) for r in errors.collect()}


def test_each_system_settles_or_fails_by_itself(spark):
    cells = [(k, c, "0") for k in "abcdef" for c in "XY"] + [("e", "X", "1"), ("g", "X", "0")]
    rules = [
        ("a", "r1", "X", "0", "1"), ("a", "r2", "Y", "0", "1"),  # one after the other
        ("b", "r1", "X", "0", "1"), ("b", "r2", "X", "0", "2"),  # both at once
        ("c", "r1", "Z", "0", "1"), ("d", "r1", "X", "0", "1"), ("d", "r2", "X", "1", "0"), ("f", "r1", "X", "0", "0"), ("f", "r2", "Y", "0", "1"),
    ]
    requires = [("a", "r2", "X", "1"), ("f", "r2", "Y", "0"), ("f", "r2", "X", "0")]
    done, errors = systems(spark, cells, rules, requires, most=5)
    assert errors == {("b", "CONFLICTING_WRITES"), ("c", "UNKNOWN_CELL"), ("d", "NOT_SETTLED"), ("e", "DUPLICATE_CELL")}
    assert done == {("a", "X", "1"), ("a", "Y", "1"), ("f", "X", "0"), ("f", "Y", "1"), ("g", "X", "0")}
    assert systems(spark, [], [], []) == (set(), set())


def test_consensus(spark):
    votes = [("a", 1, "x", True), ("a", 1, "x", True), ("a", 1, "y", True), ("b", 1, "x", True), ("b", 1, "y", True), ("c", 1, "x", True), ("c", 1, "x", False), ("d", 1, "x", True)]
    got = {tuple(r) for r in S.consensus(spark.createDataFrame(votes, "k string, n int, value string, valid boolean"), ["k", "n"]).collect()}
    assert got == {("a", 1, "CONFIRMED", "x", 2, 2), ("b", 1, "UNKNOWN", None, 1, 2), ("c", 1, "UNKNOWN", None, 0, 2), ("d", 1, "CONFIRMED", "x", 1, 1)}


SUBJECT = "subject int, capability string, risk int, args map<string,string>, max_risk int, allowed array<string>, roots array<string>, verdict string, answer string, evidence string"


def test_a_block_wins_and_notes_do_not_count(spark):
    rows = [
        (1, "READ", 1, {"p": "/data/x"}, 3, ["READ"], ["/data/"], "ANSWERED", "it is 12.", "12 or 13"), (2, "READ", 5, {"p": "/etc/x", "q": "plain"}, 3, [], ["/data"], "DEFERRED", "in 1999", "never"),
        (3, None, None, None, None, [], [], None, None, None), (4, "READ", None, {}, 3, ["MOVE"], ["/d"], None, "", "x"), (5, "READ", 1, {"p": "/data/../etc"}, 3, [], ["/data"], None, "1,5 and 7", "1,5"), (6, "READ", 1, {"p": "/database"}, None, [], ["/data"], None, None, None),
    ]
    subjects = spark.createDataFrame(rows, SUBJECT)
    seen = spark.createDataFrame([(1, "k", "a"), (1, "k", "a"), (2, "k", "a"), (2, "k", "b")], "subject int, key string, value string")
    got = {r["subject"]: tuple(r)[1:] for r in S.reviewed(subjects, S.concerns(subjects, seen)).collect()}
    assert got[1] == ("CLEAR", "", "", 0, 0)
    assert got[2] == ("BLOCKED", "permission-sentinel", "risk_over_ceiling", 5, 5)
    assert got[3] == ("CLEAR", "", "", 1, 0)
    assert got[4] == ("BLOCKED", "permission-sentinel", "capability_not_allowed", 2, 2)
    assert got[5] == ("BLOCKED", "scope-sentinel", "path_out_of_scope", 1, 1) and got[6] == ("BLOCKED", "scope-sentinel", "path_out_of_scope", 1, 1)
    warned = S.reviewed(subjects, S.concerns(subjects, seen).where("severity <> 'BLOCK'")).where("subject = 2").first()
    assert (warned["verdict"], warned["decided_by"]) == ("WARNED", "conflict-sentinel")


def test_retries_are_kept_whole_or_not_at_all(spark):
    a = "trial string, question int, pass boolean"
    first = [("t", 1, True), ("t", 2, False), ("t", 3, None), ("u", 1, True), ("u", 2, False), ("v", 1, True), ("v", 2, True), ("v", 3, True), ("w", 1, False), ("w", 2, False), ("w", 3, True), ("x", 1, True), ("x", 2, True), ("x", 3, False), ("v", 9, False)]
    second = [("t", 2, True), ("t", 3, False), ("t", 1, False), ("w", 1, True), ("w", 2, None), ("x", 2, True), ("u", 2, True)]
    got = {tuple(r) for r in S.retried(spark.createDataFrame([(t,) for t in "tuvwx"], "trial string"), spark.createDataFrame(first, a), spark.createDataFrame(second, a), spark.createDataFrame([(1,), (2,), (3,)], "question int")).collect()}
    kept = {(t, q, bool(p), False) for t, q, p in first if t in "tvwx" and q < 4}
    assert got == kept | {("t", 2, True, True), ("t", 3, False, True)}  # w answers one of two, x none of one, u wasn't complete


def test_patches_keep_places_and_append(spark):
    schema = "g string, place int, id string, text string"
    sections = spark.createDataFrame([("a", 1, "x", "1"), ("a", 2, "y", "2"), ("a", 3, "x", "3"), ("b", 5, "y", "4")], schema)
    patches = spark.createDataFrame([("a", 1, "z", "n1"), ("a", 2, "x", "n2"), ("a", 3, "w", "n3"), ("a", 4, "z", "n4"), ("c", 1, "q", "n5"), ("b", 1, "y", "no")], schema)
    shields = spark.createDataFrame([("b", "y")], "g string, id string")
    got = sorted(tuple(r) for r in S.patched(sections, patches, ["g"], ["text"], shields).collect())
    assert got == [("a", 1, "x", "n2"), ("a", 2, "y", "2"), ("a", 3, "x", "3"), ("a", 4, "z", "n4"), ("a", 5, "w", "n3"), ("b", 5, "y", "4"), ("c", 1, "q", "n5")]
    again = S.patched(spark.createDataFrame(got, schema), patches, ["g"], ["text"], shields)
    assert sorted(tuple(r) for r in again.collect()) == got


def test_protection_keeps_what_is_there(spark):
    rules = spark.createDataFrame([("p", 1, "AVOID", "m1", "a"), ("p", 2, "PRESERVE", "m1", "b"), ("p", 3, "PRESERVE", "m1", "a")], "plan string, place int, kind string, target string, reason string")
    modules = spark.createDataFrame([("p", "m1", True), ("p", "m2", True), ("p", "m3", True), ("p", "m4", False), ("q", "m1", True)], "plan string, module string, protected boolean")
    targets = spark.createDataFrame([("p", "m3"), ("q", None)], "plan string, own string")
    got = {tuple(r) for r in S.protected(rules, modules, targets).collect()}
    why = "protected by prompt genome"
    assert got == {("p", "AVOID", "m1", "a"), ("p", "PRESERVE", "m1", "b"), ("p", "PRESERVE", "m2", why), ("q", "PRESERVE", "m1", why)}


CLAIM = "candidate_id string, subject string, predicate string, object string, polarity boolean, confidence double, address string"


def test_fusion_by_policy_equals_the_two_fusions(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", f"S{rng.randint(0, 5)}", rng.choice(["One", "many ", "other"]), f" o{rng.randint(0, 2)}", rng.random() < 0.8, rng.random(), f"a{i % 7}") for i in range(200)]
    claims = spark.createDataFrame(rows, CLAIM)
    policies = spark.createDataFrame([(" ONE", "one", None), ("MANY", None, " exact")], "predicate string, cardinality string, fusion string")
    got = C.fused_by_policy(claims, policies)
    exact = {tuple(r) for r in C.fused_exact(claims).where("p <> 'one'").select("s", "p", "o", "status", "n", "confidence", "first_id", "evidence").collect()}
    assert {tuple(r) for r in got.where("fusion = 'EXACT'").select("s", "p", "o", "status", "n", "confidence", "first_id", "evidence").collect()} == exact
    single = {tuple(r) for r in C.fused_single(claims).where("p = 'one'").select("s", "p", "o", "status", "values", "n", "first_id").collect()}
    assert {tuple(r) for r in got.where("fusion = 'SINGLE_VALUE'").select("s", "p", "o", "status", "values", "n", "first_id").collect()} == single
    sides = {(r["s"], r["p"]): r["n"] for r in C.conflict_members(claims, policies).groupBy("s", "p").agg(F.count("*").alias("n")).collect()}
    clash = {(r["s"], r["p"]): r["n"] for r in got.where("status = 'CONFLICT'").groupBy("s", "p").agg(F.sum("n").alias("n")).collect()}
    assert sides == clash and clash


@pytest.mark.parametrize(("rows", "message"), [([(" ", None, None)], "without a predicate"), ([("a", "two", None)], "unknown cardinality"), ([("a", None, "sum")], "unknown fusion"), ([("a", None, None), ("A ", "ONE", None)], "two policies")])
def test_bad_policies_raise(spark, rows, message):
    with pytest.raises(Exception, match=message):
        C.policy_rows(spark.createDataFrame(rows, "predicate string, cardinality string, fusion string")).collect()


def plain_objects(text):
    out, depth, quoted, head, i = [], 0, False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 2
            continue
        if depth and c == '"':
            quoted = not quoted
        elif c == "{" and not quoted:
            head = i if not depth else head
            depth += 1
        elif c == "}" and not quoted and depth:
            depth -= 1
            if not depth:
                out.append(text[head : i + 1])
        i += 1
    return out


values = st.recursive(st.none() | st.integers(-5, 5) | st.text('{}"\\ab\n', max_size=6), lambda v: st.lists(v, max_size=2) | st.dictionaries(st.text('k{}"', max_size=3), v, max_size=2), max_leaves=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text('so "} \\x\n', max_size=8), st.dictionaries(st.text("ab", max_size=2), values, max_size=3), st.text('{"}\\ \n', max_size=6)), min_size=10, max_size=20))
def test_objects_equal_a_plain_scan(spark, parts):
    deep: object = 1
    for i in range(12):
        deep = {f"k{i}": deep, 's"}': "{" * i}
    texts = [a.replace("{", "") + json.dumps(d) + b for a, d, b in parts] + [f"so: {json.dumps(deep)} and {{", None, "", "{", "}{", '{"a":1} {"b":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    for r in df.select("t", K.json_objects(F.col("t")).alias("all"), K.json_object(F.col("t")).alias("one"), K.json_between(F.col("t")).alias("whole")).collect():
        assert (r["all"] or []) == plain_objects(r["t"] or "")
        if r["one"]:
            assert r["one"] in r["all"] and isinstance(json.loads(r["one"]), dict)
        if r["t"] == f"so: {json.dumps(deep)} and {{":
            assert json.loads(r["one"]) == deep
        if r["t"] == '{"a":1} {"b":2}':
            assert r["one"] == '{"a":1}' and r["whole"] is None


def test_observations_and_evidence(spark):
    df = spark.createDataFrame([('ok {"b": 1, "a":{"x":"}"}} .',), (' no "json"\there\n',), ("{a}",), ("Alpha_1, beta: ALPHA_1 Ünder",)], "t string")
    got = [tuple(r) for r in df.select(K.structured_observation(F.col("t")), K.normal_evidence(F.col("t"))).collect()]
    assert got[0][0] == '{"a":{"x":"}"},"b":1}' and json.loads(got[1][0]) == 'no "json"\there' and json.loads(got[2][0]) == "{a}"
    assert got[3][1] == "ALPHA_1 BETA ÜNDER"
