"""Forms that tables take at size: folders of files, many suppliers, many vectors, questions and claims."""

from __future__ import annotations

import math
import random

import duckdb
from pyspark.sql import functions as F

from quarryline.functions import text
from quarryline.operators import claims, comparison, graphs, retrieval, rules
from quarryline.operators import states as settling
from quarryline.plans import registry, states, streams
from quarryline.plans.inputs import claims as claimed

SF = "/root/testdata/sf0.001"


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = {tuple(r) for r in streams.stream_guard(spark, SF).collect()}
    assert len(want) == d.count() and {tuple(r) for r in streams.stream_guard(spark, str(tmp_path)).collect()} == want


def test_producers_against_loops_and_past_ten_thousand_workers(spark, tmp_path):
    offers = [(w, w % 3, w % 5, (w % 4) * 10) for w in range(60)]
    barred = [("a", w) for w in range(0, 60, 2)] + [("a", 0)] + [("b", w) for w in range(50)]
    requests = [(i, i % 4, i % 5 + 1, i * 3 if i % 6 == 0 else None, [None, "a", "b", "none"][i % 4 if i % 5 else 1]) for i in range(40)]
    want = set()
    for i, product, k, pinned, name in requests:
        able = sorted((-sc, pa != 0, pa, w) for w, p, sc, pa in offers if p == product and (name, w) not in barred and pinned in (None, w))
        want |= {(i, x[3], n + 1) for n, x in enumerate(able[:k])}
    frame = spark.createDataFrame
    got = rules.producers(frame(requests, "request int, product int, k int, pinned int, list string"), frame(offers, "worker int, product int, score int, params int"), frame(barred, "list string, worker int"))
    assert {tuple(r) for r in got.collect()} == want
    # a supplier beyond 10,506 is barred as any other
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{SF}/supplier.parquet").selectExpr("s_suppkey + 70000 AS s_suppkey", "s_nationkey", "s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert {tuple(r) for r in registry.QUERIES["producer_choice"](spark, str(tmp_path)).collect()} == set(con.execute(registry.ORACLES["producer_choice"]).fetchall())


def test_best_cosine_of_odd_vectors_against_loops(spark):
    vectors = [(i, i % 3 if i % 5 else None, [math.sin(i + j) for j in range(4)]) for i in range(50)]
    vectors += [(50, 1, None), (60, 1, [1.0, None, 0.0, 0.0]), (70, 2, [0.0] * 4), (80, 2, [1.0, 2.0]), (20, 0, [1.0, 0.0, 0.0, 0.0]), (81, 7, [1.0, 2.1]), (None, 9, [1.0, 1.0]), (82, 1, [])]

    def cosine(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return 0.0
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0

    want = {}
    for i, _, q in vectors:
        for j, label, v in vectors:
            if i is not None and i % 10 == 0 and j is not None and i != j:
                want[i, label] = max(want.get((i, label), 0.0), cosine(q, v))
    rows = spark.createDataFrame(vectors, "id int, label int, v array<double>")
    for sizes in ((8192, 16384), (7, 2)):
        got = {(r["id"], r["label"]): r["best"] for r in comparison.best_cosine(rows.where("id % 10 = 0").select("id", "v"), rows, *sizes).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_claims_are_not_dealt_out_by_their_few_predicates(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "4k")  # less than the table that the policies are read from, more than the policies
    try:
        plan = claims.governed(claimed(spark, SF), states.policies(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_best_overlap_counts_in_cells_and_makes_no_row_a_pair(spark):
    asked = [(q, f"t{(q * 7 + i) % 40}") for q in range(30) for i in range(6)] + [(99, "nowhere"), (98, None)]
    pages = [(p, f"t{(p * p + 3 * i) % 40}") for p in range(100) for i in range(9)] + [(None, "t1"), (100, None)]
    pages = sorted(set(pages), key=str)
    want = set()
    for q in range(30):
        counts = {}
        for p, t in pages:
            if p is not None and (q, t) in asked:
                counts[p] = counts.get(p, 0) + 1
        top = max(counts.values())
        want.add((q, min(p for p in counts if counts[p] == top), top))
    ask, held = spark.createDataFrame(asked, "question int, term string"), spark.createDataFrame(pages, "page long, term string")
    for block, at_once in ((1_000_000, 8192), (50, 7)):
        found = comparison.best_overlap(ask, held, block, at_once)
        assert {tuple(r) for r in found.collect()} == want
    assert "page" not in str([x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "HashAggregate(keys=[page" in x])


def test_fixpoints_send_no_table_of_cells_through_the_driver(spark, monkeypatch):
    plans = []

    def spy(module):
        write = module.written

        def noted(df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, name)

        monkeypatch.setattr(module, "written", noted)

    spy(graphs)
    spy(settling)
    frame = spark.createDataFrame
    cells, rule, need = frame([("A", "OFF"), ("B", "OFF")], "cell string, state string"), frame([("r", "A", "OFF", "ON"), ("s", "B", "OFF", "ON")], "rule string, target string, from_state string, to_state string"), frame([("s", "A", "ON")], "rule string, cell string, state string")
    assert {tuple(r) for r in graphs.rule_fixpoint(cells, rule, need).collect()} == {("A", "ON"), ("B", "ON")}
    done, errors = settling.settled(*[x.selectExpr("1 AS key", "*") for x in (cells, rule, need)])
    assert {tuple(r) for r in done.collect()} == {(1, "A", "ON"), (1, "B", "ON")} and errors.isEmpty()
    assert plans and not any("Broadcast" in p for p in plans)


def test_rounds_of_levels_leave_alone_what_nothing_has_come_to(spark, monkeypatch):
    # a comb: node i needs i - 1 and a source of its own, so a round does one node and the others wait
    nodes = [(i, 1) for i in range(12)] + [(100 + i, 1) for i in range(12)]
    edges = [(i - 1, i) for i in range(1, 12)] + [(100 + i, i) for i in range(1, 12)] + [(200, 201), (201, 200), (0, 201), (7, 200)]
    seen = []
    read = graphs.new_path
    monkeypatch.setattr(graphs, "new_path", lambda s, name: seen.append(read(s, name)) or seen[-1])
    n, e = spark.createDataFrame([*nodes, (200, 1), (201, 1)], "node long, cost long"), spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in graphs.levels(n, e).collect()} == {(i, i) for i in range(12)} | {(100 + i, 0) for i in range(12)}
    # a node waits from the first round on, with its own source done, and one that nothing has come to is in no round
    written = spark.read.parquet(seen[-1])
    assert written.where("done = 1").count() == 24 and written.where("node = 5 AND done = 0").count() == 4 and written.where("done = 0 AND came = 0").isEmpty()


def test_goals_meet_each_worker_once_by_levels(spark, monkeypatch):
    # worker i needs i - 1 and i - 2: each is reached at many depths, the least of which counts
    needs = [(i, i - j) for i in range(2, 14) for j in (1, 2)] + [(50, 51), (51, 50)]
    makers = [(i, i, 0) for i in range(14)] + [(50, 50, 0), (51, 51, 0)]
    frame = spark.createDataFrame
    sides = frame(needs, "worker long, product long"), frame(makers, "product long, worker long, rank int")
    want = {(g, w, -((w - p) // 2)) for g, p in (("a", 13), ("b", 8), ("c", 1)) for w in range(p + 1) if p > 1 or w == p}
    added, add = [], graphs.Pairs.add
    monkeypatch.setattr(graphs.Pairs, "add", lambda self, df: added.append(df._jdf.queryExecution().executedPlan().toString()) or add(self, df))
    for few in (500_000, 0):
        monkeypatch.setattr(graphs, "FEW_LINKS", few)
        found = graphs.resolved(frame([("a", 13), ("b", 8), ("c", 1)], "goal string, product long"), *sides)
        assert {(r["goal"], r["worker"], r["depth"]) for r in found.collect()} == want
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        rounds = [p for p in added if "EqualTo(at," in p]
        added.clear()
        assert rounds and all(("Exchange hashpartitioning" in p) == (few == 0) for p in rounds)


def test_failures_spread_along_links_that_stay_where_they_are(spark, monkeypatch):
    plans, write = [], settling.Rounds.write
    monkeypatch.setattr(settling.Rounds, "write", lambda self, df, n: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df, n))
    frame = spark.createDataFrame
    nodes = frame([("p", i, "ALL" if i < 4 else "ANY", 0, i in (0, 7)) for i in range(8)], "plan string, node long, join_kind string, quorum int, fails boolean")
    edges = frame([("p", i, i + 1, False) for i in range(5)] + [("p", 7, 4, False), ("p", 6, 5, True), ("p", 5, 7, False)], "plan string, src long, dst long, tolerated boolean")
    got = {r["node"]: r["state"] for r in settling.spread(nodes, edges).collect()}
    # node 4 takes any of two, both of which die, one long after the other; 5 has one that it can do without; 7 fails by itself
    assert got == {0: "FAILED", 1: "BLOCKED", 2: "BLOCKED", 3: "BLOCKED", 4: "BLOCKED", 5: "COMPLETED", 6: "COMPLETED", 7: "FAILED"}
    assert len(plans) > 3 and all("Bucketed: true" in p for p in plans)


def test_a_pair_of_terms_is_counted_once_and_the_graph_made_once(spark, monkeypatch):
    made, graph = [], retrieval.term_graph
    monkeypatch.setattr(retrieval, "term_graph", lambda *a: made.append(graph(*a)) or made[-1])
    posting = spark.createDataFrame([(b, f"t{t}") for b in range(20) for t in range(9) if (b * 7 + t * t) % 3], "block_id long, term string")
    want = {}
    rows = {(r["block_id"], r["term"]) for r in posting.collect()}
    for b, t in rows:
        for c, u in rows:
            if b == c and t != u:
                want[t, u] = want.get((t, u), 0) + 1
    found = graph(posting, neighbours=99)
    assert {(r["src"], r["dst"]): r["weight"] for r in found.collect()} == want
    assert "src#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and " < dst#" in plan
    near = registry.QUERIES["graph_neighbours"](spark, SF)
    assert len(made) == 1 and "collect_list" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_passages_do_not_follow_the_vectors_through_shuffles(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")  # as tables are at size
    try:
        plan = registry.QUERIES["answer_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 4


def test_runs_of_words_are_told_by_numbers_and_texts_split_once(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(9)))) for i in range(60)]
    texts += [(7, "a b c a b c"), (None, "a b c d"), (100, None), (101, ""), (102, " a b  c d "), (103, "a bñ c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    runs = lambda s, n: list(dict.fromkeys(tuple(w[i : i + n]) for w in [(s or "").split(" ")] for i in range(len(w) - n + 1)))
    asked = [(1, "a b c d"), (2, "c c"), (3, ""), (4, "a bñ c"), (5, "g f e d c b a"), (6, "x y z")]
    for n in (1, 2, 3):
        items = [(i, [" ".join(r) for r in runs(t, n) if all(r)]) for i, t in asked]
        want = {}
        for d, body in texts:
            own = {" ".join(r) for r in runs(body, n)}
            for i, t in items:
                want[i, d] = want.get((i, d), 0) + len(own & set(t))
        totals = {i: len(t) for i, t in items}
        want = {(i, d, k, totals[i]) for (i, d), k in want.items() if totals[i] and k / totals[i] >= 0.3}
        for block in (1_000_000, 2):
            found = comparison.contained_runs(docs, spark.createDataFrame(items, "item_id long, t array<string>"), 0.3, n, block)
            assert {tuple(r)[:4] for r in found.select("item_id", "doc_id", "shared", "total").collect()} == want
    none = spark.createDataFrame([], "item_id long, t array<string>")
    assert comparison.contained_runs(docs, none, 0.3).isEmpty()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(registry.QUERIES["trigram_contamination"](spark, SF)).count(r"\p{L}") == 1
    made = docs.select("doc_id", text.trigrams(F.col("text")).alias("t"))
    assert plan(made).count(r"\p{L}") == 1
    few = spark.createDataFrame([(1, ["a b c"])], "item_id long, t array<string>")
    assert plan(comparison.contained(made, few, 0.5)).count(r"\p{L}") == 1


def test_errors_of_plans_against_loops_without_tables_by_key(spark):
    rng = random.Random(8)
    names = lambda: rng.choice([0, 1, 2, 3, 4, 5, None])
    nodes = [(rng.choice([1, 2, None]), names(), rng.choice([-1, 0, 1, 2, 3, None])) for _ in range(14)]
    edges = [(rng.choice([1, 2, 3, None]), names(), names()) for _ in range(24)]
    edges += edges[:6]
    bindings = [(rng.choice([1, 2, None]), names(), names()) for _ in range(12)]
    bindings += bindings[:3]
    want = set()
    for plan, node, _ in nodes:
        quorums = [q for p, x, q in nodes if (p, x) == (plan, node)]
        quorum = max((q for q in quorums if q is not None), default=None)
        deps = len({s for p, s, d in edges if (p, d) == (plan, node)}) if None not in (plan, node) else 0
        if len(quorums) > 1:
            want.add((plan, node, "DUPLICATE"))
        if quorum is not None and (quorum <= 0 or quorum > deps):
            want.add((plan, node, "QUORUM_TOO_SMALL" if quorum <= 0 else "QUORUM_TOO_LARGE"))
    for plan, src, dst in edges:
        if None in (plan, src) or not any(n[:2] == (plan, src) for n in nodes):
            want.add((plan, dst, "UNKNOWN_DEPENDENCY"))
        if src is not None and src == dst:
            want.add((plan, dst, "OWN_DEPENDENCY"))
    unbound = {(p, n, "UNBOUND_INPUT") for p, n, s in bindings if None in (p, n, s) or (p, s, n) not in edges}
    frame = spark.createDataFrame
    sides = frame(nodes, "plan int, node long, quorum int"), frame(edges, "plan int, src long, dst long")
    found = graphs.plan_errors(*sides)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    both = graphs.plan_errors(*sides, frame(bindings, "plan int, node long, source long")).collect()
    assert sorted(map(tuple, both), key=str) == sorted(want | unbound, key=str)
    # a task sorts its rows and holds no table of them
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in registry.QUERIES["plan_errors"](spark, SF)._jdf.queryExecution().executedPlan().toString()
