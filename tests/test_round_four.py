"""What rounds over plans send, and the whole of a term's neighbours."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import graphs, retrieval
from quarryline.plans import registry
from quarryline.plans.retrieval import TERMS


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that the graph operators write."""
    noted = []
    for name in ("written", "bucketed"):
        write = getattr(graphs, name)
        monkeypatch.setattr(graphs, name, lambda df, *a, write=write: noted.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    add = graphs.Pairs.add
    monkeypatch.setattr(graphs.Pairs, "add", lambda self, df: noted.append(df._jdf.queryExecution().executedPlan().toString()) or add(self, df))
    return noted


def test_levels_send_no_table_of_nodes_through_the_driver(spark, plans):
    n = spark.createDataFrame([(i, 1) for i in range(30)], "node long, cost long")
    e = spark.createDataFrame([(i // k, i) for i in range(1, 20) for k in (2, 3)] + [(i, i + 1) for i in range(19, 29)], "src long, dst long")
    done = graphs.levels(n, e)
    want = {0: 0}
    for i in range(1, 30):
        want[i] = 1 + (max(want[i // 2], want[i // 3]) if i < 20 else want[i - 1])
    assert {r["node"]: r["level"] for r in done.collect()} == want
    assert len(plans) > 6 and not any("Broadcast" in p for p in [*plans, done._jdf.queryExecution().executedPlan().toString()])


def test_goals_send_no_table_of_nodes_through_the_driver(spark, plans, monkeypatch):
    monkeypatch.setattr(graphs, "FEW_LINKS", 0)  # as levels of many links are, and much that is there already
    frame = spark.createDataFrame
    needs, makers = frame([(i, i // k) for i in range(2, 14) for k in (2, 3)], "worker long, product long"), frame([(i, i, 0) for i in range(14)], "product long, worker long, rank int")
    found = graphs.resolved(frame([("a", 13), ("b", 5)], "goal string, product long"), needs, makers, frame([(1,), (0,), (None,)], "product long"))
    want = {("a", 13, 0), ("a", 6, 1), ("a", 4, 1), ("a", 3, 2), ("a", 2, 2), ("b", 5, 0), ("b", 2, 1)}
    assert {tuple(r) for r in found.collect()} == want
    assert not any("Broadcast" in p for p in [*plans, found._jdf.queryExecution().executedPlan().toString()])


def near(rows, starts, depth):
    """(start, term, depth, df) by plain loops over blocks."""
    out, df = set(), {}
    for _, terms in rows:
        for t in terms:
            df[t] = df.get(t, 0) + 1
    for s in starts:
        seen = {s: 0}
        for d in range(1, depth + 1):
            for t in {t for b, terms in rows if b is not None and seen.keys() & terms for t in terms} - seen.keys():
                seen[t] = d
        out |= {(s, t, d, df[t]) for t, d in seen.items() if d}
    return out


def test_neighbours_of_a_term_are_all_that_share_a_block(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, {f"t{rng.randint(5 * (i // 6), 5 * (i // 6) + 8)}" for _ in range(4)}) for i in range(60)] + [(60, set()), (61, {"alone"}), (None, {"t1", "t2", "t50"})]
    lists = spark.createDataFrame([(b, sorted(t)) for b, t in rows], "block_id long, terms array<string>")
    starts = ["t1", "t20", "alone", "nowhere", *[f"t{i}" for i in range(30)]] + [f"x{i}" for i in range(40)]
    for depth, few, first in ((1, 9, 9), (2, 500_000, 512), (3, 0, 2)):
        monkeypatch.setattr(retrieval, "FEW_BLOCKS", few)
        monkeypatch.setattr(retrieval, "FIRST_TERMS", first)
        own = starts if depth == 3 else starts[:6]
        found = retrieval.spread(lists, retrieval.term_graph(lists, None, None, None, own), own, depth)
        got = [tuple(r) for r in found.collect()]
        assert set(got) == near(rows, set(own), depth) and len(got) == len(set(got))


def test_graph_neighbours_drops_no_term_of_a_text_and_no_partner(spark, tmp_path):
    # more terms than 512, texts of more than 64 terms, terms of more than 8 partners, and links of least weight
    texts = [" ".join([TERMS[i % 3], *[f"w{100 + (i * 37 + j) % 700}" for j in range(70 + i)]]) for i in range(9)] + ["zeta w250 omega", "omega psi", TERMS[4]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")}).write.parquet(f"{tmp_path}/documents.parquet")
    want = near([(i, set(t.split(" "))) for i, t in enumerate(texts)], TERMS, 2)
    assert len(want) > 1000 and {tuple(r) for r in registry.QUERIES["graph_neighbours"](spark, str(tmp_path)).collect()} == want
