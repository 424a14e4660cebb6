"""The trie of prefixes against a plain version and its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from quarryline.llm import prefix
from quarryline.llm import queries as Q
from quarryline.llm import trie as T
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Rows (conv_id, turn, role, text) to the rows of the contract; equal turn numbers as the operator has them, by hash."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns.setdefault(c, []).append(((turn is not None, turn or 0), mark, role, text))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for path, cs in members.items():
        below = [q for q in members if q[: len(path)] == path]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(path))))
        out.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), sum(len(q) == len(path) + 1 for q in below), len(leaves),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_equals_plain_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = got(Q.op12_preorder_intervals(spark, SF))
    assert found == plain(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert found == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({T.ORACLE.strip()})").fetchall(), key=str)
    spans = {tuple(r) for r in Q.op12_preorder_intervals(spark, SF).select("conv_id", "depth", "start", "end").collect()}
    assert spans == set(con.execute(f'SELECT conv_id, depth, start, "end" FROM ({T.ORACLE.strip()})').fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_prefixes_and_odd_rows(spark, seed):
    """Copies, shared starts, missing bases, ties, nulls, negative ids, and conversations that end where others go on."""
    rng = random.Random(seed)
    rows = []
    for c in [0, 1, 2, 3, 4, 5, 7, 12, 55, 99, 100, 101, 103, 250, 251, 252, 253, 254, -1, -100, -101, -7, 12345678901]:
        for t in range(rng.choice([1, 2, 3, 8])):
            rows.append((c, rng.choice([None, t, t, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é😀"])))
    rows += [(None, 1, "user", "nobody"), (7, 1, "us", "era"), (7, 1, "user", "a"), (12, 0, "", "long " * 20000)]
    rows += [(c, t, "user", f"same {t}") for c in range(600, 640) for t in range(9)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, start string")
    out = T.prefix_trie(df)
    assert got(out) == plain(rows)
    spans = out.select("start", "end", "n_leaves", "depth").collect()
    assert sorted(r["start"] for r in spans) == list(range(1, len(spans) + 1))  # preorder places, and intervals that nest
    for a in spans:
        inside = [b for b in spans if a["start"] <= b["start"] <= a["end"]]
        assert all(b["end"] <= a["end"] and b["depth"] >= a["depth"] for b in inside)
        assert a["n_leaves"] == sum(b["start"] == b["end"] for b in inside)


def test_long_conversations_are_ranked_by_blocks(spark):
    """Conversations of more than 32 and of more than 1,024 turns that part late."""
    rows = [(c, t, "user", "x" if t < n - 1 else last) for c, n, last in ((1, 1100, "p"), (2, 1100, "q"), (3, 1099, "x"), (4, 33, "x"), (5, 32, "x"), (6, 64, "y")) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes, built = T.rebuilt(df)
    order = {r["conv_id"]: r["rank"] for r in T._order_of(built).collect()}
    seqs = {}
    for r in built.orderBy("depth").collect():
        seqs.setdefault(r["conv_id"], []).append(bytes(r["symbol"]))
    want = {tuple(s): k + 1 for k, s in enumerate(sorted(set(map(tuple, seqs.values()))))}
    assert order == {c: want[tuple(s)] for c, s in seqs.items()}
    out = {(r["conv_id"], r["depth"]): r for r in T.prefix_trie(df).collect()}
    assert out[(1, 0)]["n_convs"] == 6 and sum(r["start"] == r["end"] for r in out.values()) == out[(1, 0)]["n_leaves"]


def test_no_conversations(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert got(T.prefix_trie(df.where("false"))) == []
    assert got(T.prefix_trie(spark.createDataFrame([(205, 1, "user", "x")], df.schema))) == plain([(205, 1, "user", "x")])


def test_running_sums_by_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.random(), rng.randint(-5, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k long, o double, v long").repartition(7)
    by_key = {(r["k"], r["o"]): (r["n"], r["s"]) for r in prefix.running(df.where("k is not null"), ["k", "o"], {"n": F.lit(1), "s": F.col("v")}, key="k").collect()}
    for k in (1, 2, 3):
        own = sorted(r for r in rows if r[0] == k)
        assert [by_key[(k, r[1])] for r in own] == [(i + 1, sum(x[2] for x in own[: i + 1])) for i in range(len(own))]
    alone = {r["o"]: r["s"] for r in prefix.running(df, ["o"], {"s": F.col("v")}).collect()}
    own = sorted(rows, key=lambda r: r[1])
    assert [alone[r[1]] for r in own] == [sum(x[2] for x in own[: i + 1]) for i in range(len(own))]
