"""Tiles of a band hold every pair of nodes of two roots once, and a large root's nodes as often as there are other blocks."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from quarryline.llm import neardup


@pytest.mark.parametrize("others", [1, 40])
def test_tiles_hold_all_pairs_of_two_roots(spark, monkeypatch, others):
    monkeypatch.setattr(neardup, "BLOCK", 50)
    rng = random.Random(others)
    rows = [(7, node, rng.randrange(1, 9), 1) for node in range(300)] + [(7, 1000 + k, 5, 2 + k % 5) for k in range(others)] + [(8, node, 4, node) for node in range(5)] + [(9, node, 4, 1) for node in range(90)]
    df = spark.createDataFrame(rows, "band long, node long, n long, root long")
    tiles = defaultdict(list)
    sent = Counter()
    for r in neardup._tiles(neardup._open(df)).collect():
        tiles[r["band"], r["low"], r["high"]].append((r["node"], r["block"]))
        sent[r["band"], r["node"]] += 1
    root = {(band, node): r for band, node, _, r in rows}
    pairs = Counter()
    for (band, low, high), own in tiles.items():
        for i, (a, x) in enumerate(own):
            for b, y in own[:i]:
                if (low == high or x != y) and root[band, a] != root[band, b]:
                    pairs[band, min(a, b), max(a, b)] += 1
    want = {(band, a, b) for band, a in root for other, b in root if band == other and a < b and root[band, a] != root[band, b]}
    assert set(pairs) == want and set(pairs.values()) == {1}
    assert all(sent[7, node] == -(-others * 5 // 50) for node in range(300)) and not any(band == 9 for band, _ in sent)


def test_classes_are_the_same_with_small_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 300)
    monkeypatch.setattr(neardup, "GROUP", 2_000)
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()} == want
