"""The fits of the quality rules and of the ranking against plain loops over their definitions."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import ngram_lm, ranking, rules

SF = "/root/testdata/sf0.01"


def expected_path(n):
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def counts(tables):
    """Each document's counts, and the quality of those that have one."""
    rows = tables[0].select("doc_id", "text").collect()
    own = rules.counted(pa.array([r["text"] for r in rows], pa.string()))
    quality = {}
    for r in tables[1].collect():
        if r["quality"] is not None:
            quality[r["doc_id"]] = min(r["quality"], quality.get(r["doc_id"], 9))
    return [r["doc_id"] for r in rows], own, quality


@pytest.mark.parametrize("n, ties", [(200, False), (130, True), (1, False)])
def test_forest_scores_equal_walks_through_its_trees(n, ties):
    """With samples of all rows, every leaf's length follows from the rows that reach it, and a score from the lengths."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3))
    if ties:
        x = np.round(x)
    x[:, 2] = 5.0  # a column that no tree can split
    trees = 10
    f = rules.grown(x, trees=trees, rows=256)
    deepest = max(1, math.ceil(math.log2(max(n, 2))))
    paths = [0.0] * n
    for t in range(trees):
        waiting = [(0, list(range(n)), 0)]
        while waiting:
            node, here, depth = waiting.pop()
            on, split = int(f.feature[t, node]), float(f.split[t, node])
            if on < 0:
                same = all(len({float(x[i, k]) for i in here}) == 1 for k in range(3))
                assert depth == deepest or len(here) == 1 or same
                for i in here:
                    paths[i] += depth + expected_path(len(here))
                continue
            left, right = [i for i in here if x[i, on] < split], [i for i in here if x[i, on] >= split]
            assert left and right and on != 2
            waiting += [(2 * node + 1, left, depth + 1), (2 * node + 2, right, depth + 1)]
    want = [2.0 ** -(p / trees / max(expected_path(n), 1e-9)) for p in paths]
    assert np.allclose(f.scores(x), want, rtol=1e-12)


def test_thresholds_and_verdicts_equal_a_search_over_all_labelled_rows(spark, tables, counts):
    docs, labels = tables
    ids, own, quality = counts
    stats = docs.select("doc_id", rules.rule_stats("text").alias("stats"))
    detector = rules.fitted(stats, labels)
    passes = [own[i, 0] >= 50 and 100 * own[i, 4] <= 50 * own[i, 0] for i in range(len(ids))]
    part = detector.parts(own)
    known = [i for i in range(len(ids)) if passes[i] and ids[i] in quality]
    n_good = sum(quality[ids[i]] != 0 for i in known)
    for k, threshold in enumerate(detector.thresholds):
        def gain(t, k=k):
            bad = sum(quality[ids[i]] == 0 and part[i, k] >= t for i in known)
            good = sum(quality[ids[i]] != 0 and part[i, k] >= t for i in known)
            return bad - 10 * good if good <= max(0.001 * n_good, 2) else -math.inf
        best = max(gain(t / 4096) for t in {int(part[i, k] * 4096) for i in known} | {4096})
        assert gain(threshold) == best if best > 0 else threshold == math.inf
    verdict = {}
    for i, d in enumerate(ids):
        verdict[d] = bool(passes[i] and all(part[i, k] < t for k, t in enumerate(detector.thresholds)))
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(docs, labels).select("doc_id", "kept").collect()}
    assert got == verdict and 0 < sum(verdict.values()) < sum(passes)


def test_ranking_weights_are_where_the_loss_is_least(counts):
    """The loss is convex, so weights that no small step betters are the best ones."""
    ids, own, quality = counts
    at = [i for i, d in enumerate(ids) if d in quality]
    label = np.array([quality[ids[i]] for i in at])
    pairs, ridge = 3_000, 1e-3
    model = ranking.learned(own[at], label, seed=5, pairs=pairs, ridge=ridge)
    z = np.clip((ranking.features(own[at]) - model.middle) / model.scale, -8, 8)
    rng = np.random.default_rng(5)
    good, bad = rng.choice(np.flatnonzero(label == 1), pairs), rng.choice(np.flatnonzero(label == 0), pairs)

    def loss(w):
        total = 0.0
        for g, b in zip(good.tolist(), bad.tolist(), strict=True):
            m = float((z[g] - z[b]) @ w)
            total += math.log1p(math.exp(-m)) if m > -30 else -m
        return total / pairs + ridge / 2 * float(w @ w)

    least = loss(model.weight)
    assert least < 0.5 * math.log(2)
    for k in range(len(model.weight)):
        for step in (-0.02, 0.02):
            w = model.weight.copy()
            w[k] += step
            assert loss(w) > least - 1e-9


def test_ranking_threshold_is_the_quantile_of_label_0(tables, counts):
    docs, labels = tables
    ids, own, quality = counts
    model = ranking.fitted(docs.select("doc_id", rules.rule_stats("text").alias("stats")), labels)
    at = [i for i, d in enumerate(ids) if d in quality and zlib.crc32(str(d).encode()) % 4 != 2]
    strengths = sorted(model.strengths(own[at]).tolist())
    low = sum(quality[ids[i]] == 0 for i in at) / len(at)
    below = sum(s < model.threshold for s in strengths) / len(at)
    assert abs(below - low) < 0.015
    got = {r["doc_id"]: r["score"] for r in ranking.quality_scores(docs, labels).select("doc_id", "score").collect()}
    for d, s in zip(ids, model.strengths(own).tolist(), strict=True):
        want = 1 / (1 + math.exp(-min(max(s - model.threshold + math.log(0.7 / 0.3), -500), 500)))
        assert math.isclose(got[d], want, rel_tol=1e-6, abs_tol=1e-12)


@pytest.mark.parametrize("most, size", [(0xFFFFFFFF, 4), (0x100000000, 8), (1 << 40, 8)])
def test_counts_of_pairs_are_stored_whole(tmp_path, most, size):
    layout = ngram_lm.Layout(str(tmp_path), 3, ())
    layout.save("counts", 0, ngram_lm._slim(np.array([1, most], dtype=np.int64)))
    layout.save("pairs", 0, np.array([3, 9], dtype=np.uint64))
    stored = np.load(layout.file("counts", 0))
    assert stored.itemsize == size
    got = ngram_lm._looked_up(layout, np.array([9, 4, 3], dtype=np.uint64), 3, "pairs", "counts", 1)
    assert got[:, 0].tolist() == [most, 0, 1]
