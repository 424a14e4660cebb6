"""Exact whitening against plain Python with fractions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import queries as Q
from quarryline.llm import whitening as W

SF = "/root/testdata/sf0.001"


def plain(rows):
    """What the contract asks for: rows (vec_id, component): n, deviation, whitened, explained; components only up to their sign."""
    kept = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    mean = [Fraction(v, n) for v in s]
    cov = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    out = {}
    for i, x in kept:
        far = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        apart = np.array([float(x[j] - mean[j]) for j in range(d)])
        out[i] = (n, far, [(float(apart @ u[:, -k]) / math.sqrt(e[-k]), e[-k] / np.trace(cov)) for k in range(1, min(4, d) + 1)])
    return out


def check(got, want):
    signs = {}
    assert len(got) == sum(len(w[2]) for w in want.values())
    for r in got:
        n, far, parts = want[r["vec_id"]]
        value, explained = parts[r["component"] - 1]
        assert (r["n"], r["deviation"], r["deviation_digits"]) == (n, far, str(far))
        if abs(value) > 1e-6:
            signs.setdefault(r["component"], value * r["whitened"] > 0)
        assert r["whitened"] == pytest.approx(value if signs.get(r["component"], True) else -value, rel=1e-9, abs=1e-9)
        assert r["explained"] == pytest.approx(explained, rel=1e-9) and r["identity_error"] <= 1e-9


def test_query_equals_plain_fractions(spark):
    rows = [(r["vec_id"], list(r["embedding"])[:]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    small = [(i, v[:5]) for i, v in rows]
    df = spark.createDataFrame(small, "vec_id long, embedding array<float>")
    check(W.whitened(df).collect(), plain(small))
    got = Q.op11_exact_scatter(spark, SF).collect()
    assert len(got) == 4 * len(rows) and {r["component"] for r in got} == {1, 2, 3, 4} and {r["identity_error"] <= 1e-9 for r in got} == {True}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 40), st.integers(1, 63), st.randoms(use_true_random=False))
def test_sums_are_exact_at_any_size(d, n, bits, rng):
    x = np.array([[rng.randint(-(1 << bits), (1 << bits) - 1) for _ in range(d)] for _ in range(n)], dtype=np.int64)
    sums = W.Scatter(x[: max(1, n // 3)])
    for part in (x[: n // 2], x[n // 2 :]):
        sums.add(part)
    o = x.astype(object)
    count, s, c = sums.at_origin()
    assert count == n and s.tolist() == o.sum(axis=0).tolist() and c.tolist() == (o.T @ o).tolist()


def test_large_offset_and_deviations_beyond_a_long(spark):
    """Vectors far from the origin lose nothing; what is no long any more has its digits."""
    rng = random.Random(5)
    rows = [(i, [2.0**31 + rng.random(), 2.0**31 - 3 * rng.random(), rng.random()]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(W.whitened(df).collect(), plain(rows))
    wide = [(i, [2.0**40 * rng.random(), rng.random()]) for i in range(50)]
    want = plain(wide)
    for r in W.whitened(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect():
        assert r["deviation_digits"] == str(want[r["vec_id"]][1])
        assert r["deviation"] == (want[r["vec_id"]][1] if want[r["vec_id"]][1] < 1 << 63 else None)


def test_folds_in_two_rounds(spark):
    rows = [([i % 7, -i, i * i],) for i in range(200)]
    fit = spark.createDataFrame(rows, "x array<long>").repartition(9)
    o = np.array([r[0] for r in rows], dtype=object)
    for salts in (1, 3, W.SALTS):
        ((n, s, c),) = W.scatter(fit, salts).values()
        assert (n, s, c) == (200, o.sum(axis=0).tolist(), (o.T @ o).tolist())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.25], 1, "a"), (1, [0.5, 0.25], 1, "a"), (2, None, 2, "b"), (3, [None, 1.0], 3, "c"), (4, [nan, 1.0], 3, "c"), (5, [inf, 1.0], 3, "c"), (6, [-inf, 1.0], 3, "c"),
        (None, [0.1, -0.9], 4, "d"), (7, [-0.0, 0.0], 5, "e"), (8, [], 6, "f"), (9, [1.0], 7, "g"), (10, [3.0e38, 1.0, 2.0], 8, "h"), (11, [-3.0e38, 2.0, 2.0], 8, "h"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x string")
    got = W.whitened(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert sorted(by, key=str) == sorted([1, None, 7, 9, 10, 11], key=str)
    assert len(by[1]) == 4 and {r["n"] for r in by[1]} == {3} and len(by[None]) == 2
    assert [(r["n"], r["whitened"], r["deviation"]) for r in by[9]] == [(1, None, 0)]  # a fit list of one vector
    assert {r["component"]: r["whitened"] is None for r in by[10]} == {1: False, 2: True, 3: True}
    # 3e38 is taken at the end of the longs; 1 and 2 differ by 256
    assert by[10][0]["deviation_digits"] == str(2 * (2**64 - 1) ** 2 // 2 + 256**2) and by[10][0]["deviation"] is None
    few = [sorted(W.whitened(x).collect(), key=str) for x in (df.where("vec_id = 1 or vec_id = 7 or vec_id is null"), df.repartition(5).where("size(embedding) = 2"))]
    assert few[0] == few[1] and len(few[0]) == 8
    assert W.whitened(df.where("false")).collect() == []
