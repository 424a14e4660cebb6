"""SimHash near duplicates against a plain version."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import queries as Q
from quarryline.llm import simhash as S

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for x in runs:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def plain_components(fps):
    """The least index of each fingerprint's component."""
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def around(rng, centre, n, most):
    out = {centre}
    while len(out) < n:
        out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most))))
    return out


@pytest.mark.parametrize("large", [S.LARGE, 4])
def test_links_join_what_brute_force_joins(spark, large):
    """Fingerprints around few centres, so that buckets are large, and cut further in the second run."""
    rng = random.Random(7)
    fps = sorted(set().union(*[around(rng, rng.getrandbits(64), n, most) for n, most in ((150, 4), (80, 9), (1, 0), (1, 0), (60, 16))]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), large).collect()
    at = {x: i for i, x in enumerate(signed)}
    root = S._rooted(len(fps), np.array([at[r["a"]] for r in found]), np.array([at[r["b"]] for r in found]))
    assert root.tolist() == plain_components(fps)
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 64 for r in found)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3), st.integers(0, 2**64 - 1))
def test_every_link_shares_a_bucket_and_keeps_its_chain(x, bits, other):
    y = x ^ sum(1 << b for b in bits)
    assert any(x & m == y & m and len(S._near(np.array([x ^ y], dtype=np.uint64), i // 3)) for i, m in enumerate(S.MASKS))
    for i, m in enumerate(S.MASKS):
        assert bin(m).count("1") == 32 and all(bin(f).count("1") == 48 and f & m == m for f in S.FURTHER[i])
        if x & m == y & m and len(S._near(np.array([x ^ y], dtype=np.uint64), i // 3)):
            assert any(x & f == y & f for f in S.FURTHER[i])
    if bin(x ^ other).count("1") > 3:
        assert not any(len(S._near(np.array([x ^ other], dtype=np.uint64), c)) for c in range(8))


def test_large_bucket_in_a_task():
    """More than SMALL fingerprints in one bucket are joined one by one, without a link for each pair."""
    rng = random.Random(3)
    free = [b for b in range(64) if not S.MASKS[0] >> b & 1]
    fps = sorted({sum(1 << b for b in rng.sample(free, rng.randint(0, 5))) for _ in range(400)})
    part = pa.table({"chain": pa.array([0] * len(fps), pa.int32()), "key": pa.array([0] * len(fps), pa.int64()), "fp": pa.array(np.array(fps, dtype=np.uint64).view(np.int64))})
    out = S.linked(part)
    assert len(out) < len(fps)
    at = {x: i for i, x in enumerate(np.array(fps, dtype=np.uint64).view(np.int64).tolist())}
    root = S._rooted(len(fps), np.array([at[x] for x in out.column("a").to_pylist()]), np.array([at[x] for x in out.column("b").to_pylist()]))
    near = [plain_components(fps)]  # of all links; those whose chain starts elsewhere can only join more
    assert all(near[0][i] == near[0][r] for i, r in enumerate(root))


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    fps = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op13_pigeonring(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", docs[r][0]) for (i, _), f, r in zip(docs, fps, roots, strict=True)}
    assert len(set(roots)) < len(docs)


def test_odd_rows(spark):
    rows = [
        (9, None, "a", 1), (8, "", "a", 2), (7, " \n\t", "b", 3), (6, "One", "b", 4), (6, "One", "b", 4), (5, "one", "c", 5), (None, "ONE", "c", 6), (None, "no id at all here", "c", 7),
        (4, "two words", "c", 8), (3, "a b " * 40_000, "c", 9), (2, "É ß 😀 x\x0by z", "c", 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(df).collect()), key=str)
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(fps)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min([x for x in (least.get(root), r[0]) if x is not None], default=None)
    assert got == sorted(((r[0], f"{f:016x}", least[root]) for r, f, root in zip(rows, fps, roots, strict=True)), key=str)
    assert {g[2] for g in got if g[1] == "0" * 16} == {7}
    assert S.near_duplicates(df.where("false")).collect() == []
