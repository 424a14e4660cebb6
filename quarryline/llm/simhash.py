"""Near duplicates by SimHash fingerprints and Pigeonring filtering (operator 13).

A text's letters A-Z are lowered, its words cut into shingles of three, repeats included (a shorter text is one shingle of all
its words), and each shingle hashed by XXH64. A bit of the fingerprint is set if it is set in over half the hashes. Fingerprints
of at most three differing bits are linked; components are those of all rows.

Candidates. The 64 bits are a ring of eight segments. If two fingerprints differ in three bits at most, there is a segment from
where the differences of the first k segments stay within floor(3 k / 8), for every k: 0, 0, 1, 1, 1, 2, 2, 3. So
the first two segments are equal, and two of the three behind them. These are 24 ways to pick 32 bits that two linked
fingerprints share; each fingerprint goes to its 24 buckets, and inside a bucket a pair has to keep to the chain's budgets of
five and of seven segments before its whole distance is taken. No pair that is linked is lost, whatever the data.

A null or empty text, or one of white space, has the fingerprint zero, which is linked like any other. Repeated rows and ids
belong to the component of their text; a null id is kept as null, and names no component: one without any id has null for
its name. Texts are read whole, however long. An empty table gives an empty result; columns beside doc_id and text aren't
read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quarryline.llm import textkernel as K
from quarryline.llm.common import bounded_batches, written
from quarryline.llm.components import components

SHINGLE = 3
SEED = 42
#: Differing bits of linked fingerprints, and segments of the ring.
BITS, SEGMENTS = 3, 8
#: A bucket of more fingerprints is cut into buckets of 48 shared bits, which hold 65,536 at most; a task's group of buckets holds about as many rows.
LARGE, GROUP = 20_000, 1_000_000
#: Buckets up to this size are compared by shifts over all of them at once.
SMALL = 48


def _ring(width: int, places: list[int], start: int, which: list[int]) -> int:
    """A mask of segments of a ring; the ring's bits, from the first, stand at the places of the word."""
    return sum(1 << places[(s * width + b) % len(places)] for k in which for s in [start + k] for b in range(width))


def _picks(places: list[int]) -> list[int]:
    """The 24 masks of a ring of eight segments: two neighbours, and two of the three behind them."""
    width = len(places) // SEGMENTS
    return [_ring(width, places, i, [0, 1, *two]) for i in range(SEGMENTS) for two in ([2, 3], [2, 4], [3, 4])]


ALL_BITS = list(range(64))
MASKS = _picks(ALL_BITS)
#: Bits of the first five and seven segments from each start, and the budgets of a chain that long.
CHAINS = [tuple((_ring(8, ALL_BITS, i, list(range(n))), BITS * n // SEGMENTS) for n in (5, 7)) for i in range(SEGMENTS)]
#: For each mask, the masks of a bucket's further cut: the same rule on the ring of the other 32 bits.
FURTHER = [[m | x for x in _picks([b for b in ALL_BITS if not m >> b & 1])] for m in MASKS]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hashes(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of a slice of texts, and the n + 1 indices into them."""
    # words joined by one space; a text's last word has one, too, which no shingle reaches
    size = w.end - w.start
    at = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size + 1, out=at[1:])
    out = np.full(at[-1], 0x20, dtype=np.uint8)
    inside = np.zeros(len(w.data) + 1, dtype=np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    kept = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    # neighbouring texts may touch, so that a word ends where the next begins; such words are cut by their offsets
    to = np.ones(at[-1], dtype=bool)
    to[at[1:] - 1] = False
    out[to] = _LOWER[w.data[kept]]
    data = out.tobytes()
    counts = w.counts
    n = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=first[1:])
    head = np.arange(first[-1]) + np.repeat(w.word_at[:-1] - first[:-1], n)
    last = head + np.repeat(np.minimum(counts, SHINGLE), n)
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(data[a:b], SEED) for a, b in zip(at[head].tolist(), (at[last] - 1).tolist(), strict=True)), dtype=np.uint64, count=len(head)), first


def _majority(h: np.ndarray, at: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Of each text the bits that are set in over half its hashes."""
    n = len(at) - 1
    ones = np.zeros((n, 64), dtype=np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))
    for i in range(0, len(h), step):
        bits = np.unpackbits(h[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[i : i + step]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    most = (2 * ones > np.diff(at)[:, None]).astype(np.uint8)
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).reshape(-1)


@arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    out = np.zeros(len(texts), dtype=np.uint64)
    for w in K.words(texts):
        h, at = _hashes(w)
        out[w.first : w.first + w.n] = _majority(h, at)
    return pa.array(out.view(np.int64))


def _rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for links between nodes 0 to n - 1."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _near(x: np.ndarray, chain: int) -> np.ndarray:
    """Which differences stay within a chain's budgets and the distance; each test sees only what the one before it left."""
    left = np.arange(len(x))
    for mask, most in (*CHAINS[chain], ((1 << 64) - 1, BITS)):
        left = left[np.bitwise_count(x[left] & K.U64(mask)) <= most]
    return left


def linked(part: pa.Table) -> pa.Table:
    """Links that join the fingerprints of each bucket of the group as all their links do; at most one for each row."""
    chain, key, fp = (part.column(c).to_numpy() for c in ("chain", "key", "fp"))
    order = np.lexsort((fp, key, chain))
    chain, key, fp = chain[order], key[order], fp[order].view(np.uint64)
    n = len(fp)
    heads = np.flatnonzero(np.concatenate([[True], (chain[1:] != chain[:-1]) | (key[1:] != key[:-1])]))
    sizes = np.diff(np.append(heads, n))
    end = np.repeat(heads + sizes, sizes)
    few = np.repeat(sizes <= SMALL, sizes)
    start = chain // 3
    a, b = [], []
    here = np.flatnonzero(few & (np.arange(n) + 1 < end))
    shift = 1
    while len(here):
        for c in range(SEGMENTS):
            own = here[start[here] == c]
            good = own[_near(fp[own] ^ fp[own + shift], c)]
            a.append(good)
            b.append(good + shift)
        shift += 1
        here = here[here + shift < end[here]]
    for i, size in zip(heads[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        # each step compares one that is joined with those that aren't yet, so that none is compared twice
        rest, c = np.arange(i, i + size), int(start[i])
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                one = front.pop()
                at = _near(fp[rest] ^ fp[one], c)
                found = rest[at]
                a.append(np.full(len(found), one))
                b.append(found)
                front.extend(found.tolist())
                rest = np.delete(rest, at)
    if not a:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    values, of = np.unique(fp, return_inverse=True)
    root = _rooted(len(values), of[np.concatenate(a)], of[np.concatenate(b)])
    moved = np.flatnonzero(root != np.arange(len(values)))
    return pa.table({"a": pa.array(values[moved].view(np.int64)), "b": pa.array(values[root[moved]].view(np.int64))})


def links(nodes: DataFrame, large: int = LARGE) -> DataFrame:
    """Links (a, b) between the fingerprints of nodes (fp, ...), enough of them for the components.

    Each fingerprint makes 24 rows, so what is shuffled is in proportion to the distinct fingerprints. A bucket of more than
    `large` goes out by 24 keys of 48 bits each instead; by these no bucket can hold more than 65,536.
    """
    one = lambda masks: F.posexplode(F.array(*[F.col("fp").bitwiseAND(_signed(m)) for m in masks])).alias("chain", "key")
    rows = nodes.select("fp", one(MASKS))
    counts = rows.groupBy("chain", "key").agg(F.count("*").alias("n"))
    counts = written(counts.where(F.col("n") > large).select("chain", "key"), "large")
    parts = rows.withColumn("of", F.xxhash64("chain", "key"))
    if not counts.isEmpty():
        hot = rows.join(counts, ["chain", "key"], "left_semi")
        finer = F.array(*[F.array(*[F.col("fp").bitwiseAND(_signed(m)) for m in masks]) for masks in FURTHER])
        cut = hot.select("fp", "chain", "key", F.posexplode(F.element_at(finer, F.col("chain") + 1)).alias("way", "finer"))
        parts = parts.join(counts, ["chain", "key"], "left_anti").unionByName(
            cut.select("fp", "chain", F.xxhash64("way", "finer").alias("key"), F.xxhash64("chain", "way", "finer").alias("of"))
        )
    many = max(nodes.sparkSession.sparkContext.defaultParallelism, 24 * nodes.count() // GROUP)
    parts = parts.select("chain", "key", "fp", F.pmod("of", F.lit(many)).alias("part"))
    return written(parts.groupBy("part").applyInArrow(linked, "a long, b long").distinct(), "links")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of documents; component_id is the least doc_id of the component."""
    rows = written(bounded_batches(documents).select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
