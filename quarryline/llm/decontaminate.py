"""Benchmark passages in documents, by the q-gram lemma and banded alignment (operator 7).

Documents and items are compared as folded characters: lower case, each run of white space as one space.
An item of n characters is found where it aligns with a stretch of a document within
e = min(8% of n, n / 10 - 1) edits, and none below 20 characters. Such a stretch shares n + 1 - 10 * (e + 1) q-grams of
10 characters with the item at least, all within e diagonals; so no stretch within the budget is missed. Items under 10
characters have no such q-gram: they are found where all their characters stand in a row.
Stretches of an item that don't overlap are reported each, from left to right; of overlapping ones the best, the first of equals.
Null and empty documents have no matches; null items, and empty ones or those of white space, match nothing; items with
equal text match alike, each by its own id, a null one too; rows that repeat a document are reported each. Documents
are read whole. Empty tables give an empty result; columns beside the ids and texts aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quarryline.llm import textkernel as K
from quarryline.llm.common import bounded_batches, fresh

Q = 10
RATE = 0.08
#: Characters of items that go to the executors at once; a larger benchmark is worked through block by block.
BLOCK = 8_000_000

#: No code point from this one on has a lower case or is white space.
_CASED = 0x1E944


def _fold() -> np.ndarray:
    chars = [chr(i) for i in range(_CASED)]
    one = [next((x for x in (c.casefold(), c.lower()) if len(x) == 1), c) for c in chars]
    return np.array([32 if c == "\0" or c.isspace() else ord(x) for c, x in zip(chars, one, strict=True)], dtype=np.uint32)


_FOLD = _fold()


def budget(n: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum((RATE * n).astype(np.int64), n // Q - 1), 0)


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded characters of all texts, a 0 behind each; where each came from in the joined text; the texts' offsets."""
    joined = np.frombuffer(("\0".join(x.replace("\0", " ") for x in texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(joined == 0)
    out = _FOLD.take(joined, mode="clip")
    if joined.max(initial=0) >= _CASED:
        out = np.where(joined < _CASED, out, joined)
    out[ends] = 0
    blank = out == 32
    edge = blank.copy()  # a blank, or the end of a text
    edge[ends] = True
    # of a run of blanks the last one stays, and none at either end of a text
    keep = np.ones(len(out), dtype=bool)
    keep[:-1] = ~(blank[:-1] & edge[1:])
    solid = np.maximum.accumulate(np.where(blank, -1, np.arange(len(out))))
    keep &= ~(blank & ((solid < 0) | (out[solid] == 0)))
    source = np.flatnonzero(keep)
    return out[keep], source, np.concatenate([[0], np.searchsorted(source, ends) + 1])


def _gram_hashes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = K._Powers.first(len(chars) + 1)
    prefix = np.zeros(len(chars) + 1, dtype=np.uint64)
    np.cumsum((chars.astype(np.uint64) + K.U64(1)) * K.U64(0xD6E8FEB86659FD93) * up[: len(chars)], out=prefix[1:])
    return K.mixed((prefix[q:] - prefix[:-q]) * down[:n])


class Index:
    """The q-grams of a block of items: sorted hashes with their (item, position) lists."""

    def __init__(self, texts: list[str]):
        chars, _, at = folded(texts)
        self.items = [chars[at[i] : at[i + 1] - 1] for i in range(len(texts))]
        self.n = np.array([len(x) for x in self.items], dtype=np.int64)
        self.e = budget(self.n)
        self.need = self.n + 1 - Q * (self.e + 1)
        hashes, item, place = [], [], []
        for i, x in enumerate(self.items):
            if len(x) >= Q:
                h = _gram_hashes(x)
                hashes.append(h)
                item.append(np.full(len(h), i))
                place.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.item = np.concatenate(item)[order] if hashes else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.zeros(0, np.int64)
        self.keys, self.at = np.unique(h[order], return_index=True)
        self.at = np.append(self.at, len(h))
        self.shift = K.U64(64 - max(16, int(len(self.keys)).bit_length() + 5))
        self.seen = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.seen[self.keys >> self.shift] = True
        # items without a q-gram: by their length, the hash of all their characters and the items that have it
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, x in enumerate(self.items):
            if 0 < len(x) < Q:
                self.short.setdefault(len(x), {}).setdefault(int(_gram_hashes(x, len(x))[0]), []).append(i)

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits), offsets in characters of the text as it stands."""
        chars, source, at = folded(texts)
        yield from self._short(chars, source, at)
        if not len(self.keys):
            return
        h = _gram_hashes(chars)
        here = np.flatnonzero(self.seen[h >> self.shift])
        key = np.minimum(np.searchsorted(self.keys, h[here]), len(self.keys) - 1)
        same = self.keys[key] == h[here]
        here, key = here[same], key[same]
        owner = np.searchsorted(at, here, side="right") - 1
        many = self.at[key + 1] - self.at[key]
        # some millions of shared grams at a time, cut between texts
        total = np.cumsum(many)
        i = 0
        while i < len(here):
            j = int(np.searchsorted(total, (total[i - 1] if i else 0) + 4_000_000, side="right"))
            j = int(np.searchsorted(owner, owner[min(max(j, i), len(here) - 1)], side="left")) if j < len(here) else j
            if j <= i:
                j = int(np.searchsorted(owner, owner[i], side="right"))
            yield from self._regions(chars, source, at, here[i:j], key[i:j], owner[i:j], many[i:j])
            i = j

    def _short(self, chars, source, at) -> Iterator[tuple[int, int, int, int, int]]:
        """All places, none within the one before it, of each item under Q characters."""
        for q, items in self.short.items():
            keys = np.array(sorted(items), dtype=np.uint64)
            h = _gram_hashes(chars, q)
            if not len(h):
                continue
            key = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            here = np.flatnonzero(keys[key] == h)
            owner = np.searchsorted(at, here, side="right") - 1
            free: dict[tuple[int, int], int] = {}  # by text and item, where the next stretch may begin
            for t, p, k in zip(owner.tolist(), here.tolist(), key[here].tolist(), strict=True):
                if p < free.get((t, k), 0):
                    continue
                free[(t, k)] = p + q
                for i in items[int(keys[k])]:
                    yield t, i, int(source[p] - source[at[t]]), int(source[p + q - 1] - source[at[t]] + 1), 0

    def _regions(self, chars, source, at, here, key, owner, many) -> Iterator[tuple[int, int, int, int, int]]:
        first = np.cumsum(many) - many
        post = np.arange(many.sum()) - np.repeat(first, many) + np.repeat(self.at[key], many)
        item, diagonal, of = self.item[post], np.repeat(here, many) - self.place[post], np.repeat(owner, many)
        wide = self.e[item] + 1
        band = diagonal // wide
        both = np.concatenate([band, band + 1])
        item2, of2 = np.concatenate([item, item]), np.concatenate([of, of])
        tag = K.mixed(K.mixed(K.mixed(of2.astype(np.uint64)) + item2.astype(np.uint64)) + both.astype(np.uint64))
        _, one, count = np.unique(tag, return_index=True, return_counts=True)
        one = one[count >= self.need[item2[one]]]
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for t, i, b in sorted(zip(of2[one].tolist(), item2[one].tolist(), both[one].tolist(), strict=True)):
            w, e = int(self.e[i]) + 1, int(self.e[i])
            low, high = (b - 1) * w - e, (b + 1) * w + e  # diagonals the alignment may use
            spans = found.setdefault((t, i), [])
            if spans and low <= spans[-1][1]:
                spans[-1] = (spans[-1][0], high)
            else:
                spans.append((low, high))
        for (t, i), spans in found.items():
            free = int(at[t])  # where the next stretch may begin
            for low, high in spans:
                for start, end, edits in self._stretches(i, chars, free, int(at[t + 1]) - 1, low, high):
                    free = end
                    yield t, i, int(source[start] - source[at[t]]), int(source[end - 1] - source[at[t]] + 1), edits

    def _stretches(self, i: int, chars: np.ndarray, begin: int, stop: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """The stretches of item i on diagonals low to high, from begin on, none overlapping: a long run of bands is gone through in overlapping parts."""
        item, e = self.items[i], int(self.e[i])
        step, s = 4 * (e + 1), max(low, begin - e)
        while s < high:
            hit = aligned(item, chars, begin, stop, s, min(high, s + 2 * step), e)
            if not hit:
                s += step
                continue
            # an overlapping stretch that begins a little later may be better
            later = aligned(item, chars, begin, stop, max(low, hit[0] - step), min(high, hit[0] + step), e)
            if later and later[2] < hit[2]:
                hit = later
            yield hit
            begin = max(hit[1], begin + 1)
            s = max(s, begin - e)


def _banded(p: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Edit distances of p to stretches of text that start in the band and end at each of its last cells.

    Cell k of row j stands before text[j + k]; first holds the cost of starting at each k.
    """
    k = np.arange(len(first), dtype=np.int64)
    row = first.astype(np.int64)
    for j in range(len(p)):
        cost = row + (text[j : j + len(k)] != p[j])
        cost[:-1] = np.minimum(cost[:-1], row[1:] + 1)
        row = np.minimum.accumulate(cost - k) + k
    return row


def aligned(item: np.ndarray, chars: np.ndarray, begin: int, stop: int, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The best stretch of chars[begin:stop] for the item on diagonals low to high, if within most edits: start, end, edits."""
    n, width = len(item), high - low + 1
    text = np.full(n + width, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(begin, low), min(stop, low + n + width)
    if a >= b:
        return None
    text[a - low : b - low] = chars[a:b]
    row = _banded(item, text, np.zeros(width, dtype=np.int64))
    k = int(row.argmin())
    edits = int(row[k])
    if edits > most:
        return None
    end = min(low + n + k, stop)
    # backwards from that end, to find where the stretch starts
    back = np.full(n + 2 * most + 1, 0xFFFFFFFF, dtype=np.uint32)
    anchor = np.full(2 * most + 1, 10**6, dtype=np.int64)
    anchor[most] = 0
    lead = np.arange(most + 1)
    anchor[most:] = lead
    run = chars[max(begin, end - n - most) : end][::-1]
    back[most : most + len(run)] = run
    row = _banded(item[::-1], back, anchor)
    length = n + int(row.argmin()) - most
    return max(begin, end - length), end, edits


MATCH = T.StructType([T.StructField("item", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])
_ARROW = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def finder(items: list[tuple[str, int]]):
    """An expression on the text: its matches with the items (text, key), by their keys."""

    @arrow_udf(T.ArrayType(MATCH))
    def matches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index([text for text, _ in items])
        for texts in batches:
            at = K.raw(texts)[1]
            out = []
            for i, j in K.pieces(at):
                part = [x or "" for x in texts.slice(i, j - i).to_pylist()]
                found: list[list[dict]] = [[] for _ in part]
                for t, item, start, end, edits in index.matches(part):
                    found[t].append({"item": items[item][1], "start": start, "end": end, "edits": edits})
                out += found
            yield pa.array(out, type=_ARROW)

    matches.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return matches


def _key() -> Column:
    return F.xxhash64("text").alias("key")


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[str, int]]]:
    """The distinct texts of the benchmark with their keys, in blocks of about size characters."""
    items = benchmark.where("text is not null").select("text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, -(-total // size))
    for b in range(many):
        yield [(r["text"], r["key"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(many)) == b).select("text", _key()).collect()]


def leaks(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each item found in each document: doc_id, item_id, the stretch's offsets in the text, and edits."""
    bounded_batches(documents)
    ids = benchmark.where("text is not null").select("item_id", _key()).distinct()
    out = None
    for items in blocks(benchmark, block):
        hits = documents.select("doc_id", F.explode(finder(items)("text")).alias("m")).select("doc_id", "m.*")
        out = hits if out is None else out.unionAll(hits)
    return out.join(ids, out["item"] == ids["key"]).select("doc_id", "item_id", "start", "end", "edits")


def without_leaks(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of documents, as they are, in which no item is found."""
    own = fresh(bounded_batches(documents), "leaks")
    for items in blocks(benchmark, block):
        documents = documents.withColumn(own, finder(items)("text")).where(F.size(own) == 0).drop(own)
    return documents
