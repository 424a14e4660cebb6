"""An interpolated modified Kneser-Ney bigram model, counted and scored in Spark (operator 10).

Tokens are the words of a text with A-Z in lower case, then one end; the first token's context is a
start that is never predicted. Tokens and pairs stand for themselves by 64-bit hashes. The model is a set of sorted
hash arrays in the shared folder: pairs with their counts, tokens with their counts, their
numbers of left neighbours and of right neighbours seen once, twice and more often. Workers
map these files into memory; a batch's tokens are looked up in sorted order.
Null and empty texts are one end. A null id isn't held out. Repeated rows count as often as they stand there, and rows of
equal texts get equal scores. An untrained model gives every token the chance 1. Long texts are read whole. An empty table
gives an empty result; columns beside doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quarryline.llm import textkernel as K
from quarryline.llm.common import bounded_batches, new_path
from quarryline.llm.ranking import held_out

START, END = (np.uint64(x) for x in (0x53544152545F5F31, 0x454E445F5F5F5F31))
#: Tokens that a shard of the pairs holds, about, and how many they may become before there are more than MOST_SHARDS shards.
SHARD_TOKENS, LARGE_SHARD_TOKENS = 2_000_000, 16_000_000
MOST_SHARDS = 4_096
#: Pairs that a task gathers before it sends them on.
GATHERED = 1_500_000
#: Files that a worker has mapped at once; systems allow some 65 000 maps a process.
MAPPED = 16_384
SLICE = 4 << 20


def tokens(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of a slice and of their contexts, and the texts' n + 1 offsets into them."""
    at = w.word_at + np.arange(w.n + 1)
    token = np.empty(at[-1], dtype=np.uint64)
    last = at[1:] - 1
    is_word = np.ones(len(token), dtype=bool)
    is_word[last] = False
    token[is_word] = w.hashes(w.start, w.end)
    token[last] = END
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[at[:-1]] = START
    return token, context, at


def _merged(key: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, the place of one row of each, and the sums of the other arrays."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first], order[first], *[np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums])


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of each run of equal values in a sorted array."""
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(shard[a]), a, b


@dataclass(frozen=True)
class Layout:
    """Where the model lies and how its pairs are dealt: by the context, those of a hot context by the pair."""

    path: str
    bits: int
    hot: tuple[int, ...]

    def places(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """64-bit places of pairs: the shard in the upper bits, the rest of the pair's hash below."""
        pair = K.mixed(context * K.U64(0x9E3779B97F4A7C15) + token)
        shard = K.mixed(context) >> K.U64(64 - self.bits)
        if self.hot:
            hot = np.array(self.hot, dtype=np.uint64)
            is_hot = hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context
            shard = np.where(is_hot, pair & K.U64((1 << self.bits) - 1), shard)
        return (shard << K.U64(64 - self.bits)) | (pair >> K.U64(self.bits))

    def file(self, kind: str, shard: int) -> str:
        return f"{self.path}/{kind}-{shard:06d}.npy"

    def save(self, kind: str, shard: int, array: np.ndarray) -> None:
        """A task that runs again writes the same file; readers see it whole or not at all."""
        part = f"{self.path}/.{uuid.uuid4().hex}.npy"
        np.save(part, array)
        os.replace(part, self.file(kind, shard))


BLOBS = "shard int, kind int, blob binary"
_BLOBS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *[len(a.tobytes()) for a in arrays]], dtype=np.int64).tobytes(), *[a.tobytes() for a in arrays]])


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    at = 8 * (n + 1) + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(blob[at[i] : at[i + 1]], kinds[i]) for i in range(n)]


def _pair_counts(layout: Layout):
    """Tasks' own counts of pairs, a row for each shard: contexts once, with the number of their tokens."""

    def sent(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        context, token = (np.concatenate(x) for x in zip(*parts, strict=True))
        place, one, count = _merged(layout.places(context, token), np.ones(len(token), dtype=np.int64))
        context, token = context[one], token[one]
        shard = (place >> K.U64(64 - layout.bits)).astype(np.int64)
        order = np.lexsort((context, shard))
        context, token, count, shard = context[order], token[order], count[order], shard[order]
        rows = []
        for s, a, b in _runs(shard):
            own = context[a:b]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            c = count[a:b]
            rows.append((s, _packed(own[first], np.diff(np.append(first, b - a)).astype(np.uint32), token[a:b], np.minimum(c, 255).astype(np.uint8), c[c >= 255])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for w in K.words(batch.column(0), lower=True):
                token, context, _ = tokens(w)
                parts.append((context, token))
                held += len(token)
                if held >= GATHERED:
                    yield sent(parts)
                    parts, held = [], 0
        if parts:
            yield sent(parts)

    return run


def _slim(count: np.ndarray) -> np.ndarray:
    """Counts in four bytes each where all of them fit, in eight otherwise."""
    return count.astype(np.uint32) if not len(count) or count.max() < 1 << 32 else count


def _pairs_merged(layout: Layout, word_bits: int):
    """Writes a shard's pairs; sends on what each token and each context gathers from them."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        contexts, tokens_, counts = [], [], []
        for blob in table.column("blob"):
            head, run_, token, small, large = _unpacked(blob.as_buffer().to_pybytes(), np.uint64, np.uint32, np.uint64, np.uint8, np.int64)
            count = small.astype(np.int64)
            count[small == 255] = large
            contexts.append(np.repeat(head, run_))
            tokens_.append(token)
            counts.append(count)
        context, token = np.concatenate(contexts), np.concatenate(tokens_)
        place, one, count = _merged(layout.places(context, token), np.concatenate(counts))
        layout.save("pairs", shard, place)
        layout.save("counts", shard, _slim(count))
        context, token = context[one], token[one]
        word, _, left, total = _merged(token, np.ones(len(token), dtype=np.int64), count)
        seen = [(count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64)]
        head, _, n1, n2, n3 = _merged(context, *seen)
        rows = [(shard & ((1 << word_bits) - 1), 2, _packed(np.array([(count == k).sum() for k in range(1, 5)], dtype=np.int64)))]
        for kind, key, values in ((0, word, (left, total)), (1, head, (n1, n2, n3))):
            for s, a, b in _runs(key >> K.U64(64 - word_bits)):
                slim = [v[a:b].astype(np.uint32) if v[a:b].max() < 1 << 32 else v[a:b] for v in values]
                rows.append((s, kind + 4 * int(any(v.dtype != np.uint32 for v in slim)), _packed(key[a:b], *[v if all(x.dtype == np.uint32 for x in slim) else v.astype(np.int64) for v in slim])))
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=_BLOBS)

    return run


SUMS = [*[f"pairs{k}" for k in range(1, 5)], *[f"left{k}" for k in range(1, 5)], "lefts", "left_over2", "words", "tokens", "ends"]
_SUMS = pa.schema([(c, pa.int64()) for c in SUMS])


def _words_merged(layout: Layout):
    """Writes a shard's tokens; gives the sums that the discounts need."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [(np.zeros(0, np.uint64), np.zeros((0, 5), np.int64))]
        pairs = np.zeros(4, dtype=np.int64)
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
            data = blob.as_buffer().to_pybytes()
            if kind == 2:
                pairs += _unpacked(data, np.int64)[0]
                continue
            value = np.int64 if kind >= 4 else np.uint32
            key, *values = _unpacked(data, np.uint64, *[value] * 3)
            row = np.zeros((len(key), 5), dtype=np.int64)
            for i, v in enumerate(values):
                row[:, i + 2 * (kind % 4)] = v  # left, total | n1, n2, n3
            parts.append((key, row))
        key = np.concatenate([p[0] for p in parts])
        rows = np.concatenate([p[1] for p in parts])
        word, _, *sums = _merged(key, *rows.T)
        rows = np.column_stack(sums) if len(word) else rows
        layout.save("words", shard, word)
        layout.save("stats", shard, rows)
        left = rows[:, 0]
        token = left > 0  # the start is a context only
        ends = rows[word == END, 1].sum()
        out = [*pairs, *[(left == k).sum() for k in range(1, 5)], left.sum(), (left > 2).sum(), token.sum(), rows[:, 1].sum(), ends]
        return pa.Table.from_arrays([pa.array([int(x)], pa.int64()) for x in out], schema=_SUMS)

    return run


def _discounts(n: list[int]) -> np.ndarray:
    """D1, D2 and D3+ from the numbers of items seen once to four times; half the count where those say nothing."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k / 2 for k in (1, 2, 3)]
    return np.array([0.0, *[min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), out, strict=True)]])


@dataclass(frozen=True)
class Model:
    layout: Layout
    word_bits: int
    sums: dict[str, int]

    @property
    def pair_discounts(self) -> np.ndarray:
        return _discounts([self.sums[f"pairs{k}"] for k in range(1, 5)])

    @property
    def word_discounts(self) -> np.ndarray:
        return _discounts([self.sums[f"left{k}"] for k in range(1, 5)])


def local(path: str) -> str:
    """The shared folder as a mounted path; files are mapped into memory, so a store without one won't do."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if not path.startswith("/"):
        raise ValueError(f"the model's files are mapped into memory; {path} is no mounted folder")
    return path


def trained(documents: DataFrame) -> Model:
    """Counts every text of documents; its files go to a new folder under the shared one."""
    spark = documents.sparkSession
    path = local(new_path(spark, "ngrams"))
    os.makedirs(path, exist_ok=True)
    size = documents.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows")).first()
    bits = shard_bits((size["chars"] or 0) // 6)
    layout = Layout(path, bits, _hot(documents, bits, size["rows"]))
    word_bits = max(3, bits - 2)
    counted = documents.select("text").mapInArrow(_pair_counts(layout), BLOBS)
    # shards are dealt to four times as many partitions, which stay as they are: a task has a shard or two, at every size of the input
    pairs = counted.repartition(4 << bits, "shard").groupBy("shard").applyInArrow(_pairs_merged(layout, word_bits), BLOBS)
    words = pairs.repartition(4 << word_bits, "shard").groupBy("shard").applyInArrow(_words_merged(layout), ", ".join(f"{c} long" for c in SUMS))
    total = words.agg(*[F.sum(c).alias(c) for c in SUMS]).first().asDict()
    return Model(layout, word_bits, {k: v or 0 for k, v in total.items()})


def shard_bits(tokens: int) -> int:
    """The shards' number as a power of two: small shards up to MOST_SHARDS, then as many large ones, then more of them."""
    few, more = (int(tokens // n).bit_length() for n in (SHARD_TOKENS, LARGE_SHARD_TOKENS))
    return max(3, min(few, MOST_SHARDS.bit_length() - 1), more)


def _hot(documents: DataFrame, bits: int, n: int, rows: int = 2_000) -> tuple[int, ...]:
    """Tokens that many pairs begin with, by a sample: they decide only how pairs are dealt, not what is counted."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in K.words(batch.column(0), lower=True):
                h, n = np.unique(tokens(w)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, rows / max(n, 1)) * (1 << 30))
    found = documents.where(part).select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = found.orderBy(F.desc("n"), "h").limit(4 << bits).collect()
    total = sum(r["n"] for r in most)
    return tuple(sorted(int(np.int64(r["h"]).view(np.uint64)) for r in most if r["n"] * (4 << bits) > total))


@lru_cache(maxsize=MAPPED)
def _mapped(path: str) -> np.ndarray | None:
    try:
        return np.load(path, mmap_mode="r")
    except FileNotFoundError:  # no token fell into that shard
        return None


def _looked_up(layout: Layout, query: np.ndarray, bits: int, keys: str, values: str, width: int) -> np.ndarray:
    """The values of queries, 0 for those that aren't there; shard by shard, in order."""
    order = np.argsort(query)
    q = query[order]
    out = np.zeros((len(q), width), dtype=np.int64)
    for s, a, b in _runs(q >> np.uint64(64 - bits)):
        own = _mapped(layout.file(keys, s))
        if own is None or not len(own):
            continue
        part = q[a:b]
        at = np.minimum(np.searchsorted(own, part), len(own) - 1)
        hit = own[at] == part
        out[a + np.flatnonzero(hit)] = np.asarray(_mapped(layout.file(values, s))[at[hit]]).reshape(-1, width)
    back = np.empty_like(out)
    back[order] = out
    return back


def _score(model: Model, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For each slice its first text and rows (tokens, known tokens, base score, score)."""
    layout, s = model.layout, model.sums
    n, v = s["tokens"], s["words"]
    d2, d1 = model.pair_discounts, model.word_discounts
    rest = (d1[1] * s["left1"] + d1[2] * s["left2"] + d1[3] * s["left_over2"]) / s["lefts"] if s["lefts"] else 1.0
    for w in K.words(texts, lower=True, size=SLICE):
        token, context, at = tokens(w)
        row = _looked_up(layout, token, model.word_bits, "words", "stats", 5)
        pair = _looked_up(layout, layout.places(context, token), layout.bits, "pairs", "counts", 1)[:, 0]
        left, count = row[:, 0], row[:, 1]
        one = np.maximum(left - d1[np.minimum(left, 3)], 0) / max(s["lefts"], 1) + rest / (v + 1)
        before = np.empty_like(row)  # the context's row: that of the token before, or the start's
        before[1:] = row[:-1]
        start = _looked_up(layout, np.array([START]), model.word_bits, "words", "stats", 5)[0]
        start[1] = s["ends"]
        before[at[:-1]] = start
        total = before[:, 1]
        back = (before[:, 2:] * d2[1:]).sum(axis=1)
        some = np.maximum(total, 1)
        two = np.where(total > 0, np.maximum(pair - d2[np.minimum(pair, 3)], 0) / some + back / some * one, one)
        out = np.empty((w.n, 4))
        out[:, 0] = np.diff(at)
        out[:, 1] = K.summed(count > 0, at)
        owner = np.repeat(np.arange(w.n), np.diff(at))
        out[:, 2] = np.bincount(owner, weights=np.log10((count + 1) / (n + v + 1)), minlength=w.n)
        out[:, 3] = np.bincount(owner, weights=np.log10(two), minlength=w.n)
        yield w.first, out


SCORE = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def scorer(model: Model):
    """An expression on the text: its tokens, known tokens, base score and score."""

    @arrow_udf(SCORE)
    def scored(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 4))
        for first, rows in _score(model, texts):
            out[first : first + len(rows)] = rows
        return pa.StructArray.from_arrays([pa.array(out[:, 0].astype(np.int64)), pa.array(out[:, 1].astype(np.int64)), pa.array(out[:, 2]), pa.array(out[:, 3])], names=[f.name for f in SCORE.fields])

    return scored


def language_scores(documents: DataFrame) -> DataFrame:
    """Scores of every row of documents by a model of those that aren't held out."""
    out = held_out(F.col("doc_id"), 7)
    bounded_batches(documents)
    model = trained(documents.where(~out))
    scored = documents.select("doc_id", out.alias("held_out"), scorer(model)("text").alias("s"))
    return scored.select(
        "doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.sums["tokens"]).cast("long").alias("train_tokens"),
        "s.base_score", "s.score", F.pow(F.lit(10.0), -F.col("s.score") / F.col("s.n_tokens")).alias("perplexity"),
    )
