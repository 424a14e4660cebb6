"""Rule statistics of a text and the isolation forest over them (operator 2).

Null and empty texts have no words, so the base rules reject them; a text of any length is
read whole. Rows aren't matched by doc_id when they are scored, so repeated and null ids,
ties and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quarryline.llm import textkernel as K
from quarryline.llm.common import bounded_batches, fresh, hash_sample, written

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_digits", "n_bangs", "n_points", "n_twins", "n_distinct", "n_chars",
]
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS = _flags("#*$%&|<>")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _flags("abcdefghijklmnopqrstuvwxyz")
_DIGITS = _flags("0123456789")
_POINTS = _flags(".,;:?\"'()-")
_CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def counted(texts: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    for w in K.words(texts):
        here = out[w.first : w.first + w.n]
        chars = _CHAR[w.data]
        h = w.hashes(w.start, w.end)
        here[:, 0] = w.counts
        here[:, 1] = w.per_text(chars & ~K._SPACE[w.data])
        here[:, 2] = w.per_text(_SYMBOLS[w.data])
        # lines: what stands between the text's ends and its line feeds
        feeds = np.flatnonzero(w.data == 10)
        head = np.sort(np.concatenate([w.text_at[:-1], feeds + 1]))
        tail = np.sort(np.concatenate([w.text_at[1:], feeds]))
        full = np.searchsorted(w.start, tail) > np.searchsorted(w.start, head)
        head, tail = head[full], tail[full]
        own = np.searchsorted(w.text_at, head, side="right") - 1
        lines = K.tagged(w.hashes(head, tail), own)
        _, once = np.unique(lines, return_index=True)
        n_lines = np.bincount(own, minlength=w.n)
        here[:, 3] = n_lines - np.bincount(own[once], minlength=w.n)
        here[:, 5] = n_lines
        # windows of three words, only in texts of three words or more
        owners = w.owner
        if len(h) > 2:
            inside = owners[2:] == owners[:-2]
            run = K.tagged((h[:-2] * K.U64(3) + h[1:-1]) * K.U64(0x9E3779B97F4A7C15) + h[2:], owners[2:])
            twice = np.zeros(len(h), dtype=bool)
            at = np.flatnonzero(inside)
            at = at[K.repeated(run[at])]
            for i in range(3):
                twice[at + i] = True
            here[:, 4] = K.summed(twice, w.word_at)
        for k, table in ((6, _UPPER), (7, _LOWER), (8, _DIGITS), (10, _POINTS)):
            here[:, k] = w.per_text(table[w.data])
        here[:, 9] = w.per_text(w.data == 33)
        twin = np.zeros(len(h), dtype=bool)
        twin[1:] = (h[1:] == h[:-1]) & (owners[1:] == owners[:-1])
        here[:, 11] = K.summed(twin, w.word_at)
        _, once = np.unique(K.tagged(h, owners), return_index=True)
        here[:, 12] = np.bincount(owners[once], minlength=w.n)
        here[:, 13] = w.per_text(chars)
    return out


def structs(rows: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(rows.shape[1])], names=COUNTS)


@arrow_udf(STATS)
def rule_stats(texts: pa.Array) -> pa.Array:
    return structs(counted(texts))


def features(rows: np.ndarray) -> np.ndarray:
    """Rates in place of counts, so that a text's length alone is no anomaly."""
    c = {name: rows[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    words = np.maximum(c["n_words"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.column_stack([
        c["n_symbols"] / words,
        c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / words,
        np.maximum(c["n_upper"] - c["n_lines"], 0) / letters,
        c["n_digits"] / words,
        c["n_bangs"] / words,
        c["n_twins"] / words,
        c["n_distinct"] / words**0.8,
        c["word_chars"] / words,
        c["n_points"] / words,
    ])


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Forest:
    """Isolation trees as arrays: a node splits on a feature at a point, or is a leaf with its path length."""

    feature: np.ndarray  # trees x nodes; -1: a leaf
    split: np.ndarray
    length: np.ndarray
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for an anomaly, below 0.5 for a usual row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, s, ln in zip(self.feature, self.split, self.length, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(f) + 1))):
                on = f[at]
                at = np.where(on < 0, at, 2 * at + 1 + (x[rows, np.maximum(on, 0)] >= s[at]))
            total += ln[at]
        return 2.0 ** -(total / len(self.feature) / self.norm)


def _expected(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown(x: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 7) -> Forest:
    """Random splits of random subsets of x, by the usual recipe; x holds one row at least."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1, dtype=np.int64)
    split = np.zeros((trees, nodes))
    length = np.zeros((trees, nodes))
    for t in range(trees):
        waiting = [(0, x[rng.choice(len(x), rows, replace=False)], 0)]
        while waiting:
            node, part, d = waiting.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if d == depth or len(part) < 2 or not len(open_):
                length[t, node] = d + _expected(len(part))
                continue
            f = int(rng.choice(open_))
            s = float(rng.uniform(low[f], high[f]))
            s = s if s > low[f] else float(high[f])  # each side keeps a row
            feature[t, node], split[t, node] = f, s
            right = part[:, f] >= s
            waiting += [(2 * node + 1, part[~right], d + 1), (2 * node + 2, part[right], d + 1)]
    return Forest(feature, split, length, max(_expected(rows), 1e-9))


@dataclass(frozen=True)
class Detector:
    """A forest for each statistic and one for all together, each with its threshold; an infinite one rejects nothing."""

    forests: tuple[tuple[tuple[int, ...], Forest], ...]
    thresholds: tuple[float, ...]

    def parts(self, rows: np.ndarray) -> np.ndarray:
        x = features(rows)
        return np.column_stack([f.scores(x[:, list(columns)]) for columns, f in self.forests])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The greatest of the forests' scores over their thresholds: 1 and more is rejected."""
        return (self.parts(rows) / np.array(self.thresholds)).max(axis=1)


def scorer(detector: Detector):
    """An expression on the text: the counts with the detector's score."""
    kind = T.StructType([*STATS.fields, T.StructField("score", T.DoubleType())])

    @arrow_udf(kind)
    def scored(texts: pa.Array) -> pa.Array:
        rows = counted(texts)
        out = structs(rows)
        return pa.StructArray.from_arrays([*out.flatten(), pa.array(detector.scores(rows))], names=[*COUNTS, "score"])

    return scored


def _rows(stats: pa.Array) -> np.ndarray:
    return np.column_stack([np.asarray(c.fill_null(0)) for c in stats.flatten()])


def stats_scorer(detector: Detector):
    """An expression on a struct of counts: the detector's score."""

    @arrow_udf(T.DoubleType())
    def scored(stats: pa.Array) -> pa.Array:
        return pa.array(detector.scores(_rows(stats)))

    return scored


def bins_of(detector: Detector, bins: int):
    """An expression on a struct of counts: each forest's score as one of equal bins from 0 to 1."""

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def binned(stats: pa.Array) -> pa.Array:
        parts = np.minimum((detector.parts(_rows(stats)) * bins).astype(np.int32), bins - 1)
        at = pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1])
        return pa.ListArray.from_arrays(at, pa.array(parts.reshape(-1)))

    return binned


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """One row for each labelled doc_id; of contradicting labels the lower one holds."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias(column))


def fitted(stats: DataFrame, labels: DataFrame, trees: int = 100, rows: int = 256, most_lost: float = 0.001, bins: int = 4096) -> Detector:
    """The forests of a table (doc_id, stats) and their thresholds.

    They grow from some trees * rows of the documents that pass the base rules, drawn by the hashes of their
    statistics with all copies in proportion: the method's own subsampling. The thresholds cover all labelled
    documents: by a histogram of each forest's scores, the threshold with the most quality-0 documents above
    it less ten times the quality-1 documents above it, of those that lose at most most_lost of
    quality 1, or two documents. Without labels of both kinds nothing is rejected beyond the base rules.
    """
    kept = stats.where(~base_failed(F.col("stats")))
    sample = hash_sample(kept.select("stats.*"), trees * rows, *COUNTS).toPandas()
    counts = np.repeat(sample[COUNTS].to_numpy(np.int64), sample["copies"].to_numpy(np.int64), axis=0)
    x = features(counts if len(counts) else np.zeros((1, len(COUNTS)), dtype=np.int64))
    groups = [*[(i,) for i in range(x.shape[1])], tuple(range(x.shape[1]))]
    forests = tuple((g, grown(x[:, list(g)], trees if len(g) > 1 else trees // 4, rows, seed=7 + k)) for k, g in enumerate(groups))
    detector = Detector(forests, (np.inf,) * len(forests))
    found = (
        kept.join(one_label(labels, "quality"), "doc_id").select(F.posexplode(bins_of(detector, bins)("stats")).alias("forest", "bin"), "quality")
        .groupBy("forest", "bin").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good")).toPandas()
    )
    thresholds = []
    for k in range(len(forests)):
        bad, good = np.zeros(bins + 1), np.zeros(bins + 1)
        for b, n0, n1 in found[found.forest == k][["bin", "bad", "good"]].itertuples(index=False):
            bad[int(b)], good[int(b)] = n0, n1
        over_bad, over_good = bad[::-1].cumsum()[::-1], good[::-1].cumsum()[::-1]
        gain = np.where(over_good <= max(most_lost * good.sum(), 2), over_bad - 10 * over_good, -np.inf)
        best = np.flatnonzero(gain == gain.max())
        thresholds.append(float(best[len(best) // 2]) / bins if good.sum() and gain.max() > 0 else np.inf)
    return Detector(forests, tuple(thresholds))


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the rule statistics, base_failed, kept and the anomaly that decides on it, a row for each row of documents."""
    stats = written(bounded_batches(documents).select("doc_id", rule_stats("text").alias("stats")), "rule_stats")
    return judged(stats.withColumn("score", stats_scorer(fitted(stats, labels))("stats")))


def judged(scored: DataFrame) -> DataFrame:
    failed = base_failed(F.col("stats"))
    return scored.select(
        "doc_id", *[F.col("stats")[c].alias(c) for c in COUNTS[:5]], failed.alias("base_failed"),
        (~failed & (F.col("score") < 1)).alias("kept"), F.col("score").alias("anomaly"),
    )


def keep_by_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, as they are, that the rules and the forest keep."""
    # the counts of all rows, without their texts, are what the fit reads; the texts are never shuffled
    stats = written(bounded_batches(documents).select("doc_id", rule_stats("text").alias("stats")), "rule_stats")
    detector = fitted(stats, labels)
    own = fresh(documents, "rules")
    s = F.col(own)
    return documents.withColumn(own, scorer(detector)("text")).where(~base_failed(s) & (s["score"] < 1)).drop(own)
