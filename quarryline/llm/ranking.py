"""Document quality by Bradley-Terry ranking of preference pairs (operator 6).

A document's strength is a weighted sum of features of its text alone; the chance that a document of
quality 1 is preferred to one of quality 0 is the logistic function of the difference
of their strengths. Null and empty texts have all-zero counts and get the score of such a text.
Labels of null, or for ids that aren't there, are left out, of contradicting labels of an id the lower one holds. With no
pair to learn from, every score is 0.5. Texts are read whole; repeated rows get equal scores, and so do ties. An empty
table gives an empty result; columns beside doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quarryline.llm import rules
from quarryline.llm.common import bounded_batches, hash_sample, written

#: Labelled rows that the ranking is fitted on, about; they are drawn by the hash of their counts, copies in proportion.
FIT_ROWS = 40_000
#: Random preference pairs of those rows that the weights minimise the loss over.
PAIRS = 200_000
#: A score of this or more predicts label 1.
CUT = 0.7


def features(rows: np.ndarray) -> np.ndarray:
    """Rates of a text's counts, their square roots, and the logarithm of its length."""
    c = {name: rows[:, i].astype(np.float64) for i, name in enumerate(rules.COUNTS)}
    words = np.maximum(c["n_words"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    rates = np.column_stack([
        c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        np.maximum(c["n_upper"] - c["n_lines"], 0) / letters, c["n_digits"] / words, c["n_bangs"] / words, c["n_twins"] / words,
        c["n_points"] / words, 1 - c["n_distinct"] / words, c["word_chars"] / words / 10,
    ])
    return np.column_stack([rates, np.sqrt(np.maximum(rates, 0)), np.log1p(c["n_words"]) / 5])


@dataclass(frozen=True)
class Ranking:
    middle: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float = 0.0

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((features(rows) - self.middle) / self.scale, -8, 8) @ self.weight

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The strength, as a chance that is CUT at the threshold."""
        if not self.weight.any():
            return np.full(len(rows), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.strengths(rows) - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)))


def learned(rows: np.ndarray, label: np.ndarray, seed: int = 5, pairs: int = PAIRS, ridge: float = 1e-3) -> Ranking:
    """The weights that minimise the mean logistic loss over random pairs of a row of label 1 and one of label 0, by Newton steps."""
    x = features(rows)
    middle, scale = x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), x.std(axis=0) + 1e-6 if len(x) else np.ones(x.shape[1])
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    weight = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Ranking(middle, scale, weight)
    z = np.clip((x - middle) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ weight, -500, 500)))  # the chance of the wrong order
        slope = d.T @ p / pairs - ridge * weight
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(weight))
        step = np.linalg.solve(curve, slope)
        weight = weight + step
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(middle, scale, weight)


def _expression(model: Ranking, what: str):
    @arrow_udf(T.DoubleType())
    def of_counts(stats: pa.Array) -> pa.Array:
        rows = np.column_stack([np.asarray(c.fill_null(0)) for c in stats.flatten()])
        return pa.array(getattr(model, what)(rows))

    return of_counts


def held_out(doc_id: Column, folds: int = 4) -> Column:
    """Whether the id is of the rows that nothing is learned from; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 2, F.lit(False))


def fitted(stats: DataFrame, labels: DataFrame) -> Ranking:
    """Learned from the labelled rows of (doc_id, stats) that aren't held out.

    The weights come from PAIRS pairs of some FIT_ROWS of them. The threshold is the quantile of all their strengths
    at the share of label 0, halfway between the strengths just below and above it.
    """
    known = stats.where(~held_out(F.col("doc_id"))).join(rules.one_label(labels, "quality"), "doc_id").select("stats.*", "quality")
    sample = hash_sample(known, FIT_ROWS, *rules.COUNTS, "quality").toPandas()
    sample = sample.loc[np.repeat(np.arange(len(sample)), sample["copies"].to_numpy(np.int64))]
    model = learned(sample[rules.COUNTS].to_numpy(np.int64), sample["quality"].to_numpy(np.int64))
    if not model.weight.any():
        return model
    low = known.agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
    strength = known.select(_expression(model, "strengths")(F.struct(*rules.COUNTS)).alias("s"))
    near = strength.agg(F.percentile_approx("s", [max(low * 0.99, 0.0), min(low + 0.01 * (1 - low), 1.0)], 20_000)).first()[0]
    return Ranking(model.middle, model.scale, model.weight, sum(near) / 2)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of documents."""
    stats = written(bounded_batches(documents).select("doc_id", rules.rule_stats("text").alias("stats")), "rule_stats")
    model = fitted(stats, labels)
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _expression(model, "scores")("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
