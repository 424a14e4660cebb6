"""Whitening of embeddings by an exact integer scatter (operator 11).

An entry c becomes the whole number x = floor(256 c); the fit list holds each distinct vector of them once. Each task subtracts
a shift of its own from its part of the fit list, sums vectors and cross-products in whole numbers of any size, and moves the sums back to
the origin; so n, S and X'X are exact, and so is A = n X'X - S S'. Only then A / n^2 becomes floating-point and is decomposed
by eigh. Sums come in a row for each dimension and task and are folded in two rounds; the driver gets one d x d matrix, however
many vectors there are.

Rows whose vector is null or holds a null, NaN or infinite entry are left out. Vectors of each length are a population of
their own, with a fit list and components of their own; an empty vector has no component and no row. Whole numbers beyond the range of a long are taken at its ends. A component whose eigenvalue is no more than rounding (all, where a fit list has one vector) has null for whitened, as nothing can be
divided by it, and isn't part of identity_error, which is 0 where no component is left. deviation is null where it is no long any
more; deviation_digits has it in any case. Repeated rows and ids, and null ids, are rows of their own. Reruns agree, as sums of whole numbers
don't depend on their order; the entry of a component that is largest, the first of equal ones, is positive. An empty table gives an
empty result; columns beside vec_id and embedding aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import bounded_batches, written

SCALE, COMPONENTS = 256, 4
#: Sums of a dimension are folded by so many tasks first, then by one.
SALTS = 256
PARTIAL = "dim int, i int, salt int, n string, total string, products array<string>"


def whole(embedding: Column) -> Column:
    """The vector of longs of an embedding; null if it is to be left out."""
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of longs."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y of a matrix of longs, as Python's whole numbers.

    Floating-point products are exact as long as no sum passes 2^53; larger numbers are cut into limbs of 20 bits.
    """
    n, d = y.shape
    high = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if n * high * high < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if high >= 1 << 62:
        o = y.astype(object)
        return o.T @ o
    out = np.zeros((d, d), dtype=object)
    sign, size = np.sign(y), np.abs(y)
    limbs = [((size >> s & 0xFFFFF) * sign).astype(np.float64) for s in range(0, high.bit_length(), 20)]
    for i, j in combinations_with_replacement(range(len(limbs)), 2):
        for k in range(0, n, 4096):
            part = (limbs[i][k : k + 4096].T @ limbs[j][k : k + 4096]).astype(np.int64).astype(object)
            out += (part if i == j else part + part.T) * (1 << 20 * (i + j))
    return out


class Scatter:
    """n, S and X'X of vectors of one length, kept around a shift and moved to the origin at the end."""

    def __init__(self, x: np.ndarray) -> None:
        middle = np.rint(x.astype(np.float64).mean(axis=0))
        # where x - shift would leave the range of a long there is no shift
        self.shift = np.where(np.abs(middle) < 2.0**61, middle, 0.0).astype(np.int64)
        self.n, self.s, self.c = 0, np.zeros(x.shape[1], dtype=object), np.zeros((x.shape[1],) * 2, dtype=object)

    def add(self, x: np.ndarray) -> None:
        far = len(x) and max(int(x.max(initial=0)), -int(x.min(initial=0))) >= 1 << 61
        y = x.astype(object) - self.shift.astype(object) if far else x - self.shift
        self.n += len(x)
        self.s = self.s + (y.sum(axis=0) if far else np.array([int(v) for v in (y >> 32).sum(axis=0)], dtype=object) * (1 << 32) + (y & 0xFFFFFFFF).sum(axis=0).astype(object))
        self.c = self.c + (y.T @ y if far else exact_products(y))

    def at_origin(self) -> tuple[int, np.ndarray, np.ndarray]:
        m = self.shift.astype(object)
        moved = self.c + np.outer(m, self.s) + np.outer(self.s, m) + self.n * np.outer(m, m)
        return self.n, self.s + self.n * m, moved


def scattered(salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums of a task's vectors: for each length, a row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        salt = (task.partitionId() if task else 0) % salts
        sums: dict[int, Scatter] = {}
        for batch in batches:
            x = batch.column(0)
            sizes = np.diff(x.offsets.to_numpy())
            for d in np.unique(sizes[sizes > 0]).tolist():
                m = _matrix(x.filter(pa.array(sizes == d)))
                if d not in sums:
                    sums[d] = Scatter(m)
                sums[d].add(m)
        for d, sum_ in sums.items():
            n, s, c = sum_.at_origin()
            for i in range(d):
                yield _row(d, i, salt, n, s[i], c[i])

    return run


def _row(d: int, i: int, salt: int, n: int, s: int, c: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([str(n)]), pa.array([str(s)]), pa.array([[str(v) for v in c]], pa.list_(pa.string()))]
    return pa.record_batch(values, names=["dim", "i", "salt", "n", "total", "products"])


def folded(part: pa.Table) -> pa.Table:
    """The sum of a dimension's rows."""
    n, s, c = 0, 0, None
    for r in range(len(part)):
        n += int(part.column("n")[r].as_py())
        s += int(part.column("total")[r].as_py())
        own = np.array([int(v) for v in part.column("products")[r].as_py()], dtype=object)
        c = own if c is None else c + own
    return pa.Table.from_batches([_row(part.column("dim")[0].as_py(), part.column("i")[0].as_py(), 0, n, s, c)])


def scatter(fit: DataFrame, salts: int = SALTS) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By length: n, S and X'X of the vectors of fit (x), exact."""
    rows = fit.select("x").mapInArrow(scattered(salts), PARTIAL)
    rows = rows.groupBy("dim", "i", "salt").applyInArrow(folded, PARTIAL).groupBy("dim", "i").applyInArrow(folded, PARTIAL)
    out: dict[int, tuple[int, list[int], list[list[int]]]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["dim"], r["i"])):  # d rows of d numbers for a length d
        n, s, c = out.setdefault(r["dim"], (int(r["n"]), [], []))
        s.append(int(r["total"]))
        c.append([int(v) for v in r["products"]])
    return out


class Model:
    """Components of one length, by eigh of the exact covariance."""

    def __init__(self, n: int, s: list[int], c: list[list[int]], most: int) -> None:
        d = len(s)
        self.n, self.s = n, s
        # a quotient of Python's whole numbers is rounded once
        v = np.array([[(n * c[i][j] - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)])
        e, u = np.linalg.eigh(v)
        self.count = min(most, d)
        pick = np.arange(d)[::-1][: self.count]
        self.e, self.u = e[pick], u[:, pick].T
        for k in range(self.count):
            if self.u[k, np.argmax(np.abs(self.u[k]))] < 0:
                self.u[k] = -self.u[k]
        trace = sum(n * c[i][i] - s[i] * s[i] for i in range(d)) / (n * n)
        self.explained = self.e / trace if trace > 0 else np.zeros(self.count)
        self.able = self.e > d * np.finfo(float).eps * max(float(e[-1]), 0.0)

    def whitened(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The exact deviations of vectors, and their whitened components (rows x components; NaN where there is none)."""
        high = max(max(int(x.max(initial=0)), -int(x.min(initial=0))) * self.n, max(map(abs, self.s), default=0)) * 2
        if high < 1 << 62 and high * high * len(self.s) < 1 << 62:
            t = x * self.n - np.array(self.s, dtype=np.int64)
            far, apart = (t * t).sum(axis=1).tolist(), t / self.n
        else:
            t = x.astype(object) * self.n - np.array(self.s, dtype=object)
            far, apart = (t * t).sum(axis=1).tolist(), (t / self.n).astype(np.float64)
        root = np.sqrt(np.where(self.able, self.e, np.nan))
        return far, apart @ self.u.T / root


ROWS = "component int, n long, deviation long, deviation_digits string, whitened double, explained double"


def projected(models: dict[int, Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, x) to a row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            sizes = np.diff(x.offsets.to_numpy())
            for d in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == d)
                m = models[d]
                far, w = m.whitened(_matrix(x.take(pa.array(own))))
                k = m.count
                digits = [str(v) for v in far for _ in range(k)]
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(len(own) * k, m.n)),
                        pa.array([v if v < 1 << 63 else None for v in far for _ in range(k)], pa.int64()), pa.array(digits, pa.string()), pa.array(w.reshape(-1), mask=np.isnan(w.reshape(-1))),
                        pa.array(np.tile(m.explained, len(own))),
                    ],
                    names=["vec_id", *(c.split()[0] for c in ROWS.split(", "))],
                )

    return run


def identity_errors(fit: DataFrame, models: dict[int, Model]) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over all lengths; measured on the rows."""
    wide = fit.select("x").mapInArrow(_wide(models), "dim int, " + ", ".join(f"w{k} double" for k in range(COMPONENTS)))
    pairs = list(combinations_with_replacement(range(COMPONENTS), 2))
    found = wide.groupBy("dim").agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}{b}") for a, b in pairs]).collect()  # a row for each length
    out = 0.0
    for r in found:
        able = models[r["dim"]].able
        for a, b in pairs:
            if a < len(able) and b < len(able) and able[a] and able[b]:
                out = max(out, abs(r[f"c{a}{b}"] - (a == b)))
    return out


def _wide(models: dict[int, Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0)
            sizes = np.diff(x.offsets.to_numpy())
            for d in np.unique(sizes[sizes > 0]).tolist():
                _, w = models[d].whitened(_matrix(x.filter(pa.array(sizes == d))))
                columns = [pa.array(w[:, k], mask=np.isnan(w[:, k])) if k < w.shape[1] else pa.nulls(len(w), pa.float64()) for k in range(COMPONENTS)]
                yield pa.record_batch([pa.array(np.full(len(w), d, dtype=np.int32)), *columns], names=["dim", *(f"w{k}" for k in range(COMPONENTS))])

    return run


def whitened(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, deviation_digits, whitened, explained and identity_error: a row for each row left and component."""
    rows = bounded_batches(embeddings).select("vec_id", whole(F.col("embedding")).alias("x")).where("x is not null")
    fit = written(rows.select("x").distinct(), "fit")
    models = {d: Model(n, s, c, COMPONENTS) for d, (n, s, c) in scatter(fit).items()}
    error = identity_errors(fit, models)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(projected(models), f"vec_id {kind}, {ROWS}").withColumn("identity_error", F.lit(error))
