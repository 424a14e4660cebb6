"""Streams with a state for each key, kept by Spark in its own state store: what a key's state is grows with the keys, not with the batches."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.functions.text import repetition_shape
from quarryline.streaming.appends import _DOWN, _UP, PHASES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session's streams keep their states in RocksDB, on disk, while they start; afterwards the setting is as it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def run(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of changed states to its end. Each batch's changes are written under its number, so a batch that is replayed writes them again in their place."""
    with rocksdb(updates.sparkSession):
        query = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).start().awaitTermination()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last state of each key that a stream wrote to path."""
    every = spark.read.parquet(path)
    columns = [c for c in every.columns if c not in (key, "batch")]
    return every.groupBy(key).agg(F.max(F.struct("batch", *columns)).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in columns])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each outcome (failure, success) and phase: the next phase, and whether that is a move."""
    to = np.array([[PHASES.index(by.get(p, p)) for p in PHASES] for by in (_DOWN, _UP)], dtype=np.int8)
    return to, (to != np.arange(len(PHASES))).astype(np.int64)


def moved(phase: int, outcomes: np.ndarray) -> tuple[int, int]:
    """The phase after a row of outcomes (0 or 1), and the moves made. Outcomes are maps of the phases: they are composed in pairs, pairs of pairs and so on."""
    to, made = _tables()
    maps, moves = to[outcomes], made[outcomes]
    while len(maps) > 1:
        odd = (maps[-1:], moves[-1:]) if len(maps) % 2 else (maps[:0], moves[:0])
        a, b, x, y = maps[:-1:2] if len(maps) % 2 else maps[::2], maps[1::2], moves[:-1:2] if len(maps) % 2 else moves[::2], moves[1::2]
        row = np.arange(len(a))[:, None]
        maps, moves = np.concatenate([b[row, a], odd[0]]), np.concatenate([x + y[row, a], odd[1]])
    return (int(maps[0, phase]), int(moves[0, phase])) if len(maps) else (phase, 0)


def _lifecycle(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    phase, moves, last = state.get if state.exists else (0, 0, -1)
    # ten bytes a row of one batch; what a batch may hold is bounded by the source's options
    seqs, passes = [], []
    for part in parts:
        seqs.append(part["seq"].to_numpy(np.int64))
        passes.append(part["pass"].to_numpy(bool))
    seq, ok = np.concatenate(seqs), np.concatenate(passes)
    order = np.lexsort((ok, seq))
    phase, more = moved(phase, ok[order].astype(np.int64))
    state.update((phase, moves + more, max(last, int(seq.max()))))
    yield pd.DataFrame({"worker": [key[0]], "phase": [PHASES[phase]], "moves": [moves + more]})


def lifecycle(events: DataFrame) -> DataFrame:
    """A stream of changed states (worker, phase, moves) of a stream (worker, pass, seq): a success moves a worker up, a failure down, RETIRED is for good.

    Rows of a batch apply in the order of seq, failures first where it is equal; batches apply as they come.
    """
    return events.groupBy("worker").applyInPandasWithState(_lifecycle, "worker string, phase string, moves long", "phase int, moves long, last long", "update", GroupStateTimeout.NoTimeout)


def _guard(last: int) -> Callable:
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept = 0, []
        if state.exists:
            n, seqs, shapes = state.get
            kept = list(zip(seqs, shapes, strict=True))
            heapq.heapify(kept)
        for part in parts:
            n += len(part)
            some = part[part["shape"] != ""]
            # no more than the last lines of a part can stay
            for item in zip(*(some.nlargest(last, "seq", keep="all")[c].tolist() for c in ("seq", "shape")), strict=True):
                (heapq.heappush if len(kept) < last else heapq.heappushpop)(kept, item)
        kept.sort()
        state.update((n, [s for s, _ in kept], [x for _, x in kept]))
        yield pd.DataFrame({"key": [key[0]], "n_chunks": [n], "degenerate": [len(kept) == last and len({x for _, x in kept}) == 1]})

    return step


def guarded(chunks: DataFrame, last: int = 16) -> DataFrame:
    """A stream of changed states (key, n_chunks, degenerate) of a stream (key, seq, line): whether a text's last lines that aren't blank, by seq, are of one shape.

    The state of a key is its number of chunks and those last lines, whatever the order in which they come and however many there were.
    """
    shaped = chunks.select("key", F.col("seq").cast("long").alias("seq"), repetition_shape(F.coalesce("line", F.lit(""))).alias("shape"))
    key = shaped.schema["key"].dataType.simpleString()
    return shaped.groupBy("key").applyInPandasWithState(_guard(last), f"key {key}, n_chunks long, degenerate boolean", "n long, seqs array<long>, shapes array<string>", "update", GroupStateTimeout.NoTimeout)
