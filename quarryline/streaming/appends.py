"""Structured Streaming forms: idempotent appends, summaries kept up to date, lifecycles, windows of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import repetition_shape
from quarryline.operators.ledger import summary
from quarryline.sources.shared import written
from quarryline.sources.stores import append_ledger


def stream(spark: SparkSession, sf_dir: str, table: str, schema) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of them: a pattern of one name is taken for either, where a plain path has to be a folder."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{sf_dir}/{table}.parque[t]")


def append_once(events: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream's new events to a ledger; rows that come again, in a replayed batch too, add nothing."""
    events.writeStream.foreachBatch(lambda batch, _: append_ledger(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of the rows of an id within the watermark's delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def running_summary(ledger: DataFrame) -> DataFrame:
    """Counters of the whole ledger so far; for output mode complete. Distinct models are counted in batch only."""
    seen = F.col("kind") == "OBSERVATION"
    return ledger.groupBy(F.lit(1).alias("one")).agg(F.count("*").alias("events"), F.count_if(seen).alias("observations"), F.count_if(seen & ~F.coalesce("pass", F.lit(False))).alias("failures")).drop("one")


def batch_summary(ledger: DataFrame) -> DataFrame:
    return summary(ledger)


def windowed(events: DataFrame, size: str = "1 day", delay: str = "2 days") -> DataFrame:
    """An extension of our own: counts and sums by windows of event time; later rows than the delay are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Places of an order that are merged in one group, at most.
WIDTH = 4_096


def folded(rows: DataFrame, key: str, seq: str, value: str, merge: Callable[[Column], Column]) -> DataFrame:
    """(key, value): a key's values merged in the order of seq, ties by value. merge makes one value of an array of them and is associative.

    Ranges of WIDTH places are merged first, then ranges of ranges, until each key is one: no group holds more rows than
    WIDTH places have, however many a key has.
    """
    ends = rows.agg(F.min(seq).alias("a"), F.max(seq).alias("b")).first()
    low, span = ends["a"] or 0, (ends["b"] or 0) - (ends["a"] or 0)
    rows = rows.select(F.col(key).alias("key"), (F.col(seq) - low).alias("seq"), F.col(value).alias("value"))
    while True:
        listed = rows.groupBy("key", F.floor(F.col("seq") / WIDTH).alias("range")).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("l"))
        rows = written(listed.select("key", F.col("range").alias("seq"), merge(F.transform("l", lambda x: x["value"])).alias("value")), "folds")
        span //= WIDTH
        if span == 0:
            return rows.select(F.col("key").alias(key), F.col("value").alias(value))


def kept(stream: DataFrame, path: str, checkpoint: str, update: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """Runs a stream to its end; update makes the whole new state of a batch and the state before it. Returns the last state.

    A state is written under its batch's number, so a batch that is replayed writes the same state again.
    """

    def run(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.parquet(f"{path}/batch={number - 1}") if number else None
        update(batch, before).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = stream.sparkSession.read.parquet(path)
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


PHASES = ["CANDIDATE", "SHADOW", "ACTIVE", "DEGRADED", "RETIRED"]
_UP = {"CANDIDATE": "SHADOW", "SHADOW": "ACTIVE", "DEGRADED": "ACTIVE"}
_DOWN = {"ACTIVE": "DEGRADED", "SHADOW": "CANDIDATE", "DEGRADED": "RETIRED"}


def _moves(by: dict[str, str]) -> Column:
    """What one outcome makes of each phase: the next phase's place, and whether that is a move."""
    return F.array(*[F.struct(F.lit(PHASES.index(by.get(p, p))).alias("to"), F.lit(int(p in by)).cast("long").alias("moves")) for p in PHASES])


def _composed(maps: Column) -> Column:
    """The moves of several outcomes, one after the other."""
    after = lambda e, m: F.element_at(m, e["to"] + 1)
    return F.aggregate(maps, _moves({}), lambda acc, m: F.transform(acc, lambda e: F.struct(after(e, m)["to"].alias("to"), (e["moves"] + after(e, m)["moves"]).alias("moves"))))


def lifecycle(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """(worker, phase, moves) after a stream (worker, pass, seq): a success moves a worker up, a failure down, RETIRED is for good.

    Rows of a batch apply in the order of seq. An outcome is a map of the five phases; maps compose, so a worker's rows are
    folded by ranges before the one map that is left meets its state.
    """

    def update(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        rows = batch.select("worker", "seq", F.when(F.col("pass"), _moves(_UP)).otherwise(_moves(_DOWN)).alias("m"))
        new = folded(rows, "worker", "seq", "m", _composed)
        old = before if before is not None else new.select("worker", F.lit(PHASES[0]).alias("phase"), F.lit(0).cast("long").alias("moves"))
        at = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase")).cast("int"), F.lit(1))
        step = F.coalesce(F.element_at("m", at), F.struct((at - 1).alias("to"), F.lit(0).cast("long").alias("moves")))
        phase = F.element_at(F.array(*[F.lit(p) for p in PHASES]), step["to"] + 1)
        return new.join(old, "worker", "full_outer").select("worker", phase.alias("phase"), (F.coalesce("moves", F.lit(0)) + step["moves"]).alias("moves"))

    return kept(events, path, checkpoint, update)


def guarded(chunks: DataFrame, path: str, checkpoint: str, last: int = 16) -> DataFrame:
    """(key, n_chunks, degenerate) after a stream of text chunks (key, seq, line): whether a text's last lines repeat one shape; only those lines are kept."""

    def merged(values: Column) -> Column:
        lines = F.flatten(F.transform(values, lambda v: v["lines"]))
        n = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v["n"])
        return F.struct(n.alias("n"), F.slice(lines, F.greatest(F.size(lines) - last, F.lit(0)) + 1, last).alias("lines"))

    def update(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        shape = repetition_shape(F.col("line"))
        value = F.struct(F.lit(1).cast("long").alias("n"), F.when(shape != "", F.array(shape)).otherwise(F.array().cast("array<string>")).alias("lines"))
        new = folded(batch.select("key", "seq", value.alias("v")), "key", "seq", "v", merged)
        old = before.select("key", F.col("v").alias("w")) if before is not None else new.select("key", F.lit(None).cast(new.schema["v"].dataType).alias("w"))
        both = F.filter(F.array("w", "v"), lambda v: v.isNotNull())
        return new.join(old, "key", "full_outer").select("key", merged(both).alias("v"))

    state = kept(chunks, path, checkpoint, update)
    return state.select("key", F.col("v.n").alias("n_chunks"), ((F.size("v.lines") == last) & (F.size(F.array_distinct("v.lines")) == 1)).alias("degenerate"))
