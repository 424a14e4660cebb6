"""Mixing sources to target weights by capped water-filling (operator 5).

A source's size is the number of words of its documents. Sources by code point, null last, weigh 5, 2, 1 and so on;
the mix is as large as all documents together. A source is taken at most three times over; what it
can't give goes to the others by their weights until none is above its cap. Of a source that
is to be taken e times, every document is taken floor(e) times and a seeded choice of them once more: in the
order of a hash of seed, id and text the documents before the point where the remaining words are reached, the one across that
point if more than half of it lies before. Null and empty texts have size 0 and are taken 0 times their
words. Rows that repeat are rows of their own; which of equal rows is taken doesn't matter. An empty table gives an empty
result. Reruns on the same rows take the same; rows of one hash stand in any order, each with a share of its own. Columns beside
doc_id, source and text aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "quarryline"
#: Hash ranges that each source's documents are dealt to; only the one across the source's point is put in order.
RANGES_HEX = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) of one row for each source.

    A round clamps all sources whose share of what is left is above their cap; the shares only grow,
    so the rounds end when none is. Only two sums of each round come to the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    pool = written(sizes.withColumn("weight", weight.cast("long")).withColumn("cap", epochs * F.col("source_size")), "pool")
    total = pool.agg(F.sum("source_size")).first()[0] or 0
    clamped, number = F.lit(False), -1
    while True:
        sums = pool.agg(F.count_if(clamped).alias("n"), F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("caps"), F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weights")).first()
        left, shares = total - (sums["caps"] or 0), sums["weights"] or 0
        if sums["n"] == number or not shares:
            break
        number = sums["n"]
        # cap / weight < left / shares, in whole numbers
        clamped = F.col("cap") * F.lit(shares) < F.lit(left) * F.col("weight")
    share = F.col("weight") * (F.lit(float(left)) / F.lit(float(max(shares, 1))))
    return pool.select("source", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def taken(documents: DataFrame) -> DataFrame:
    """A row for each row of documents: doc_id, source, its mark, size, source_size, target and taken."""
    mark = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    rows = written(documents.select("doc_id", "source", size_of(F.col("text")).alias("size"), mark.alias("mark")), "sizes")
    rows = rows.withColumn("range", F.substring("mark", 1, RANGES_HEX))
    parts = written(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    plan = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", epochs).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = written(plan, "plan")
    # the words of each source up to each range; the source's remaining words are reached in one of them
    run = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    upto = parts.withColumn("upto", run).withColumnRenamed("source", "s").withColumnRenamed("range", "r")
    cut = upto.join(plan, F.col("s").eqNullSafe(F.col("source"))).select("s", "r", (F.col("upto") - F.col("words")).alias("before"), "upto", "source_size", "target", "whole", "rest")
    cut = written(cut, "cuts")
    placed = rows.join(F.broadcast(cut) if _few(cut) else cut, rows["source"].eqNullSafe(F.col("s")) & (rows["range"] == F.col("r"))).drop("s", "r")
    split = (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    clear = placed.where(~split).withColumn("more", (F.col("upto") <= F.col("rest")).cast("long"))
    behind = F.col("before") + F.sum("size").over(Window.partitionBy("source", "range").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0))
    across = placed.where(split).withColumn("behind", behind).withColumn("more", (F.col("behind") - F.col("size") / 2 < F.col("rest")).cast("long")).drop("behind")
    return clear.unionByName(across).select("doc_id", "source", "mark", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).cast("long").alias("taken"))


def _few(cut: DataFrame, most: int = 200_000) -> bool:
    """Whether the table of ranges, some 4096 for each source, is small enough to send to every executor."""
    return cut.count() <= most


def mixed(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, a row for each row of documents."""
    return taken(documents).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', 'quarryline', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
f AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM r),
l AS (SELECT left_, shares, k FROM f WHERE cap * shares >= left_ * weight ORDER BY k LIMIT 1),
g AS (
  SELECT r.source, r.source_size, CASE WHEN r.k < l.k THEN CAST(r.cap AS DOUBLE) ELSE CAST(r.weight AS DOUBLE) * (CAST(l.left_ AS DOUBLE) / CAST(l.shares AS DOUBLE)) END AS target
  FROM r, l),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole_ FROM g),
b AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY mark ROWS UNBOUNDED PRECEDING) AS behind FROM d)
SELECT b.doc_id, b.size, h.source_size, h.target,
       CAST(b.size * (h.whole_ + CASE WHEN b.behind - b.size / 2.0 < h.target - h.whole_ * h.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source
"""
