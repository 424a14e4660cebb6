"""Numbering of all rows of a table in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.sources.shared import written


def placed(rows: DataFrame, *order: Column | str, name: str = "place", first: int = 1) -> DataFrame:
    """rows with each one's place in a total order, as a long counted from `first`.

    The rows are sorted by ranges and written, so that each keeps its number; the only window is
    over one row for each range, and no task holds all rows.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # within a partition the ids of the rows ascend by one, from a start that the partition gives
    marked = written(ranges.select("*", F.spark_partition_id().alias("_range"), (F.monotonically_increasing_id() % (1 << 33)).alias("_row")), "ranges")
    sizes = marked.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return marked.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_row") + first).cast("long")).drop("_range", "_row", "_before")
