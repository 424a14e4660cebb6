"""Running sums over a table in one order, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import written


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, Column], key: str | None = None) -> DataFrame:
    """rows with running sums, each row's own value included: over the whole order, or anew for each key, which has to come first in it.

    Rows are sorted by ranges and written, so each keeps its place. A sum is made inside each range, and what the ranges before it
    hold is added: one row for each range, or for each key that goes on from one range to another, two for each range at most.
    So a key of a third of all rows is dealt like any other.
    """
    values = {f"_v{i}": v for i, v in enumerate(sums.values())}
    names = dict(zip(values, sums, strict=True))
    ranges = rows.withColumns(values).repartitionByRange(*order).sortWithinPartitions(*order)
    # within a partition the ids of the rows ascend
    marked = written(ranges.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_row")), "ranges")
    by = ["_range", key] if key else ["_range"]
    totals = marked.groupBy(*by).agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    earlier = Window.orderBy("_range")
    if key:
        totals = written(totals, "totals")
        several = totals.groupBy(key).count().where("count > 1").select(key)
        totals = totals.join(several, key, "left_semi")
        earlier = Window.partitionBy(key).orderBy("_range")
    before = totals.select(*by, *[(F.sum(f"_t{v}").over(earlier) - F.col(f"_t{v}")).alias(f"_b{v}") for v in values])
    inside = Window.partitionBy(*by).orderBy("_row")
    out = marked.select("*", *[F.sum(v).over(inside).alias(f"_s{v}") for v in values]).join(F.broadcast(before), by, "left")
    for v, name in names.items():
        out = out.withColumn(name, F.col(f"_s{v}") + F.coalesce(f"_b{v}", F.lit(0)))
    return out.select(*rows.columns, *names.values())
