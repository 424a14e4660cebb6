"""Joins that hold what they promise: one row for each key on a side, and a partner for each row. What breaks that raises while the join runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _refused(rules: list[tuple[Column, str]], key: Column, kept: Column | None = None) -> Column:
    """`kept`, or true, where no rule is broken; raises the first rule's message with the key where one is.

    It is one expression over both sides, so that no part of it is worked out before the join and hides a row from the rest.
    """
    out = F.lit(True) if kept is None else kept
    for broken, message in reversed(rules):
        out = F.when(broken, F.raise_error(F.concat(F.lit(f"{message}: "), key)).cast("boolean")).otherwise(out)
    return out


def _unclashing(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    both = {c.lower() for c in left.columns if c not in on} & {c.lower() for c in right.columns if c not in on}
    if both:
        raise ValueError(f"both sides have columns {sorted(both)}")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], left_name: str = "left", right_name: str = "right", surplus: bool = False) -> DataFrame:
    """Left's rows with right's columns: every left row has exactly one right row, and keys are unique on both sides.

    A key used twice on either side, a left row without a right one and, unless `surplus` allows it, a right row without a left
    one raise when the join runs, with the key in the message: there is no pass over the data before. Null keys are equal to
    each other. Both sides are grouped by key together, in one shuffle, and counted there; rows of one key never multiply.
    """
    _unclashing(left, right, on)
    row = lambda side: F.struct(*[F.col(f"`{c}`") for c in side.columns if c not in on], F.lit(True).alias("_there"))
    no = lambda side: F.lit(None).cast(side.select(row(side).alias("x")).schema["x"].dataType)
    both = left.select(*on, row(left).alias("_l"), no(right).alias("_r")).union(right.select(*on, no(left).alias("_l"), row(right).alias("_r")))
    own = both.groupBy(*on).agg(F.count("_l").alias("_n_l"), F.count("_r").alias("_n_r"), F.first("_l", ignorenulls=True).alias("_l"), F.first("_r", ignorenulls=True).alias("_r"))
    l, r = F.col("_n_l"), F.col("_n_r")
    rules = [(l > 1, f"duplicate {left_name}"), (r > 1, f"duplicate {right_name}"), ((l == 1) & (r == 0), f"missing {right_name}")]
    if not surplus:
        rules.append((l == 0, f"surplus {right_name}"))
    own = own.where(_refused(rules, F.to_json(F.struct(*on)), l == 1))
    return own.select(*on, *[F.col(f"_l.`{c}`").alias(c) for c in left.columns if c not in on], *[F.col(f"_r.`{c}`").alias(c) for c in right.columns if c not in on])


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], right_name: str = "right") -> DataFrame:
    """Left's rows with right's columns: every left row has exactly one right row, which others may share.

    A left row without a right one, and one whose key right has twice, raise when the join runs, with the key in the message; a null key has no partner. Keys
    of right that no left row has aren't looked at. Right is counted by key where it is joined; a hot key of left stays with Spark's skew join.
    """
    _unclashing(left, right, on)
    rest = [F.col(f"`{c}`") for c in right.columns if c not in on]
    r = right.groupBy(*on).agg(F.count("*").alias("_n_r"), F.first(F.struct(*rest, F.lit(True).alias("_there"))).alias("_r"))
    rules = [(F.col("_n_r").isNull(), f"missing {right_name}"), (F.col("_n_r") > 1, f"duplicate {right_name}")]
    j = left.join(r, on, "left").where(_refused(rules, F.to_json(F.struct(*on))))
    return j.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_r.`{c}`").alias(c) for c in right.columns if c not in on])
