"""Ordered scans without one task for all rows: running sums, ranks, quantiles.

Values are counted first, so equal ones are one row. Quantiles cut them into ranges; each range
is summed up, scanned in its own task and moved by what the ranges before it hold. So a group
may have any share of the rows. Values are numbers, dates or times; null ones don't take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.operators.common import kept, small


def _beside(rows: DataFrame, few: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with the columns of ``few``, which has a row for each group (null is one)."""
    if not group:
        return rows.crossJoin(F.broadcast(few))  # one row
    renamed = few.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group)})
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(small(renamed), same).drop(*[f"_g{i}" for i in range(len(group))])


def running(rows: DataFrame, value: str, sums: dict[str, Column], group: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """(group..., value, and for each of ``sums``, aggregates of whole numbers: name, to_name:
    its sum up to this value, all_name: over the group), a row for each different value."""
    group = group or []
    n = max(1, ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = kept(rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(*[s.alias(name) for name, s in sums.items()]), "values")
    points = F.percentile_approx("value", [i / n for i in range(1, n)] or [0.5], 100 * n)
    cut = _beside(by, kept(by.groupBy(*group).agg(points.alias("_cuts")), "cuts"), group)
    cut = cut.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).drop("_cuts")
    parts = cut.groupBy(*group, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    # n ranges in a group at most
    totals = kept(parts.groupBy(*group).agg(F.collect_list(F.struct("_range", *sums)).alias("_totals")), "totals")
    at = Window.partitionBy(*group, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda part, name: F.aggregate(part, F.lit(0).cast("long"), lambda a, t: a + t[name])
    before = F.filter("_totals", lambda t: t["_range"] < F.col("_range"))
    out = _beside(cut, totals, group)
    for s in sums:
        out = out.withColumn(f"to_{s}", F.sum(s).over(at) + total(before, s)).withColumn(f"all_{s}", total(F.col("_totals"), s))
    return out.drop("_totals", "_range")


def at_rank(rows: DataFrame, value: str, place: Callable[[Column], Column], group: list[str] | None = None) -> DataFrame:
    """(group..., value): the one at ``place`` (from 0, of the number of values) in order."""
    group = group or []
    r = running(rows, value, {"c": F.count("*")}, group)
    at = place(F.col("all_c"))
    return r.where((F.col("to_c") > at) & (F.col("to_c") - F.col("c") <= at)).select(*group, "value")


def median(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """(group..., median, n): the middle value, or the mean of both middle ones."""
    r = running(rows, value, {"c": F.count("*")}, group)
    holds = lambda at: (F.col("to_c") > at) & (F.col("to_c") - F.col("c") <= at)
    low, high = (F.max(F.when(holds(F.floor((F.col("all_c") - 1 + k) / 2)), F.col("value"))) for k in (0, 1))
    return r.groupBy(*(group or [])).agg((low + (high - low) / 2).alias("median"), F.max("all_c").alias("n"))
