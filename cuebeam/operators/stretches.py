"""Windows over timelines of any length, in two levels.

A window over a whole timeline puts it into one task. Here a timeline is cut into stretches by the value of its order:
each stretch is a window of its own, its last word on the matter is one row, and a window over these few rows
gives each stretch what comes before it. So one timeline that holds most rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words, or other rows, in a stretch, and milliseconds where a timeline is ordered by time.
STRETCH, MS_STRETCH = 50_000, 3_600_000


def carry(rows: DataFrame, partition: list[str], order: str, columns: dict[str, tuple[str, Column]], then: list[str] | None = None, stretch: int | None = None, long: DataFrame | None = None) -> DataFrame:
    """rows with columns of what lies along the timeline: {name: (how, value)}. Rows whose partition is null are left out.

    how is "last" (the last value up to the row that is not null), "before" (up to the row before), "next" (the first after it), "sum" or
    "max" (up to the row). order is a whole number or a double, then more columns that settle its ties. Sums of nothing are 0,
    what is missing is null. rows are read twice: what is costly to make is best a written table. long, if given, holds
    (in columns of the partition, once each) all timelines that go beyond their first stretch: of the others nothing is read again.
    """
    by, stretch = [*partition, "_stretch"], stretch or STRETCH
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / F.lit(stretch)).cast("long"))
    hidden = {name: f"_carry_{k}" for k, name in enumerate(columns)}
    for name, (_, value) in columns.items():
        cut = cut.withColumn(hidden[name], value)
    keys = [order, *(then or [])]
    place = F.struct(*keys)
    hows = {
        # how: value along a window, whether up to the row itself, whether from the end, and what of a stretch others see
        "last": (lambda c, w: F.last(c, ignorenulls=True).over(w), 0, False, F.max_by), "before": (lambda c, w: F.last(c, ignorenulls=True).over(w), -1, False, F.max_by),
        "next": (lambda c, w: F.last(c, ignorenulls=True).over(w), -1, True, F.min_by), "sum": (lambda c, w: F.sum(c).over(w), 0, False, F.sum), "max": (lambda c, w: F.max(c).over(w), 0, False, F.max),
    }
    ends, far, near = [], [], []
    for name, (how, _) in columns.items():
        c = hidden[name]
        value, last, back, end = hows[how]
        # frames that only grow: what follows is what comes before from the end, row by row
        along = lambda part, order_by: Window.partitionBy(*part).orderBy(*[F.desc(k) if back else F.asc(k) for k in order_by])  # noqa: B023, E731
        ends.append((end(c) if how in ("sum", "max") else end(c, F.when(F.col(c).isNotNull(), place))).alias(c))
        far.append(value(c, along(partition, ["_stretch"]).rowsBetween(Window.unboundedPreceding, -1)).alias(f"{c}_far"))
        near.append(value(c, along(by, keys).rowsBetween(Window.unboundedPreceding, last)).alias(f"{c}_near"))
    kept = [c for c in rows.columns if c not in columns]
    seen = cut if long is None else cut.join(F.broadcast(long), long.columns, "left_semi")
    beyond = seen.groupBy(*by).agg(*ends).select(*by, *far)  # a row for each stretch
    cut = cut if long is None else cut.dropna(subset=partition)
    both = cut.select(*kept, "_stretch", *near).join(beyond, by, "inner" if long is None else "left")

    def joined(how: str, c: str) -> Column:
        x, y = F.col(f"{c}_near"), F.col(f"{c}_far")
        return F.greatest(x, y) if how == "max" else F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)) if how == "sum" else F.coalesce(x, y)

    return both.select(*kept, *[joined(how, hidden[name]).alias(name) for name, (how, _) in columns.items()])


def numbered(rows: DataFrame, partition: list[str], order: str, name: str, then: list[str] | None = None, stretch: int | None = None, long: DataFrame | None = None) -> DataFrame:
    """rows with their place in the timeline, from 0 (long: see carry)."""
    out = carry(rows, partition, order, {name: ("sum", F.lit(1).cast("long"))}, stretch=stretch, then=then, long=long)
    return out.withColumn(name, F.col(name) - 1)
