"""Ordered-window primitives that stay parallel when one key holds most of the rows.

Spark runs a window as one task per partition key.  A running total, an ordinal or a `lag`
over a hot key would therefore land in a single task.  Everything here cuts each key into
slices along the ordering column, works inside (key, slice), and carries the little that
crosses a slice border (one row per key and slice) through a second, tiny window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = "day"


def calendar_slice(at: str | Column, unit: str = DAY) -> Column:
    return F.date_trunc(unit, F.col(at) if isinstance(at, str) else at)


def totals_at(
    results: DataFrame,
    cursors: DataFrame,
    keys: Sequence[str],
    at: str,
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    minima: Sequence[str] = (),
    unit: str = DAY,
    slice_by: Column | None = None,
) -> DataFrame:
    """Totals of all `results` with `results.at <= cursor.at`, per distinct cursor instant.

    This is a point-in-time range join whose right side is only ever aggregated, written
    without the join.  Rows sharing an instant are folded before anything is ordered (map-side
    combine), so the ordered part grows with distinct instants, not with rows. Where `at` is no
    timestamp, `slice_by` cuts it; it must not decrease along `at`.
    """
    keys = list(keys)
    folds = {**{c: F.sum for c in sums}, **{c: F.max for c in maxima}, **{c: F.min for c in minima}}
    events = results.select(*keys, at, *folds, F.lit(0).alias("_ask")).unionByName(
        cursors.select(*keys, at, F.lit(1).alias("_ask")), allowMissingColumns=True
    )
    instants = events.groupBy(*keys, at).agg(
        *[fold(c).alias(c) for c, fold in folds.items()], F.max("_ask").alias("_ask")
    ).withColumn("_slice", calendar_slice(at, unit) if slice_by is None else slice_by)
    inside = Window.partitionBy(*keys, "_slice").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = instants.select(
        *keys, at, "_slice", *[fold(c).over(inside).alias(c) for c, fold in folds.items()], "_ask"
    ).filter(F.col("_ask") == 1)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = instants.groupBy(*keys, "_slice").agg(
        *[fold(c).alias(c) for c, fold in folds.items()]
    ).select(*keys, "_slice", *[fold(c).over(before).alias(f"_c_{c}") for c, fold in folds.items()])
    merged = local.join(carried, [*keys, "_slice"])
    out = [F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_c_{c}"), F.lit(0)) for c in sums]
    out += [F.greatest(F.col(c), F.col(f"_c_{c}")) for c in maxima]
    out += [F.least(F.col(c), F.col(f"_c_{c}")) for c in minima]
    return merged.select(*keys, at, *[o.alias(c) for o, c in zip(out, folds)])


def ordinal(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, name: str = "ord"
) -> DataFrame:
    """`row_number()` over (keys order by `order`); `slice_by` must not decrease along `order`."""
    keys = list(keys)
    cut = rows.withColumn("_slice", slice_by)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        cut.withColumn("_i", F.row_number().over(inside))
        .join(carried, [*keys, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_i").cast("bigint"))
        .drop("_slice", "_i", "_before")
    )


def with_previous(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    take: Sequence[str],
    slice_by: Column,
    prefix: str = "prev_",
) -> DataFrame:
    """`lag` of the `take` columns over (keys order by `order`), plus `<prefix>exists`.

    Both sides of the join are dealt by (keys, slice) already; merged, it holds for as many keys as rows,
    which an estimate of the carried side may miss.
    """
    keys = list(keys)
    cut = rows.withColumn("_slice", slice_by)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    packed = F.struct(*take)
    across = Window.partitionBy(*keys).orderBy("_slice")
    carried = cut.groupBy(*keys, "_slice").agg(
        F.max_by(packed, F.struct(*order)).alias("_tail")
    ).select(*keys, "_slice", F.lag("_tail").over(across).alias("_edge"))
    joined = cut.withColumn("_near", F.lag(packed).over(inside)).join(carried.hint("merge"), [*keys, "_slice"])
    found = F.coalesce(F.col("_near"), F.col("_edge"))
    return joined.withColumn("_found", found).select(
        *[c for c in rows.columns],
        F.col("_found").isNotNull().alias(f"{prefix}exists"),
        *[F.col("_found")[c].alias(f"{prefix}{c}") for c in take],
    )
