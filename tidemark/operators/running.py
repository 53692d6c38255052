"""Running counts over ordered values, without ever sorting a whole column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .counting import add_bin


def with_running_counts(counts: DataFrame, value: str, measures: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Add to each value's row the running and the total sum of every measure.

    counts has one row per value, so a value that holds a third of all rows is a single row here. A value's slice follows
    from the edges alone (see cut_points: their number follows from the rows), so it is the same whenever a task is run again. Sums per
    slice give each slice its starting point, and the running sum itself stays within a slice.

    New columns: <m>_upto (sum over all values <= this one) and <m>_total.
    """
    sliced = add_bin(counts, value, edges, "slice")
    whole = Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per slice, which is one for a million rows
    starts = (
        sliced.groupBy("slice")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            "slice",
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        )
    )
    within = (
        Window.partitionBy("slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = sliced.select("slice", value, *measures, *[F.sum(m).over(within).alias(f"{m}_within") for m in measures])
    return summed.join(starts, "slice").select(
        value,
        *measures,
        *[(F.col(f"{m}_within") + F.col(f"{m}_before")).alias(f"{m}_upto") for m in measures],
        *[f"{m}_total" for m in measures],
    )
