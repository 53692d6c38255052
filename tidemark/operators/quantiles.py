"""Quantiles of many numeric columns, and the bin edges made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil, floor, inf, nextafter

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.values import without_nan
from ..sources.tables import literal_table
from .counting import binned_cells, name_at, number_cells, numeric_counts

# Fixed values of a KLL sketch of size k: ranks are off by at most 2.296 / k^0.9021, with 99 % confidence; k has a limit.
SKETCH_ERROR, SKETCH_POWER, SKETCH_LIMIT = 2.296, 0.9021, 65535

# Rows that one task sorts where a column's order matters. Beyond, the column is cut into more slices.
SLICE_ROWS = 1 << 20

# Slices one sketch is cut into at most, and how far their edges may be off: a quarter of a slice.
FAN = 1 << 10
FAN_ERROR = 1 / (4 * FAN)


def sketch_size(relative_error: float) -> int:
    """The size of a sketch whose ranks are off by relative_error at most; planned for half of it, as the bound is one of chance."""
    size = max(8, ceil((2 * SKETCH_ERROR / relative_error) ** (1 / SKETCH_POWER)))
    if size > SKETCH_LIMIT:
        raise ValueError(f"no sketch keeps within a relative_error of {relative_error}: take exact_quantiles")
    return size


def quantile_vectors(
    df: DataFrame, features: Sequence[str], n_bins: int, relative_error: float, exact: bool = False
) -> dict[str, list[float]]:
    """The quantiles at i / n_bins, i = 0..n_bins, per feature; an empty list where there is no number.

    This is the one result that must be at hand before further plans are built: n_bins + 1 numbers
    per feature.
    """
    if not features:
        return {}
    if exact:
        return vectors(exact_quantiles(df, features, n_bins), features)
    return vectors(sketched_quantiles(df, features, n_bins, relative_error), features)


def vectors(table: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """feature, quantiles as a dictionary, with an empty list for a feature that has no row."""
    found = {r["feature"]: list(r["quantiles"] or ()) for r in table.collect()}
    return {x: found.get(x, []) for x in features}


def bin_edges(quantiles: Sequence[float], policy: str = "replace_ends") -> list[float]:
    """Distinct ascending edges from -inf to +inf.

    A constant column gets three bins (below, equal, above), a column without numbers a single one,
    so that a later change always shows.
    """
    distinct = sorted(set(quantiles))
    if len(distinct) == 1:
        inner = [distinct[0], nextafter(distinct[0], inf)]
    elif policy == "extend_ends":
        inner = distinct
    else:
        inner = distinct[1:-1]
    return sorted({-inf, *inner, inf})


def quantile_sketches(df: DataFrame, features: Sequence[str], relative_error: float) -> DataFrame:
    """feature, n, sketch: one sketch of all numbers of a column; columns without any have no row.

    One scan for all columns and no shuffle of values: a task makes one sketch per column, and Spark merges them. A sketch
    has a bounded size, can be stored, and can be merged with sketches of further rows.
    """
    values = number_cells(df, features).select("position", without_nan(F.col("value")).alias("value")).filter("value IS NOT NULL")
    sketch = F.expr(f"kll_sketch_agg_double(value, {sketch_size(relative_error)})").alias("sketch")
    return values.groupBy("position").agg(F.count("*").alias("n"), sketch).select(name_at(features), "n", "sketch")


def merged_sketches(*tables: DataFrame) -> DataFrame:
    """feature, n, sketch of several tables' rows together, from their sketches alone."""
    return (
        reduce(DataFrame.unionByName, tables)
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
    )


def sketch_quantiles(sketches: DataFrame, n_bins: int) -> DataFrame:
    """feature, quantiles at i / n_bins, i = 0..n_bins; the smallest and the largest value are exact."""
    return sketches.select("feature", _at(F.col("sketch"), [i / n_bins for i in range(n_bins + 1)]).alias("quantiles"))


def sketched_quantiles(
    df: DataFrame, features: Sequence[str], n_bins: int, relative_error: float
) -> DataFrame:
    """feature, quantiles: each within relative_error of its rank."""
    return sketch_quantiles(quantile_sketches(df, features, relative_error), n_bins)


def _at(sketch: Column, ranks: Sequence[float]) -> Column:
    """The quantiles of a sketch at some ranks between 0 and 1, by one call."""
    # a tiny slack, so that rounding of a rank doesn't reach the next value
    listed = F.array(*[F.lit(float(x) if x in (0, 1) else x * (1 - 1e-12)) for x in ranks])
    return F.call_function("kll_sketch_get_quantile_double", sketch, listed)


def _alone(quantiles: Sequence[float]) -> list[float]:
    """Edges of slices at ascending quantiles; a value that fills a slice or more gets one of its own."""
    repeated = {a for a, b in zip(quantiles, quantiles[1:]) if a == b}
    return slice_edges([*quantiles, *[nextafter(x, inf) for x in repeated]])


def _grid() -> list[float]:
    return [i / FAN for i in range(FAN + 1)]


def slice_edges(quantiles: Sequence[float]) -> list[float]:
    """Edges of slices that cover all numbers, from some quantiles of them."""
    return sorted({-inf, *quantiles, inf})


def cut_points(df: DataFrame, column: str, slice_rows: int = SLICE_ROWS) -> list[float]:
    """Edges of slices of a column that hold about slice_rows rows each; only a value that is more frequent makes one larger.

    The number of slices follows from the number of rows. A sketch gives the first FAN of them; where that is not enough, each is
    sketched by itself in one more scan and cut on, up to FAN times FAN. The edges, one number per slice, are what reaches the driver.
    """
    found = quantile_sketches(df, [column], FAN_ERROR).select("n", _at(F.col("sketch"), _grid()).alias("q")).first()
    if found is None:
        return [-inf, inf]
    slices = 1 << (-(-found["n"] // slice_rows) - 1).bit_length()
    if slices <= FAN:
        return _alone(found["q"][FAN // slices : FAN : FAN // slices])
    edges = _alone(found["q"])
    # every so many points of the grid, for slices that are a power of two
    step = FAN / F.least(F.lit(FAN), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / slice_rows))))
    points = _slice_sketches(df, {column: edges}, None).select("n", F.posexplode(_at(F.col("sketch"), _grid())).alias("at", "q"))
    finer = points.filter((F.col("n") > slice_rows) & (F.col("at") % step == 0)).select("q").distinct()
    return slice_edges([*edges, *[r["q"] for r in finer.collect()]])


def _slice_sketches(df: DataFrame, edges: Mapping[str, Sequence[float]], only: Mapping[str, set[int]] | None) -> DataFrame:
    """feature, ord, n, sketch of each slice, or of those in `only`."""
    cells = _sliced(df, edges, only)
    sketch = F.expr(f"kll_sketch_agg_double(value, {sketch_size(FAN_ERROR)})").alias("sketch")
    grouped = cells.groupBy("position", "ord").agg(F.count("*").alias("n"), sketch)
    return grouped.select(name_at(list(edges)), "ord", "n", "sketch")


def _sliced(df: DataFrame, edges: Mapping[str, Sequence[float]], only: Mapping[str, set[int]] | None) -> DataFrame:
    """position, ord, value of the numbers in all slices, or in those of `only`, which are found by position."""
    # the filters stay above this step: pushed into the search for the slice, they would repeat it for each of its steps
    cells = binned_cells(df, edges).select(F.inline(F.array(F.struct("position", "ord", "value")))).filter("ord >= 0")
    if only is None:
        return cells
    listed = F.array(*[F.array(*[F.lit(at) for at in sorted(only.get(x, ()))]).cast("array<int>") for x in edges])
    return cells.filter(F.array_contains(F.get(listed, F.col("position")), F.col("ord")))


def exact_quantiles(df: DataFrame, features: Sequence[str], n_bins: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """feature, quantiles: the smallest value that at least i / n_bins of the numbers do not exceed.

    Selection by narrowing down: sketches enclose every wanted rank in a slice, the slices' rows are counted, and as long as a slice
    with a wanted rank holds more than slice_rows rows of different values, only such slices are sketched and cut again (each time to a
    five-hundredth of its rows at most, so two rounds serve 10^11 rows). Then the values of those slices alone are
    counted one by one and shuffled. The counts decide where a rank lies, so the result doesn't depend on the sketches.
    """
    spark = df.sparkSession
    _require_positive(n_bins)
    ends = [i / n_bins for i in range(n_bins + 1)]
    sketches = quantile_sketches(df, features, FAN_ERROR).select("feature", _at(F.col("sketch"), _around(ends)).alias("quantiles"))
    edges = {x: slice_edges([*q, *[nextafter(v, inf) for v in q]]) for x, q in vectors(sketches, features).items() if q}
    if not edges:
        return literal_table(spark, [], "feature string, quantiles array<double>")
    while True:
        asked, wide = _ranks_by_slice(df, edges, n_bins, slice_rows)
        if not wide:
            break
        edges = _narrowed(df, edges, asked, wide)
    wanted = [(x, at, i, rank) for x, at, i, rank, _ in asked]
    ranks = literal_table(spark, wanted, "feature string, slice int, i int, rank bigint")
    open_slices: dict[str, set[int]] = {}
    for x, at, _, _ in wanted:
        open_slices.setdefault(x, set()).add(at)
    counts = _sliced(df, edges, open_slices).groupBy("position", "ord", "value").agg(F.count("*").alias("n"))
    values = counts.select(name_at(list(edges)), F.col("ord").alias("slice"), "value", "n")
    order = Window.partitionBy("feature", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = values.withColumn("upto", F.sum("n").over(order))
    # ranks has n_bins + 1 rows per column
    reached = running.join(F.broadcast(ranks), ["feature", "slice"]).filter("upto >= rank")
    first = reached.groupBy("feature", "i").agg(F.min("value").alias("value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"])
    return first.groupBy("feature").agg(listed.alias("quantiles"))


def _around(ranks: Sequence[float]) -> list[float]:
    """Ranks that enclose the given ones, with the error of a sketch to spare."""
    return sorted({min(1.0, max(0.0, x + d)) for x in ranks for d in (-2 * FAN_ERROR, 2 * FAN_ERROR)})


def _ranks_by_slice(
    df: DataFrame, edges: Mapping[str, Sequence[float]], n_bins: int, slice_rows: int
) -> tuple[list[tuple[str, int, int, int, int]], dict[str, set[int]]]:
    """(feature, slice, i, rank within the slice, the slice's rows) of all wanted ranks; the slices among them that are too large."""
    sizes: dict[str, dict[int, int]] = {x: {} for x in edges}
    several = set()
    # a few slices per wanted rank
    for row in numeric_counts(df, edges).collect():
        if row["ord"] < 0:
            continue
        sizes[row["feature"]][row["ord"]] = row["n"]
        if row["lo"] < row["hi"]:
            several.add((row["feature"], row["ord"]))
    asked, wide = [], {}
    for x, of_slice in sizes.items():
        total, before = sum(of_slice.values()), 0
        ranks = [max(1, ceil(i * total / n_bins)) for i in range(n_bins + 1)]
        for at in sorted(of_slice):
            n = of_slice[at]
            inside = [(x, at, i, rank - before, n) for i, rank in enumerate(ranks) if before < rank <= before + n]
            asked += inside
            if inside and n > slice_rows and (x, at) in several:
                wide.setdefault(x, set()).add(at)
            before += n
    return asked, wide


def _narrowed(
    df: DataFrame, edges: Mapping[str, Sequence[float]], asked: Sequence[tuple[str, int, int, int, int]], wide: Mapping[str, set[int]]
) -> dict[str, list[float]]:
    """More edges, around the wanted ranks within the slices that are too large."""
    ranks: dict[tuple[str, int], list[float]] = {}
    for x, at, _, rank, n in asked:
        if at in wide.get(x, ()):
            ranks.setdefault((x, at), []).append(rank / n)
    parts = _slice_sketches(df, {x: edges[x] for x in wide}, wide)
    # one row per slice that is too large
    found = parts.select("feature", "ord", _at(F.col("sketch"), _grid()).alias("q"))
    finer = {x: set(e) for x, e in edges.items()}
    for row in found.collect():
        for rank in ranks[row["feature"], row["ord"]]:
            # half a step of the grid to either side is twice a sketch's error
            for at in (floor(rank * FAN - 0.5), ceil(rank * FAN + 0.5)):
                q = row["q"][min(max(at, 0), FAN)]
                finer[row["feature"]].update((q, nextafter(q, inf)))
    return {x: sorted(e) for x, e in finer.items()}


def _require_positive(n_bins: int) -> None:
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")


def edge_table(spark: SparkSession, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """The edges as a table: feature, position, edge."""
    rows = [(f, i, float(e)) for f, es in edges.items() for i, e in enumerate(es)]
    return literal_table(spark, rows, "feature string, position int, edge double")
