"""Counts of every watched column in long form: one scan and one shuffle for all columns of a kind.

A row is unfolded into one cell per column, which holds the column's position and its value; all that differs between columns
(edges, known categories) is found by position in a table of constants. So the generated code does not grow with the columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import inf, nan

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import ABSENT, NO_NUMBER_BIN, REST, VALUE, category, number, quoted, without_nan
from ..sources.tables import literal_table


def add_bin(df: DataFrame, feature: str, edges: Sequence[float], bin_column: str = "bin") -> DataFrame:
    """Add the bin of one numeric column.

    Bin i is [edges[i], edges[i + 1]), the last one closed; null, NaN and values outside are bin -1. Bucketizer
    searches the edges by bisection on the JVM, however many there are. It takes two bins or more, so a single bin
    is settled by the first test alone.
    """
    value, plain = number(feature), df.columns
    if len(edges) > 2:
        df = Bucketizer(
            inputCol=f"__in_{bin_column}",
            outputCol=f"__bin_{bin_column}",
            splits=[-inf, *map(float, edges[1:-1]), inf],
            handleInvalid="keep",
        ).transform(df.withColumn(f"__in_{bin_column}", without_nan(value)))
        found = F.col(f"__bin_{bin_column}").cast("int")
    else:
        found = F.when(without_nan(value).isNotNull(), 0)
    # outer edges are infinite in all profiles; finite ones leave values outside without a bin
    if edges[0] > -inf:
        found = F.when(value >= F.lit(float(edges[0])), found)
    if edges[-1] < inf:
        found = F.when(value <= F.lit(float(edges[-1])), found)
    return df.select(*[F.col(quoted(c)) for c in plain], F.coalesce(found, F.lit(NO_NUMBER_BIN)).alias(bin_column))


def numeric_counts(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows per bin: feature, ord, n, n_valued (not null), lo, hi (smallest and largest value)."""
    _require_names(edges)
    return (
        binned_cells(df, edges)
        .groupBy("position", "ord")
        .agg(
            F.count("*").alias("n"),
            F.count("value").alias("n_valued"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
        )
        .select(name_at(list(edges)), "ord", "n", "n_valued", "lo", "hi")
    )


def category_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per category: feature, kind ('value' or 'missing'), key (null when missing), n.

    Exact, so a column without repeats shuffles all its values; map-side aggregation makes a
    category one row per task, however many rows it holds.
    """
    _require_names(features)
    counts = category_cells(df, features).groupBy("position", "key").agg(F.count("*").alias("n"))
    return counts.select(name_at(features), _kind_of_key(), "key", "n")


def category_counts_of_two(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per category on both sides: feature, kind, key, n_ref, n_cur. One shuffle, no join."""
    _require_names(features)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    before = category_cells(reference, features).select("*", one.alias("n_ref"), zero.alias("n_cur"))
    after = category_cells(current, features).select("*", zero.alias("n_ref"), one.alias("n_cur"))
    counts = (
        before.unionByName(after)
        .groupBy("position", "key")
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )
    return counts.select(name_at(features), _kind_of_key(), "key", "n_ref", "n_cur")


def known_category_counts(df: DataFrame, known: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Rows per known category, everything else summed as 'other': feature, kind, key, n, n_valued.

    known gives for each feature its keys by kind. They are few (the caller checks), so they are sent to every
    task and looked up in the scan; the shuffle carries only known keys, whatever the cardinality. Missing values
    are a known category only where the list says so, else they are among the rest.
    """
    names = list(known)
    _require_names(names)
    keys = [(i, key, True) for i, x in enumerate(names) for key in known[x].get(VALUE, ())]
    # at most top_k keys per feature, which the caller has collected already
    listed = F.broadcast(literal_table(df.sparkSession, keys, "position int, key string, listed boolean"))
    absent = F.array(*[F.lit(ABSENT in known[x]) for x in names])
    kind = F.when(F.col("listed"), VALUE).when(F.col("key").isNull() & F.get(absent, F.col("position")), ABSENT).otherwise(REST)
    return (
        category_cells(df, names)
        .join(listed, ["position", "key"], "left")
        .select("position", kind.alias("kind"), F.when(F.col("listed"), F.col("key")).alias("key"), F.col("key").isNotNull().cast("int").alias("valued"))
        .groupBy("position", "kind", "key")
        .agg(F.count("*").alias("n"), F.sum("valued").alias("n_valued"))
        .select(name_at(names), "kind", "key", "n", "n_valued")
    )


def name_at(names: Sequence[str]) -> Column:
    """The feature's name from its position, which is cheaper to group by."""
    return F.get(F.array(*[F.lit(x) for x in names]), F.col("position")).alias("feature")


def number_cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """position, value: one row per row and column."""
    return df.select(F.posexplode(F.array(*[number(x) for x in names])).alias("position", "value"))


def category_cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """position, key: one row per row and column, the key as text."""
    return df.select(F.posexplode(F.array(*[category(x) for x in names])).alias("position", "key"))


def _kind_of_key() -> Column:
    return F.when(F.col("key").isNull(), ABSENT).otherwise(VALUE).alias("kind")


def constants(values: Sequence[float]) -> Column:
    """An array of doubles; from one text, since a plan with a literal per number is slow to build."""
    return F.split(F.lit(",".join(map(str, map(float, values)))), ",").cast("array<double>")


def binned_cells(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """position, ord, value: every number of the columns with its bin (see add_bin).

    The inner edges of all columns stand one after the other in one array, padded to a power of two less one. A bin is
    found by as many comparisons as that power, each a step of its own, so the code is the same for any number of columns.
    """
    names = list(edges)
    inner = [list(map(float, edges[x][1:-1])) for x in names]
    steps = max(1, max(map(len, inner)).bit_length())
    width = (1 << steps) - 1
    # NaN is above all numbers
    table = constants([e for found in inner for e in [*found, *[nan] * (width - len(found))]])
    cells = number_cells(df, names).withColumn("sought", without_nan(F.col("value"))).withColumn("ord", F.lit(0))
    for i in reversed(range(steps)):
        edge = F.get(table, F.col("position") * width + F.col("ord") + ((1 << i) - 1))
        cells = cells.withColumn("ord", F.when(edge <= F.col("sought"), F.col("ord") + (1 << i)).otherwise(F.col("ord")))
    inside = F.col("sought").isNotNull()
    if any(edges[x][0] > -inf or edges[x][-1] < inf for x in names):
        low, high = (F.get(constants([edges[x][at] for x in names]), F.col("position")) for at in (0, -1))
        inside &= F.col("sought").between(low, high)
    return cells.select("position", F.when(inside, F.col("ord")).otherwise(NO_NUMBER_BIN).alias("ord"), "value")


def _require_names(names: Sequence[str] | Mapping) -> None:
    if not names:
        raise ValueError("no features given")
