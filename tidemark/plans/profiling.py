"""The profile of a table: one typed row per watched column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.values import BIN, VALUE, key_label, share
from ..operators.categories import category_bins, category_totals, most_frequent, project
from ..operators.counting import category_counts, numeric_counts
from ..operators.features import schema_types
from ..sources.tables import literal_table

PROFILE_SCHEMA = (
    "feature_name string, feature_type string, data_type string, count bigint, total_count bigint, "
    "null_count bigint, null_proportion double, min double, max double, quantiles array<double>, "
    "bin_edges array<double>, "
    "bins array<struct<kind: string, key: string, ord: int, n: bigint, p: double>>, "
    "cardinality bigint"
)


def numeric_histogram(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """feature, ord, n, p: rows and share of each bin; rows without a number (bin -1) are part of the whole."""
    counts = numeric_counts(df, edges).select("feature", "ord", "n")
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    # totals: one row per feature
    return counts.join(F.broadcast(totals), "feature").select(
        "feature", "ord", "n", share(F.col("n"), F.col("total")).alias("p")
    )


def numeric_profile(
    df: DataFrame, edges: Mapping[str, Sequence[float]], quantiles: Mapping[str, Sequence[float]]
) -> DataFrame:
    """Profile rows of numeric columns. edges may be another table's, to bin both alike."""
    found = (
        numeric_counts(df, edges)
        .groupBy("feature")
        .agg(
            F.sum("n_valued").alias("count"),
            F.sum("n").alias("total_count"),
            F.min("lo").alias("min"),
            F.max("hi").alias("max"),
            F.array_sort(F.collect_list(F.struct("ord", "n"))).alias("counts"),
        )
    )
    types = schema_types(df)
    given = literal_table(
        df.sparkSession,
        [(x, types[x], [float(q) for q in quantiles.get(x, ())], [float(e) for e in edges[x]]) for x in edges],
        "feature string, data_type string, quantiles array<double>, bin_edges array<double>",
    )
    # found has one row per feature and none for an empty table
    return _profile_rows(
        given.join(F.broadcast(found), "feature", "left").select(
            "*",
            F.lit("numeric").alias("feature_type"),
            F.transform(
                "counts",
                lambda x: F.struct(
                    F.lit(BIN).alias("kind"),
                    x["ord"].cast("string").alias("key"),
                    x["ord"].alias("ord"),
                    x["n"].alias("n"),
                    share(x["n"], F.col("total_count")).alias("p"),
                ),
            ).alias("bins"),
            F.lit(None).cast("bigint").alias("cardinality"),
        )
    )


def categorical_profile(
    df: DataFrame,
    features: Sequence[str],
    top_k: int,
    known: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Profile rows of categorical columns, on the top_k of df itself or on a known list.

    All tables below come from the same counts, so they share one scan and its shuffle. counts: what
    category_counts gives for df, if it is at hand.
    """
    counts = category_counts(df, features) if counts is None else counts
    totals = category_totals(counts)
    if known is None:
        entries = most_frequent(counts, top_k)
    else:
        by_size = Window.partitionBy("feature").orderBy(F.col("n").desc(), "kind", "key")
        entries = project(counts, known).withColumn("position", F.row_number().over(by_size))
    bins = category_bins(entries, totals)
    types = schema_types(df)
    given = literal_table(df.sparkSession, [(x, types[x]) for x in features], "feature string, data_type string")
    # one row per feature on every side, but bins hold texts of any length: no broadcast asked for
    return _profile_rows(
        given.join(totals, "feature", "left")
        .join(bins, "feature", "left")
        .select(
            "feature",
            "data_type",
            "total_count",
            F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
            "bins",
            F.lit("categorical").alias("feature_type"),
            (F.col("total_count") - F.col("null_count")).alias("count"),
            *[F.lit(None).cast("double").alias(x) for x in ("min", "max")],
            *[F.lit(None).cast("array<double>").alias(x) for x in ("quantiles", "bin_edges")],
        )
    )


def profile_bins(profile: DataFrame) -> DataFrame:
    """The bins of a profile in long form: feature, feature_type, kind, ord, key, n, p."""
    return profile.select(
        F.col("feature_name").alias("feature"), "feature_type", F.explode("bins").alias("b")
    ).select("feature", "feature_type", "b.kind", "b.ord", "b.key", "b.n", "b.p")


def known_categories(profile: DataFrame) -> DataFrame:
    """feature, kind, key of the categories a profile lists, the key null unless it is a value."""
    return (
        profile_bins(profile)
        .filter(F.col("feature_type") == "categorical")
        .select("feature", "kind", F.when(F.col("kind") == VALUE, F.col("key")).alias("key"))
    )


def _profile_rows(rows: DataFrame) -> DataFrame:
    count = F.coalesce("count", F.lit(0))
    total = F.coalesce("total_count", F.lit(0))
    filled = {
        "feature_name": F.col("feature"),
        "count": count,
        "total_count": total,
        "null_count": total - count,
        "null_proportion": F.coalesce(share(total - count, total), F.lit(0.0)),
        "bins": F.coalesce("bins", F.array()),
    }
    wanted = T.StructType.fromDDL(PROFILE_SCHEMA)
    return rows.select(
        *[filled.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in wanted.fields]
    )
