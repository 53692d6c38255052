"""Differences of two schemas and of the null rates of their common columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import column, share
from ..sources.tables import literal_table
from .features import schema_types

# Counters of one aggregate.
COLUMNS_PER_AGGREGATE = 64

QUALITY_SCHEMA = (
    "feature string, status string, reference_type string, current_type string, "
    "missing_ref double, missing_cur double, missing_delta double"
)


def schema_table(spark: SparkSession, types: dict[str, str]) -> DataFrame:
    return literal_table(spark, sorted(types.items()), "feature string, type string")


def schema_changes(reference: DataFrame, current: DataFrame) -> DataFrame:
    """feature, status, reference_type, current_type for two schema tables.

    status: MISSING (only in reference), UNEXPECTED (only in current), TYPE_CHANGED or OK. Whether
    a column may be null plays no part.
    """
    before, after = F.col("reference_type"), F.col("current_type")
    status = (
        F.when(after.isNull(), "MISSING")
        .when(before.isNull(), "UNEXPECTED")
        .when(before != after, "TYPE_CHANGED")
        .otherwise("OK")
    )
    return (
        reference.withColumnRenamed("type", "reference_type")
        .join(current.withColumnRenamed("type", "current_type"), "feature", "full_outer")
        .select("feature", status.alias("status"), before, after)
    )


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature, null_rate of each column in one scan; null for a table without rows. NaN is not null.

    Up to COLUMNS_PER_AGGREGATE columns have a counter each in one aggregate; rows of more columns are unfolded to
    (position, has a value), since the code of so many counters is more than the JVM compiles.
    """
    names = df.columns if columns is None else columns
    if not names:
        return literal_table(df.sparkSession, [], "feature string, null_rate double")
    if len(names) <= COLUMNS_PER_AGGREGATE:
        rows = df.agg(
            F.count("*").alias("rows"), *[F.count(column(x)).alias(f"n{i}") for i, x in enumerate(names)]
        )
        rate = lambda i: share(F.col("rows") - F.col(f"n{i}"), F.col("rows"))
        cells = [F.struct(F.lit(x).alias("feature"), rate(i).alias("null_rate")) for i, x in enumerate(names)]
        return rows.select(F.inline(F.array(*cells)))
    cells = df.select(F.posexplode(F.array(*[column(x).isNull().cast("int") for x in names])).alias("position", "absent"))
    counts = cells.groupBy("position").agg(share(F.sum("absent"), F.count("*")).alias("null_rate"))
    # one row per column
    every = literal_table(df.sparkSession, list(enumerate(names)), "position int, feature string")
    return every.join(F.broadcast(counts), "position", "left").select("feature", "null_rate")


def column_quality(reference: DataFrame, current: DataFrame) -> DataFrame:
    """One row per common column: type status and null rates of both tables (QUALITY_SCHEMA)."""
    spark = reference.sparkSession
    before, after = schema_types(reference), schema_types(current)
    common = sorted(before.keys() & after.keys())
    if not common:
        return literal_table(spark, [], QUALITY_SCHEMA)
    changes = schema_changes(schema_table(spark, before), schema_table(spark, after))
    rates = [
        null_rates(df, common).withColumnRenamed("null_rate", name)
        for df, name in ((reference, "missing_ref"), (current, "missing_cur"))
    ]
    return (
        changes.join(rates[0], "feature")
        .join(rates[1], "feature")
        .select("*", (F.col("missing_cur") - F.col("missing_ref")).alias("missing_delta"))
    )


def compare_schemas(reference: dict[str, str], current: dict[str, str]) -> dict[str, list[str]]:
    """The same differences as plain lists, from two {column: type} maps, without a job."""
    common = reference.keys() & current.keys()
    return {
        "missing_columns": sorted(reference.keys() - common),
        "unexpected_columns": sorted(current.keys() - common),
        "type_changes": sorted(x for x in common if reference[x] != current[x]),
    }
