"""What the footers of Parquet files tell about their columns, without reading a row."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.values import column, share
from .tables import literal_table

STATISTICS_SCHEMA = "feature string, n bigint, n_valued bigint, lo string, hi string"

# Types whose smallest and largest values stand in footers as they are; texts are cut there, and doubles may lack NaN.
ENDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def footer_aggregate(spark: SparkSession, path: str, columns: Sequence[str] | None = None, pushed: bool = True) -> DataFrame:
    """One row: the number of rows and, per column, how many are not null and, for whole numbers and dates, lo and hi.

    With `pushed` Spark takes them from the footers: it reads Parquet so in its second-generation reader only, which a session
    beside the caller's turns on, so that the caller's settings stay. Footers whose writers left statistics out are an error there.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", str(pushed).lower())
    df = own.read.parquet(path)
    names = _watched(df, columns)
    wanted = [F.count("*").alias("n")]
    for i, x in enumerate(names):
        wanted.append(F.count(column(x)).alias(f"n{i}"))
        if isinstance(df.schema[x].dataType, ENDS):
            wanted += [F.min(column(x)).alias(f"lo{i}"), F.max(column(x)).alias(f"hi{i}")]
    return df.select(*[column(x) for x in names]).agg(*wanted)


def footer_statistics(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, n, n_valued, null_rate, lo, hi of each column of a Parquet table, lo and hi as text.

    From footers where they hold all that is asked for, else by one scan of the columns. Nested columns have no count of
    their own and are left out. A table without rows has null rates of null. Only one row reaches the driver.
    """
    try:
        row = footer_aggregate(spark, path, columns).first().asDict()
    except (PySparkException, Py4JJavaError) as error:
        # Spark names this setting where a footer lacks what it needs
        if "aggregatePushdown" not in str(error):
            raise
        row = footer_aggregate(spark, path, columns, pushed=False).first().asDict()
    names = _watched(spark.read.parquet(path), columns)
    text = lambda value: None if value is None else str(value)
    # files without row groups have no count to add up
    n = row["n"] or 0
    found = [(x, n, row[f"n{i}"] or 0, text(row.get(f"lo{i}")), text(row.get(f"hi{i}"))) for i, x in enumerate(names)]
    rate = share(F.col("n") - F.col("n_valued"), F.col("n"))
    return literal_table(spark, found, STATISTICS_SCHEMA).select("feature", "n", "n_valued", rate.alias("null_rate"), "lo", "hi")


def _watched(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    names = df.columns if columns is None else list(columns)
    return [x for x in names if not isinstance(df.schema[x].dataType, nested)]
