"""Tables in and out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "delta")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header line. Give a schema for large files: inferring it reads everything once more."""
    if schema:
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.csv(path, header=True, inferSchema=True)


def literal_table(spark: SparkSession, rows: Sequence, ddl: str) -> DataFrame:
    """A small table written out in the program (names, schemas, edges), in one partition; may be empty."""
    return spark.createDataFrame(list(rows), ddl).coalesce(1)


class TableStore:
    """Saves and loads tables in one format. Delta needs its package on the session's class path."""

    def __init__(self, format: str = "parquet") -> None:
        self.format = format.lower()
        if self.format not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}, not {format!r}")

    def save(self, df: DataFrame, path: str, mode: str = "overwrite") -> None:
        df.write.format(self.format).mode(mode).save(path)

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.format(self.format).load(path)


# Rows of a stored bucket, and the least number of buckets: a table joined with them may have many more rows. Empty ones have no file.
ROWS_PER_BUCKET, LEAST_BUCKETS = 200_000, 64


def save_bucketed(df: DataFrame, path: str, keys: Sequence[str], rows: int) -> None:
    """Write df to path as Parquet in buckets of its keys, at most about ROWS_PER_BUCKET rows each; rows: how many df has.

    A join on these keys reads the buckets as they lie. What path held before is replaced. The number of buckets stands
    in a table beside, path + '-layout'.
    """
    spark, buckets = df.sparkSession, max(LEAST_BUCKETS, ceil(rows / ROWS_PER_BUCKET))
    name = _bucketed(spark, df.schema.toDDL(), path, keys, buckets)
    try:
        df.repartition(buckets, *keys).write.insertInto(name, overwrite=True)
    finally:
        spark.sql(f"DROP TABLE {name}")
    layout = literal_table(spark, [(df.schema.toDDL(), list(keys), buckets)], "ddl string, keys array<string>, buckets int")
    layout.write.mode("overwrite").parquet(f"{path}-layout")


def load_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """What save_bucketed wrote, with its buckets known to the optimizer."""
    layout = spark.read.parquet(f"{path}-layout").first()
    name = _bucketed(spark, layout["ddl"], path, layout["keys"], layout["buckets"])
    try:
        return spark.table(name)
    finally:
        # the table's files and buckets are resolved by now; the name was only needed to tell Spark of them
        spark.sql(f"DROP TABLE {name}")


def _bucketed(spark: SparkSession, ddl: str, path: str, keys: Sequence[str], buckets: int) -> str:
    """A name for the bucketed Parquet files of a folder, which stay when the name is dropped."""
    name, location = f"tidemark_{uuid.uuid4().hex}", path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) "
        f"INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return name
