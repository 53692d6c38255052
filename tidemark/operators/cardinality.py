"""How many different values a column has, estimated from sketches that are small, stored and merged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame, functions as F

from .counting import category_cells, name_at

# The sizes of HyperLogLog sketches Spark takes, as powers of two.
SMALLEST, LARGEST = 4, 21

SKETCH_SCHEMA = "feature string, n bigint, n_valued bigint, sketch binary"


def sketch_size(error: float) -> int:
    """The power of two of the smallest sketch whose relative error stays within `error` at three standard deviations.

    The standard deviation of merged sketches of 2^p registers is 1.04 / sqrt(2^p).
    """
    if not 0 < error < 1:
        raise ValueError("error must lie in (0, 1)")
    power = max(SMALLEST, ceil(2 * log2(3 * 1.04 / error)))
    if power > LARGEST:
        raise ValueError(f"no sketch keeps within {error}: count the categories exactly")
    return power


def cardinality_sketches(df: DataFrame, features: Sequence[str], error: float) -> DataFrame:
    """feature, n, n_valued, sketch of each column, in one scan; one sketch per task and column is shuffled.

    Values enter by 64-bit hashes of their text, so an empty text counts like any other.
    """
    if not features:
        raise ValueError("no features given")
    hashed = F.when(F.col("key").isNotNull(), F.xxhash64("key"))
    return (
        category_cells(df, features)
        .withColumn("hashed", hashed)
        .groupBy("position")
        .agg(
            F.count("*").alias("n"),
            F.count("hashed").alias("n_valued"),
            F.hll_sketch_agg("hashed", sketch_size(error)).alias("sketch"),
        )
        .select(name_at(features), "n", "n_valued", "sketch")
    )


def merged_cardinality_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of all rows of several tables, for example of one table per day; sizes may differ, the smallest one counts."""
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("feature")
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_valued").alias("n_valued"),
            F.hll_union_agg("sketch", True).alias("sketch"),
        )
    )


def estimated_cardinality(sketches: DataFrame) -> DataFrame:
    """feature, cardinality: like the exact one, the missing category counts as one."""
    missing = (F.col("n") > F.col("n_valued")).cast("bigint")
    return sketches.select("feature", (F.hll_sketch_estimate("sketch") + missing).alias("cardinality"))
