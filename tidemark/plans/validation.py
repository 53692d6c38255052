"""One call that tells how two tables differ before any distribution is measured."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.categories import new_categories
from ..operators.features import infer_features, present, schema_types
from ..operators.schema_diff import column_quality, schema_changes, schema_table
from ..sources.tables import literal_table


@dataclass(frozen=True)
class Validation:
    """schema: status of every column of either table; quality: null rates of the common ones; new_categories:
    categories of the current table that the reference lacks."""

    schema: DataFrame
    quality: DataFrame
    new_categories: DataFrame

    def findings(self) -> DataFrame:
        """feature, finding, detail, n: columns gone, added or retyped, and new categories with their rows, in one table."""
        changed = self.schema.filter("status <> 'OK'").select(
            "feature",
            F.lower("status").alias("finding"),
            F.concat(F.coalesce("reference_type", F.lit("-")), F.lit(" > "), F.coalesce("current_type", F.lit("-"))).alias("detail"),
            F.lit(None).cast("bigint").alias("n"),
        )
        found = self.new_categories.select("feature", F.lit("new_category").alias("finding"), F.col("category").alias("detail"), "n")
        return changed.unionByName(found)


def validate(reference: DataFrame, current: DataFrame, categorical: Sequence[str] | None = None) -> Validation:
    """Compare schemas, null rates and categories; without a list, all text and boolean columns are categorical."""
    spark = reference.sparkSession
    watched = infer_features(reference)[1] if categorical is None else categorical
    watched = present(current, present(reference, watched))
    unseen = (
        new_categories(reference, current, watched)
        if watched
        else literal_table(spark, [], "feature string, category string, n bigint")
    )
    return Validation(
        schema_changes(*[schema_table(spark, schema_types(x)) for x in (reference, current)]),
        column_quality(reference, current),
        unseen,
    )
