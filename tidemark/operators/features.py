"""Which columns are watched, and as what. Works on the schema alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, types as T

from ..settings import Settings
from ..sources.tables import literal_table


def infer_features(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric columns, and text or boolean columns, in schema order. Other types are left out."""
    kinds = [(f.name, _kind(f.dataType)) for f in df.schema.fields]
    return (
        [name for name, kind in kinds if kind == "numeric"],
        [name for name, kind in kinds if kind == "categorical"],
    )


def feature_table(spark: SparkSession, numeric: Iterable[str], categorical: Iterable[str]) -> DataFrame:
    rows = [(x, "numeric") for x in numeric] + [(x, "categorical") for x in categorical]
    return literal_table(spark, rows, "feature string, feature_type string")


def resolve_features(df: DataFrame, settings: Settings) -> tuple[list[str], list[str]]:
    """The features named in the settings; inference fills only a list that is empty."""
    numeric, categorical = list(settings.numeric_features), list(settings.categorical_features)
    if settings.infer_features:
        found_numeric, found_categorical = infer_features(df)
        numeric = numeric or [x for x in found_numeric if x not in categorical]
        categorical = categorical or [x for x in found_categorical if x not in numeric]
    return numeric, categorical


def require_features(df: DataFrame, numeric: Iterable[str], categorical: Iterable[str]) -> None:
    """Stop before any job when a feature is not there or cannot be binned."""
    missing = [x for x in [*numeric, *categorical] if x not in df.columns]
    if missing:
        raise ValueError(f"features not in the table: {missing}")
    require_numeric(df, numeric)


def require_numeric(df: DataFrame, numeric: Iterable[str]) -> None:
    wrong = [x for x in numeric if not is_numeric(df, x)]
    if wrong:
        raise ValueError(f"features named as numeric are of another type: {wrong}")


def is_numeric(df: DataFrame, feature: str) -> bool:
    return _kind(df.schema[feature].dataType) == "numeric"


def present(df: DataFrame, features: Iterable[str]) -> list[str]:
    return [x for x in features if x in df.columns]


def schema_types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def _kind(data_type: T.DataType) -> str | None:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.BooleanType)):
        return "categorical"
    return None
