"""Pairs of tables to compare: one table cut into a reference and a current part, some with a shift.

Each condition and expression is plain SQL that Spark and DuckDB read alike, so the same text
builds the Spark side and the checking query.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import Settings


@dataclass(frozen=True)
class Case:
    table: str
    reference: str
    current: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    top_k: int = 50
    shifted: dict[str, str] = field(default_factory=dict)

    def settings(self, **changes) -> Settings:
        """Exact quantiles, so that SQL can reproduce the edges."""
        given = dict(
            numeric_features=self.numeric,
            categorical_features=self.categorical,
            categorical_top_k=self.top_k,
            exact_quantiles=True,
        )
        return Settings(**{**given, **changes})

    def reference_df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.table).filter(self.reference)

    def current_df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        part = table(spark, sf_dir, self.table).filter(self.current)
        return part.withColumns({name: F.expr(sql) for name, sql in self.shifted.items()})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Prices rise by 30 %; the other columns stay as they are.
LINEITEM = Case(
    table="lineitem",
    reference="l_shipdate < CAST('1998-07-01' AS DATE)",
    current="l_shipdate >= CAST('1998-07-01' AS DATE)",
    numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    categorical=("l_returnflag", "l_linestatus", "l_linenumber"),
    top_k=20,
    shifted={"l_extendedprice": "l_extendedprice * CAST(1.3 AS DOUBLE)"},
)

# A smaller rise, which only some of the metrics notice.
LINEITEM_MILD = Case(
    table="lineitem",
    reference="l_shipdate < CAST('1998-07-01' AS DATE)",
    current="l_shipdate >= CAST('1998-07-01' AS DATE)",
    numeric=("l_extendedprice",),
    shifted={"l_extendedprice": "l_extendedprice * CAST(1.1 AS DOUBLE)"},
)

# Values go missing for one type of event; props has more categories than are listed.
EVENTS = Case(
    table="events",
    reference="ts < CAST('2024-01-16' AS DATE)",
    current="ts >= CAST('2024-01-16' AS DATE)",
    numeric=("value",),
    categorical=("event_type", "props"),
    top_k=20,
    shifted={
        "value": "CASE WHEN event_type <> 'click' THEN value END",
        "props": "CASE WHEN event_type <> 'view' THEN props END",
    },
)

# The reference lacks one of five priorities: exactly on the bound of the critical level.
ORDERS = Case(
    table="orders",
    reference="o_orderpriority <> '1-URGENT'",
    current="o_orderkey IS NOT NULL",
    numeric=("o_totalprice",),
    categorical=("o_orderpriority", "o_orderstatus"),
)

DOCUMENTS = Case(
    table="documents",
    reference="n_chars < 500",
    current="n_chars >= 500",
    categorical=("lang", "source"),
)

DOCUMENT_LENGTHS = Case(
    table="documents",
    reference="lang = 'en'",
    current="lang <> 'en'",
    numeric=("n_chars",),
    categorical=("source",),
)

PARTS = Case(
    table="part",
    reference="p_size <= 25",
    current="p_size > 25",
    numeric=("p_retailprice",),
    categorical=("p_brand", "p_type"),
    top_k=30,
)

# Single-table operators run on all rows.
EVERY_LINEITEM = replace(LINEITEM, reference="true", current="true", shifted={})
EVERY_EVENT = replace(EVENTS, reference="true", current="true", shifted={})
EVERY_DOCUMENT = replace(DOCUMENT_LENGTHS, reference="true", current="true")
EVERY_PART = replace(PARTS, reference="true", current="true")

# Columns with few distinct values, whose quantiles a sketch of a small error finds exactly.
LINEITEM_SKETCHED = replace(
    LINEITEM, numeric=("l_discount", "l_tax"), shifted={"l_discount": "l_discount * CAST(1.3 AS DOUBLE)"}
)

LABELS = Case(
    table="labels",
    reference="doc_id % 2 = 0",
    current="doc_id % 2 = 1",
    numeric=("doc_id", "quality", "toxic"),
)
