"""Fit a baseline, compare tables with it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import BIN, column, key_label, share
from ..operators import categories, divergence
from ..operators.cardinality import cardinality_sketches, estimated_cardinality
from ..operators.counting import category_counts, numeric_counts
from ..operators.features import (
    is_numeric,
    present,
    require_features,
    require_numeric,
    resolve_features,
    schema_types,
)
from ..operators.quantiles import bin_edges, quantile_sketches, quantile_vectors, sketch_quantiles, vectors
from ..operators.schema_diff import compare_schemas, schema_changes, schema_table
from ..settings import Settings
from ..sources.shared import Scratch
from ..sources.tables import TableStore, literal_table, load_bucketed, save_bucketed
from .profiling import categorical_profile, known_categories, numeric_profile, profile_bins
from .report import Report, build_report, feature_metrics

COUNTS_SCHEMA = (
    "feature string, feature_type string, kind string, ord int, key string, n bigint, n_valued bigint"
)


SKETCH_SCHEMA = "feature string, n bigint, sketch binary"

KEY_SCHEMA = "feature string, kind string, key string, n bigint"
KEY_COLUMNS = ("feature", "kind", "key")


class Baseline:
    """What is kept of a reference table: its profile (see PROFILE_SCHEMA), its rare categories, its schema, the sketches its
    quantiles come from (SKETCH_SCHEMA; none with exact quantiles), which answer other ranks and merge with those of further rows,
    and all its categories (KEY_SCHEMA), against which new ones are found.

    Only what later plans are built from reaches the driver: bin edges, feature names, and with
    known_in_scan the known categories.
    """

    def __init__(
        self,
        profile: DataFrame,
        schema: Mapping[str, str],
        rare: DataFrame,
        known_in_scan: bool = True,
        sketches: DataFrame | None = None,
        keys: DataFrame | None = None,
    ) -> None:
        self.keys = literal_table(profile.sparkSession, [], KEY_SCHEMA) if keys is None else keys
        self.sketches = literal_table(profile.sparkSession, [], SKETCH_SCHEMA) if sketches is None else sketches
        self.profile = profile
        self.schema = dict(schema)
        self.rare = rare
        self.known = known_categories(profile)

        rows = profile.select("feature_name", "feature_type", "bin_edges", "cardinality").collect()
        self.edges = {r["feature_name"]: list(r["bin_edges"]) for r in rows if r["feature_type"] == "numeric"}
        listed = [r for r in rows if r["feature_type"] == "categorical"]
        self.categorical = [r["feature_name"] for r in listed]
        self.n_keys = sum(r["cardinality"] for r in listed)
        # {feature: {kind: keys}}, to be tested in scans; without them the known categories are joined
        self.known_lists = categories.key_lists(self.known) if known_in_scan else None

    def save(self, store: TableStore, path: str, mode: str = "overwrite") -> None:
        """Five tables below path: the profile, the rare categories, the sketches, the schema of the whole reference table, and
        its categories, always as Parquet in buckets and always anew, since categories are a whole and can't be appended."""
        spark = self.profile.sparkSession
        store.save(self.sketches, f"{path}/sketches", mode)
        save_bucketed(self.keys, f"{path}/keys", KEY_COLUMNS, self.n_keys)
        store.save(self.rare, f"{path}/rare", mode)
        store.save(self.profile, f"{path}/profile", mode)
        store.save(literal_table(spark, self.schema.items(), "feature string, type string"), f"{path}/schema", mode)

    @classmethod
    def load(cls, spark: SparkSession, store: TableStore, path: str, known_in_scan: bool = True) -> Baseline:
        schema = {r["feature"]: r["type"] for r in store.load(spark, f"{path}/schema").collect()}
        profile, rare, sketches = (store.load(spark, f"{path}/{x}") for x in ("profile", "rare", "sketches"))
        return cls(profile, schema, rare, known_in_scan, sketches, load_bucketed(spark, f"{path}/keys"))


class Monitor:
    """fit(reference) once, then compare(current) as often as wanted.

    Reading: fit scans the watched columns of the reference (numeric ones twice, for edges and for
    counts), compare scans those of the current table once. close(), or the end of a with block, deletes
    what was written for the baseline and the reports: save or read them before.
    """

    def __init__(
        self,
        settings: Settings,
        spark: SparkSession | None = None,
        store: TableStore | None = None,
        folder: str | None = None,
    ) -> None:
        """folder: where tables read more than once are written, shared by all executors; without it the one
        that spark.checkpoint.dir names."""
        self.settings = settings
        self.spark = spark or SparkSession.getActiveSession()
        if self.spark is None:
            raise ValueError("no SparkSession given and none active")
        self.store = store or TableStore("parquet")
        self.scratch = Scratch(self.spark, folder)
        self.baseline: Baseline | None = None

    def __enter__(self) -> Monitor:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.scratch.close()

    def fit(self, reference: DataFrame) -> Monitor:
        self.baseline = fit_baseline(reference, self.settings, self.scratch)
        return self

    def compare(self, current: DataFrame) -> Report:
        return compare(current, self._fitted(), self.settings, self.scratch)

    def schema_changes(self, current: DataFrame) -> DataFrame:
        """feature, status, reference_type, current_type of all columns against the baseline's schema."""
        sides = [schema_table(self.spark, x) for x in (self._fitted().schema, schema_types(current))]
        return schema_changes(*sides)

    def new_categories(self, current: DataFrame, listed: int | None = None) -> DataFrame:
        """feature, category, n of all categories the baseline lacks; with `listed` only that many per feature. Reads the current
        table alone, also where the baseline was loaded."""
        baseline = self._fitted()
        watched = present(current, baseline.categorical)
        if not watched:
            return literal_table(self.spark, [], "feature string, category string, n bigint")
        return categories.categories_not_in(baseline.keys, current, watched, listed)

    def save_baseline(self, path: str, mode: str = "overwrite") -> None:
        self._fitted().save(self.store, path, mode)

    def load_baseline(self, path: str) -> Monitor:
        """Take up a saved baseline instead of fitting."""
        self.baseline = Baseline.load(self.spark, self.store, path, self.settings.known_in_scan)
        return self

    def save_report(self, report: Report, path: str, mode: str = "overwrite") -> None:
        self.store.save(report.feature_metrics, path, mode)

    def save_dataset_summary(self, report: Report, path: str, mode: str = "overwrite") -> None:
        self.store.save(report.dataset_summary, path, mode)

    def _fitted(self) -> Baseline:
        if self.baseline is None:
            raise RuntimeError("no baseline: call fit or load_baseline first")
        return self.baseline


def fit_baseline(reference: DataFrame, settings: Settings, scratch: Scratch | None = None) -> Baseline:
    """Profile the table and write the profile, so that no comparison reads the table again.

    The category counts are written too: the profile and the table of rare categories come from them.
    """
    scratch = scratch or Scratch(reference.sparkSession)
    numeric, categorical = resolve_features(reference, settings)
    require_features(reference, numeric, categorical)
    types = schema_types(reference)
    if settings.copy_watched:
        reference = scratch.pin(watched_columns(reference, numeric + categorical))
    if unwatched := identifiers(reference, categorical, settings):
        categorical = [x for x in categorical if x not in unwatched]
        settings = replace(settings, numeric_features=numeric, categorical_features=categorical, infer_features=False)
    sketches = quantiles = None
    if numeric and not settings.exact_quantiles:
        sketches = scratch.pin(quantile_sketches(reference, numeric, settings.relative_error))
        quantiles = vectors(sketch_quantiles(sketches, settings.n_bins), numeric)
    counts = scratch.pin(category_counts(reference, categorical)) if categorical else None
    profile = scratch.pin(profile_table(reference, settings, counts=counts, quantiles=quantiles))
    rare = rare_table(reference.sparkSession, counts, settings.rare_threshold)
    keys = categories.known_keys(counts) if categorical else None
    return Baseline(profile, types, rare, settings.known_in_scan, sketches, keys)


def watched_columns(df: DataFrame, features: Iterable[str]) -> DataFrame:
    return df.select(*[column(x) for x in dict.fromkeys(features)])


def identifiers(df: DataFrame, categorical: list[str], settings: Settings) -> list[str]:
    """Inferred categorical columns that have more than max_inferred_cardinality values by estimate; one scan, no exact count."""
    if not categorical or settings.max_inferred_cardinality is None or settings.categorical_features:
        return []
    sketches = cardinality_sketches(df, categorical, settings.cardinality_error)
    found = estimated_cardinality(sketches).filter(F.col("cardinality") > settings.max_inferred_cardinality)
    # feature names
    return [r["feature"] for r in found.collect()]


def rare_table(spark: SparkSession, counts: DataFrame | None, threshold: float) -> DataFrame:
    """feature, category, n, p of all categories with a share below threshold."""
    if counts is None:
        return literal_table(spark, [], "feature string, category string, n bigint, p double")
    rare = categories.rare_categories(counts, categories.category_totals(counts), threshold)
    return rare.select("feature", key_label(F.col("kind"), F.col("key")).alias("category"), "n", "p")


def compare(current: DataFrame, baseline: Baseline, settings: Settings, scratch: Scratch | None = None) -> Report:
    """Measure current against the baseline. The feature table is written once; all views read it."""
    scratch = scratch or Scratch(current.sparkSession)
    types = schema_types(current)
    if settings.copy_watched:
        watched = present(current, [*baseline.edges, *baseline.categorical])
        # a table without any watched column is not worth a copy
        current = scratch.pin(watched_columns(current, watched)) if watched else current
    measured = measured_features(current, baseline, settings, types)
    return build_report(scratch.pin(feature_metrics(measured, settings)), settings)


def profile_table(
    df: DataFrame,
    settings: Settings,
    baseline: Baseline | None = None,
    counts: DataFrame | None = None,
    quantiles: Mapping[str, list[float]] | None = None,
) -> DataFrame:
    """Profile the watched columns of df; with a baseline, on its features, edges and categories.

    counts, quantiles: the category counts and the quantiles of df, if they are at hand.
    """
    if baseline:
        numeric, categorical = present(df, baseline.edges), present(df, baseline.categorical)
    else:
        numeric, categorical = resolve_features(df, settings)
    require_features(df, numeric, categorical)
    parts = []
    if numeric:
        quantiles = quantiles or quantile_vectors(
            df, numeric, settings.n_bins, settings.relative_error, settings.exact_quantiles
        )
        edges = baseline.edges if baseline else {
            x: bin_edges(q, settings.edge_policy) for x, q in quantiles.items()
        }
        parts.append(numeric_profile(df, {x: edges[x] for x in numeric}, quantiles))
    if categorical:
        parts.append(
            categorical_profile(
                df,
                categorical,
                settings.categorical_top_k,
                baseline.known if baseline else None,
                counts,
            )
        )
    if not parts:
        raise ValueError("no features to watch")
    return reduce(DataFrame.unionByName, parts)


def counts_on_baseline(df: DataFrame, baseline: Baseline, leave_out: Iterable[str] = ()) -> DataFrame:
    """df counted on the baseline's bins and categories (COUNTS_SCHEMA), one scan per column."""
    wanted = df.drop(*leave_out)
    numeric, categorical = present(wanted, baseline.edges), present(wanted, baseline.categorical)
    parts = []
    if numeric:
        parts.append(
            numeric_counts(wanted, {x: baseline.edges[x] for x in numeric}).select(
                "feature",
                F.lit("numeric").alias("feature_type"),
                F.lit(BIN).alias("kind"),
                "ord",
                F.col("ord").cast("string").alias("key"),
                "n",
                "n_valued",
            )
        )
    if categorical:
        counts = categories.projected_counts(wanted, baseline.known, categorical, baseline.known_lists)
        parts.append(
            counts.select(
                "feature",
                F.lit("categorical").alias("feature_type"),
                "kind",
                F.lit(None).cast("int").alias("ord"),
                key_label(F.col("kind"), F.col("key")).alias("key"),
                "n",
                "n_valued",
            )
        )
    if not parts:
        return literal_table(df.sparkSession, [], COUNTS_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def measured_features(
    current: DataFrame, baseline: Baseline, settings: Settings, types: Mapping[str, str] | None = None
) -> DataFrame:
    """Distances, new-category shares and null rates per feature of the baseline; types: those of the whole current table,
    where current has only some of its columns."""
    changes = compare_schemas(baseline.schema, types or schema_types(current))
    strict = settings.schema_policy == "critical"
    if not strict:
        require_numeric(current, present(current, baseline.edges))
    # a numeric column that now holds text cannot be counted on the old bins
    no_number = [x for x in present(current, baseline.edges) if not is_numeric(current, x)]
    unmeasured = [*changes["missing_columns"], *no_number]

    paired = divergence.pair(
        profile_bins(baseline.profile).filter(~F.col("feature").isin(unmeasured)),
        counts_on_baseline(current, baseline, leave_out=no_number),
        carried=["n_valued"],
    )
    rows, valued = F.sum("n_cur"), F.sum("n_valued")
    distances = divergence.distances(
        divergence.align(paired, settings.eps),
        settings.eps,
        extra=[
            (
                categories.new_category_row_share()
                if settings.new_category_weight == "rows"
                else categories.new_category_share()
            ).alias("new_keys"),
            share(rows - valued, rows).alias("missing_cur"),
        ],
    ).drop("feature_type")

    watched = baseline.profile.select(
        F.col("feature_name").alias("feature"),
        "feature_type",
        F.when(F.col("total_count") > 0, F.col("null_proportion")).alias("missing_ref"),
    )
    if not strict:
        watched = watched.filter(~F.col("feature").isin(unmeasured))
    issues = [*changes["missing_columns"], *changes["type_changes"]] if strict else []
    # distances has one row per feature
    return watched.join(F.broadcast(distances), "feature", "left").select(
        "*",
        F.when(F.col("feature_type") == "numeric", 0.0).otherwise(F.col("new_keys")).alias("new_category_share"),
        F.col("feature").isin(issues).alias("schema_issue"),
    )
