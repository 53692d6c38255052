"""name -> (Spark query, checking SQL). Rounded doubles and fixed column names on both sides."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import sql
from checks.cases import (
    DOCUMENT_LENGTHS,
    DOCUMENTS,
    EVENTS,
    EVERY_DOCUMENT,
    EVERY_EVENT,
    EVERY_LINEITEM,
    EVERY_PART,
    LABELS,
    LINEITEM,
    LINEITEM_MILD,
    LINEITEM_SKETCHED,
    ORDERS,
    PARTS,
    Case,
    table,
)
from checks.sql import chain, r
from tidemark import Monitor, Settings, TableStore, fit_baseline, profile_table, validate
from tidemark.functions import severity as s
from tidemark.functions.values import key_label, number, share
from tidemark.operators import cardinality, categories, counting, curves, divergence, features, quantiles, schema_diff
from tidemark.plans.monitor import Baseline, compare, counts_on_baseline, measured_features
from tidemark.plans.profiling import numeric_histogram, profile_bins
from tidemark.sources import footers
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import literal_table, read_csv

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, checking_sql: str) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        SQL[name] = " ".join(checking_sql.split())
        return query

    return keep


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.round(f.name, 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/check-{uuid4().hex}"


def reference_edges(case: Case, spark: SparkSession, sf_dir: str) -> dict[str, list[float]]:
    found = quantiles.quantile_vectors(case.reference_df(spark, sf_dir), case.numeric, sql.BINS, 0.01, exact=True)
    return {x: quantiles.bin_edges(q) for x, q in found.items()}


def measured(case: Case, spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    settings = case.settings(**changes)
    baseline = fit_baseline(case.reference_df(spark, sf_dir), settings)
    return measured_features(case.current_df(spark, sf_dir), baseline, settings)


def report(case: Case, spark: SparkSession, sf_dir: str):
    monitor = Monitor(case.settings(), spark).fit(case.reference_df(spark, sf_dir))
    return monitor.compare(case.current_df(spark, sf_dir))


# ---- sources and sinks


@register(
    "csv_scan",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def csv_scan(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "customer").write.csv(path, header=True)
    return read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@register("parquet_roundtrip", "SELECT * FROM part")
def parquet_roundtrip(spark, sf_dir):
    store, path = TableStore("Parquet"), scratch(spark)
    store.save(table(spark, sf_dir, "part"), path)
    return store.load(spark, path)


PROFILE_SQL = chain(
    EVERY_EVENT,
    """SELECT feature AS feature_name, 'numeric' AS feature_type, count(v) AS count, count(*) AS total_count,
              count(*) - count(v) AS null_count, (count(*) - count(v)) / count(*) AS null_proportion,
              min(v) AS min, max(v) AS max, CAST(NULL AS BIGINT) AS cardinality,
              CAST(NULL AS BIGINT) AS rare_categories
       FROM ref_numbers GROUP BY feature
       UNION ALL
       SELECT feature, 'categorical', CAST(sum(CASE WHEN key IS NOT NULL THEN n ELSE 0 END) AS BIGINT),
              CAST(sum(n) AS BIGINT), CAST(sum(CASE WHEN key IS NULL THEN n ELSE 0 END) AS BIGINT),
              sum(CASE WHEN key IS NULL THEN n ELSE 0 END) / sum(n), NULL, NULL, count(*),
              count(*) FILTER (WHERE n < 0.01 * total)
       FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS total FROM ref_counts) GROUP BY feature""",
)


@register("profile_roundtrip", PROFILE_SQL)
def profile_roundtrip(spark, sf_dir):
    path = scratch(spark)
    with Monitor(EVERY_EVENT.settings(), spark) as monitor:
        monitor.fit(EVERY_EVENT.reference_df(spark, sf_dir)).save_baseline(path)
    loaded = Baseline.load(spark, monitor.store, path)
    rare = loaded.rare.groupBy("feature").agg(F.count("*").alias("rare_categories"))
    profile = loaded.profile.join(rare, F.col("feature_name") == F.col("feature"), "left")
    rare = F.when(F.col("feature_type") == "categorical", F.coalesce("rare_categories", F.lit(0)))
    return profile.select(
        "feature_name",
        "feature_type",
        "count",
        "total_count",
        "null_count",
        "null_proportion",
        "min",
        "max",
        "cardinality",
        rare.alias("rare_categories"),
    )


def with_text(select: str) -> str:
    """advice codes replaced by the text shown in reports"""
    whens = " ".join(f"WHEN '{code}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for code, text in s.ADVICE.items())
    return select.replace("advice", f"CASE advice {whens} END AS recommendation")


FEATURE_METRICS = with_text(sql.FEATURE_METRICS)


@register("report_roundtrip", chain(ORDERS, FEATURE_METRICS))
def report_roundtrip(spark, sf_dir):
    store, path = TableStore(), scratch(spark)
    store.save(rounded(report(ORDERS, spark, sf_dir).feature_metrics), path)
    return store.load(spark, path)


@register("summary_roundtrip", chain(PARTS, sql.DATASET_SUMMARY))
def summary_roundtrip(spark, sf_dir):
    monitor = Monitor(PARTS.settings(), spark).fit(PARTS.reference_df(spark, sf_dir))
    path = scratch(spark)
    monitor.save_dataset_summary(monitor.compare(PARTS.current_df(spark, sf_dir)), path)
    return rounded(monitor.store.load(spark, path))


@register("compare_with_saved_baseline", chain(PARTS, FEATURE_METRICS))
def compare_with_saved_baseline(spark, sf_dir):
    path = scratch(spark)
    Monitor(PARTS.settings(), spark).fit(PARTS.reference_df(spark, sf_dir)).save_baseline(path)
    monitor = Monitor(PARTS.settings(), spark).load_baseline(path)
    return rounded(monitor.compare(PARTS.current_df(spark, sf_dir)).feature_metrics)


# ---- features and schema


def _types_sql(name: str, types: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{kind}' AS feature_type, count({c}) AS n_valued FROM {name}"
        for c, kind in types.items()
    )


@register(
    "infer_features",
    _types_sql(
        "lineitem",
        {
            **{c: "numeric" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")},
            **{c: "numeric" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
            **{c: "categorical" for c in ("l_returnflag", "l_linestatus")},
        },
    ),
)
def infer_features(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = features.feature_table(spark, *features.resolve_features(df, Settings(infer_features=True)))
    n = df.agg(F.count("*").alias("n"))
    rates = schema_diff.null_rates(df)
    valued = rates.select("feature", F.round((1 - F.col("null_rate")) * n.scalar()).cast("bigint").alias("n_valued"))
    return found.join(F.broadcast(valued), "feature")


def changed_customer(spark, sf_dir):
    """A column gone, one added, one of another type, and nulls in one."""
    return (
        table(spark, sf_dir, "customer")
        .drop("c_name")
        .withColumn("c_region", F.lit("here"))
        .withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
        .withColumn("c_acctbal", F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END"))
    )


@register(
    "schema_diff",
    """SELECT t.*, n AS n_rows FROM (VALUES
         ('c_name', 'MISSING', 'string', NULL), ('c_region', 'UNEXPECTED', NULL, 'string'),
         ('c_nationkey', 'TYPE_CHANGED', 'int', 'string'), ('c_custkey', 'OK', 'bigint', 'bigint'),
         ('c_acctbal', 'OK', 'double', 'double'), ('c_mktsegment', 'OK', 'string', 'string')
       ) AS t(feature, status, reference_type, current_type), (SELECT count(*) AS n FROM customer)""",
)
def schema_changes(spark, sf_dir):
    before, after = table(spark, sf_dir, "customer"), changed_customer(spark, sf_dir)
    changes = schema_diff.schema_changes(
        *[schema_diff.schema_table(spark, features.schema_types(x)) for x in (before, after)]
    )
    return changes.withColumn("n_rows", after.agg(F.count("*")).scalar())


@register(
    "column_quality",
    f"""SELECT feature, status, reference_type, current_type, {r('missing_ref')} AS missing_ref,
               {r('missing_cur')} AS missing_cur, {r('missing_cur - missing_ref')} AS missing_delta
        FROM (
          SELECT 'c_nationkey' AS feature, 'TYPE_CHANGED' AS status, 'int' AS reference_type, 'string' AS current_type,
                 avg(CAST(c_nationkey IS NULL AS DOUBLE)) AS missing_ref,
                 avg(CAST(c_nationkey IS NULL AS DOUBLE)) AS missing_cur FROM customer
          UNION ALL SELECT 'c_custkey', 'OK', 'bigint', 'bigint', avg(CAST(c_custkey IS NULL AS DOUBLE)),
                 avg(CAST(c_custkey IS NULL AS DOUBLE)) FROM customer
          UNION ALL SELECT 'c_acctbal', 'OK', 'double', 'double', avg(CAST(c_acctbal IS NULL AS DOUBLE)),
                 avg(CAST(c_acctbal IS NULL OR c_acctbal < 0 AS DOUBLE)) FROM customer
          UNION ALL SELECT 'c_mktsegment', 'OK', 'string', 'string', avg(CAST(c_mktsegment IS NULL AS DOUBLE)),
                 avg(CAST(c_mktsegment IS NULL AS DOUBLE)) FROM customer)""",
)
def column_quality(spark, sf_dir):
    return rounded(schema_diff.column_quality(table(spark, sf_dir, "customer"), changed_customer(spark, sf_dir)))


@register(
    "null_rates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'avg(CAST({e} IS NULL AS DOUBLE))')} AS null_rate FROM events"
        for c, e in {
            "event_id": "event_id",
            "ts": "ts",
            "user_id": "user_id",
            "event_type": "event_type",
            **EVENTS.shifted,
        }.items()
    ),
)
def null_rates(spark, sf_dir):
    shifted = table(spark, sf_dir, "events").withColumns({c: F.expr(e) for c, e in EVENTS.shifted.items()})
    return rounded(schema_diff.null_rates(shifted))


NEW_CATEGORIES = """SELECT c.feature, coalesce(c.key, '__MISSING__') AS category, c.n
           FROM cur_counts c WHERE NOT EXISTS (
             SELECT 1 FROM ref_counts k WHERE k.feature = c.feature AND k.key IS NOT DISTINCT FROM c.key)"""


@register("new_categories", chain(ORDERS, NEW_CATEGORIES))
def new_categories(spark, sf_dir):
    return categories.new_categories(
        ORDERS.reference_df(spark, sf_dir), ORDERS.current_df(spark, sf_dir), ORDERS.categorical
    )


@register(
    "new_categories_many",
    """SELECT 'c_name' AS feature, c_name AS category, count(*) AS n FROM customer
       WHERE c_acctbal >= 0 AND c_name NOT IN (SELECT c_name FROM customer WHERE c_acctbal < 0)
       GROUP BY c_name""",
)
def new_categories_many(spark, sf_dir):
    """A new category in nearly every row: all of them."""
    df = table(spark, sf_dir, "customer")
    return categories.new_categories(df.filter("c_acctbal < 0"), df.filter("c_acctbal >= 0"), ["c_name"])


@register("new_categories_saved", chain(EVENTS, NEW_CATEGORIES))
def new_categories_saved(spark, sf_dir):
    """Against all categories of a baseline that was saved and loaded; the reference table isn't read again."""
    path = scratch(spark)
    with Monitor(EVENTS.settings(), spark) as monitor:
        monitor.fit(EVENTS.reference_df(spark, sf_dir)).save_baseline(path)
    return Monitor(EVENTS.settings(), spark).load_baseline(path).new_categories(EVENTS.current_df(spark, sf_dir))


@register(
    "footer_statistics",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) AS n, count({c}) AS n_valued, {r(f'avg(CAST({c} IS NULL AS DOUBLE))')} AS null_rate,
                   {f'CAST(min({c}) AS VARCHAR)' if ends else 'NULL'} AS lo, {f'CAST(max({c}) AS VARCHAR)' if ends else 'NULL'} AS hi
            FROM documents"""
        for c, ends in {"doc_id": True, "text": False, "lang": False, "source": False, "n_chars": True}.items()
    ),
)
def footer_statistics(spark, sf_dir):
    """Null rates, minima and maxima without reading a row."""
    return rounded(footers.footer_statistics(spark, f"{sf_dir}/documents.parquet"))


@register(
    "validate",
    f"""WITH ref AS (SELECT * FROM customer), cur AS (SELECT * REPLACE (CASE WHEN c_acctbal >= 0 THEN c_mktsegment
               ELSE 'OVERDRAWN' END AS c_mktsegment) FROM customer)
        SELECT * FROM (VALUES ('c_name', 'missing', 'string > -', NULL), ('c_region', 'unexpected', '- > string', NULL),
               ('c_nationkey', 'type_changed', 'int > string', NULL)) AS t(feature, finding, detail, n)
        UNION ALL
        SELECT 'c_mktsegment', 'new_category', c_mktsegment, count(*) FROM cur
        WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM ref) GROUP BY c_mktsegment""",
)
def validated(spark, sf_dir):
    """Schema, null rates and new categories of two tables by one call."""
    segment = F.expr("CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE 'OVERDRAWN' END")
    current = table(spark, sf_dir, "customer").withColumn("c_mktsegment", segment)
    current = current.drop("c_name").withColumn("c_region", F.lit("here"))
    current = current.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return validate(table(spark, sf_dir, "customer"), current).findings()


# ---- numeric columns


@register(
    "quantiles",
    chain(EVERY_LINEITEM, "SELECT feature, CAST(i AS INTEGER) AS i, v AS quantile FROM q"),
)
def exact_quantiles(spark, sf_dir):
    found = quantiles.exact_quantiles(EVERY_LINEITEM.reference_df(spark, sf_dir), EVERY_LINEITEM.numeric, sql.BINS)
    return found.select("feature", F.posexplode("quantiles").alias("i", "quantile"))


SKETCH_ERROR = 0.01


@register(
    "quantile_sketch_error",
    chain(
        EVERY_LINEITEM,
        f"SELECT DISTINCT feature, CAST(i AS INTEGER) AS i, true AS within_error FROM ref_numbers, range(0, {sql.BINS + 1}) t(i)",
    ),
)
def quantile_sketch_error(spark, sf_dir):
    """For every sketched quantile: is its rank within the allowed error? Counted over the whole table."""
    df = EVERY_LINEITEM.reference_df(spark, sf_dir)
    return _within_error(df, quantiles.quantile_vectors(df, EVERY_LINEITEM.numeric, sql.BINS, SKETCH_ERROR))


@register(
    "saved_sketch_error",
    chain(
        EVERY_LINEITEM,
        f"SELECT DISTINCT feature, CAST(i AS INTEGER) AS i, true AS within_error FROM ref_numbers, range(0, {sql.BINS + 1}) t(i)",
    ),
)
def saved_sketch_error(spark, sf_dir):
    """The same for sketches of two halves of the table: one from a saved baseline, merged with one of the other rows."""
    df = EVERY_LINEITEM.reference_df(spark, sf_dir)
    settings = Settings(numeric_features=EVERY_LINEITEM.numeric, n_bins=sql.BINS, relative_error=SKETCH_ERROR)
    path = scratch(spark)
    Monitor(settings, spark).fit(df.filter("l_orderkey % 2 = 0")).save_baseline(path)
    saved = Monitor(settings, spark).load_baseline(path).baseline.sketches
    others = quantiles.quantile_sketches(df.filter("l_orderkey % 2 = 1"), EVERY_LINEITEM.numeric, SKETCH_ERROR)
    found = quantiles.sketch_quantiles(quantiles.merged_sketches(saved, others), sql.BINS)
    return _within_error(df, quantiles.vectors(found, EVERY_LINEITEM.numeric))


def _within_error(df, found):
    def within(name: str, i: int, value: float):
        n, target = F.count(name), F.count(name) * i / sql.BINS
        low, high = F.count_if(number(name) < value), F.count_if(number(name) <= value)
        slack = n * SKETCH_ERROR + 1
        return (low <= target + slack) & (high >= target - slack)

    cells = [
        F.struct(F.lit(x).alias("feature"), F.lit(i).alias("i"), within(x, i, v).alias("within_error"))
        for x, q in found.items()
        for i, v in enumerate(q)
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@register(
    "numeric_edges",
    chain(
        EVERY_LINEITEM,
        """SELECT feature, CAST(k - 1 AS INTEGER) AS position,
                  CASE WHEN k = 1 THEN '-inf' WHEN k = m THEN 'inf' ELSE CAST(round(v, 2) AS VARCHAR) END AS edge
           FROM placed""",
    ),
)
def numeric_edges(spark, sf_dir):
    edges = quantiles.edge_table(spark, reference_edges(EVERY_LINEITEM, spark, sf_dir))
    text = (
        F.when(F.col("edge") == float("-inf"), "-inf")
        .when(F.col("edge") == float("inf"), "inf")
        .otherwise(F.round("edge", 2).cast("string"))
    )
    return edges.select("feature", "position", text.alias("edge"))


@register(
    "numeric_bins",
    chain(
        LINEITEM,
        """SELECT l_orderkey, l_linenumber, l_extendedprice,
                  CAST(len(list_filter(es, lambda x: x <= l_extendedprice)) AS INTEGER) AS bin
           FROM lineitem, (SELECT es FROM inner_edges WHERE feature = 'l_extendedprice')""",
    ),
)
def numeric_bins(spark, sf_dir):
    edges = reference_edges(LINEITEM, spark, sf_dir)["l_extendedprice"]
    return counting.add_bin(table(spark, sf_dir, "lineitem"), "l_extendedprice", edges).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "bin"
    )


HISTOGRAM_SQL = f"""SELECT feature, ord, count(*) AS n,
    {r('count(*) / sum(count(*)) OVER (PARTITION BY feature)')} AS p FROM {{bins}} GROUP BY feature, ord"""


@register("numeric_histogram", chain(EVERY_LINEITEM, HISTOGRAM_SQL.format(bins="ref_bins")))
def histogram(spark, sf_dir):
    edges = reference_edges(EVERY_LINEITEM, spark, sf_dir)
    return rounded(numeric_histogram(EVERY_LINEITEM.reference_df(spark, sf_dir), edges))


@register("bins_with_reference_edges", chain(LINEITEM, HISTOGRAM_SQL.format(bins="cur_bins")))
def bins_with_reference_edges(spark, sf_dir):
    edges = reference_edges(LINEITEM, spark, sf_dir)
    return rounded(numeric_histogram(LINEITEM.current_df(spark, sf_dir), edges))


@register("bins_with_missing_values", chain(EVENTS, HISTOGRAM_SQL.format(bins="cur_bins")))
def bins_with_missing_values(spark, sf_dir):
    edges = reference_edges(EVENTS, spark, sf_dir)
    return rounded(numeric_histogram(EVENTS.current_df(spark, sf_dir), edges))


@register(
    "numeric_stats",
    f"""SELECT feature, count(v) AS count, count(*) AS total_count, count(*) - count(v) AS null_count,
               {r('(count(*) - count(v)) / count(*)')} AS null_proportion, min(v) AS min, max(v) AS max
        FROM (SELECT 'value' AS feature, {EVENTS.shifted['value']} AS v FROM events
              UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events) GROUP BY feature""",
)
def numeric_stats(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("value", F.expr(EVENTS.shifted["value"]))
    stats = profile_table(df, Settings(numeric_features=["value", "user_id"]))
    return rounded(
        stats.select(
            F.col("feature_name").alias("feature"), "count", "total_count", "null_count", "null_proportion", "min", "max"
        )
    )


@register(
    "numeric_profile",
    chain(
        EVERY_DOCUMENT,
        f"""SELECT 'n_chars' AS feature, ord, n, {r('n / sum(n) OVER ()')} AS p,
                   (SELECT {r('min(v)')} FROM ref_numbers) AS min, (SELECT {r('max(v)')} FROM ref_numbers) AS max
            FROM (SELECT ord, count(*) AS n FROM ref_bins GROUP BY ord)""",
    ),
)
def numeric_profile(spark, sf_dir):
    profile = profile_table(
        EVERY_DOCUMENT.reference_df(spark, sf_dir),
        Settings(numeric_features=["n_chars"], exact_quantiles=True),
    )
    return rounded(
        profile.select(F.col("feature_name").alias("feature"), F.explode("bins").alias("b"), "min", "max").select(
            "feature", "b.ord", "b.n", "b.p", "min", "max"
        )
    )


# ---- categorical columns


@register(
    "category_counts",
    f"""SELECT 'props' AS feature, coalesce(v, '__MISSING__') AS category, count(*) AS n,
               {r('count(*) / sum(count(*)) OVER ()')} AS p
        FROM (SELECT {EVENTS.shifted['props']} AS v FROM events) GROUP BY v""",
)
def category_counts(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("props", F.expr(EVENTS.shifted["props"]))
    counts = counting.category_counts(df, ["props"])
    totals = categories.category_totals(counts).select("feature", "total_count")
    return rounded(
        counts.join(F.broadcast(totals), "feature").select(
            "feature",
            key_label(F.col("kind"), F.col("key")).alias("category"),
            "n",
            share(F.col("n"), F.col("total_count")).alias("p"),
        )
    )


@register(
    "category_topk",
    chain(
        EVERY_EVENT,
        """SELECT feature, coalesce(key, '__MISSING__') AS category, n, CAST(position AS INTEGER) AS position
           FROM ref_ranked WHERE position <= 20""",
    ),
)
def category_topk(spark, sf_dir):
    counts = counting.category_counts(EVERY_EVENT.reference_df(spark, sf_dir), EVERY_EVENT.categorical)
    return categories.most_frequent(counts, 20).select(
        "feature", key_label(F.col("kind"), F.col("key")).alias("category"), "n", "position"
    )


@register(
    "category_rare",
    chain(
        EVERY_PART,
        f"""SELECT feature, key AS category, n, {r('n / total')} AS p
            FROM (SELECT feature, key, n, sum(n) OVER (PARTITION BY feature) AS total FROM ref_counts)
            WHERE n / total < 0.04""",
    ),
)
def category_rare(spark, sf_dir):
    counts = counting.category_counts(EVERY_PART.reference_df(spark, sf_dir), EVERY_PART.categorical)
    rare = categories.rare_categories(counts, categories.category_totals(counts), 0.04)
    return rounded(rare.select("feature", F.col("key").alias("category"), "n", "p"))


PROJECTION_SQL = chain(
    EVENTS,
    f"""SELECT feature, key AS category, n, {r('n / sum(n) OVER (PARTITION BY feature)')} AS p FROM cur_categories""",
)


@register("category_projection", PROJECTION_SQL)
def category_projection(spark, sf_dir):
    """Known categories tested in the scan."""
    return _projection(spark, sf_dir, in_scan=True)


@register("category_projection_joined", PROJECTION_SQL)
def category_projection_joined(spark, sf_dir):
    """The way taken with known_in_scan=False: known categories are joined."""
    return _projection(spark, sf_dir, in_scan=False)


def _projection(spark, sf_dir, in_scan: bool) -> DataFrame:
    settings = Settings(categorical_features=EVENTS.categorical, categorical_top_k=20, known_in_scan=in_scan)
    baseline = fit_baseline(EVENTS.reference_df(spark, sf_dir), settings)
    counts = categories.projected_counts(
        EVENTS.current_df(spark, sf_dir), baseline.known, EVENTS.categorical, baseline.known_lists
    )
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return rounded(
        counts.join(F.broadcast(totals), "feature").select(
            "feature",
            key_label(F.col("kind"), F.col("key")).alias("category"),
            "n",
            share(F.col("n"), F.col("total")).alias("p"),
        )
    )


@register(
    "category_profile",
    chain(
        EVERY_PART,
        f"""SELECT feature, key AS category, n, {r('n / sum(n) OVER (PARTITION BY feature)')} AS p FROM ref_categories""",
    ),
)
def category_profile(spark, sf_dir):
    settings = Settings(categorical_features=EVERY_PART.categorical, categorical_top_k=EVERY_PART.top_k)
    profile = profile_table(EVERY_PART.reference_df(spark, sf_dir), settings)
    return rounded(profile_bins(profile).select("feature", F.col("key").alias("category"), "n", "p"))


@register(
    "profile_on_baseline",
    chain(
        EVENTS,
        f"""SELECT *, {r('n / sum(n) OVER (PARTITION BY feature)')} AS p FROM (
              SELECT feature, key, n FROM cur_categories
              UNION ALL SELECT feature, CAST(ord AS VARCHAR), count(*) FROM cur_bins GROUP BY feature, ord)""",
    ),
)
def profile_on_baseline(spark, sf_dir):
    settings = EVENTS.settings()
    baseline = fit_baseline(EVENTS.reference_df(spark, sf_dir), settings)
    profile = profile_table(EVENTS.current_df(spark, sf_dir), settings, baseline)
    return rounded(profile_bins(profile).select("feature", "key", "n", "p"))


@register(
    "category_missing",
    chain(
        EVERY_EVENT,
        f"""SELECT feature, CAST(sum(n) AS BIGINT) AS total_count,
                   CAST(sum(CASE WHEN key IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_count
            FROM cur_counts GROUP BY feature""",
    ),
)
def category_missing(spark, sf_dir):
    counts = counting.category_counts(EVERY_EVENT.current_df(spark, sf_dir), EVERY_EVENT.categorical)
    return categories.category_totals(counts).drop("cardinality")


@register(
    "category_cardinality",
    "SELECT 'c_name' AS feature, count(DISTINCT c_name) AS cardinality FROM customer "
    "UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer",
)
def category_cardinality(spark, sf_dir):
    counts = counting.category_counts(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])
    return categories.category_totals(counts).select("feature", "cardinality")


CARDINALITY_ERROR = 0.02


@register(
    "cardinality_estimate",
    """SELECT * FROM (VALUES ('l_orderkey'), ('l_shipdate'), ('l_returnflag')) t(feature),
              (SELECT count(*) AS n, true AS within_error FROM lineitem)""",
)
def cardinality_estimate(spark, sf_dir):
    """Sketches of two parts of the table, merged, against the exact count."""
    df, names = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_shipdate", "l_returnflag"]
    parts = [cardinality.cardinality_sketches(df.filter(x), names, CARDINALITY_ERROR) for x in ("l_tax < 0.04", "l_tax >= 0.04")]
    sketches = cardinality.merged_cardinality_sketches(*parts)
    exact = categories.category_totals(counting.category_counts(df, names)).withColumnRenamed("cardinality", "exact")
    # one row per feature
    found = cardinality.estimated_cardinality(sketches).join(sketches, "feature").join(F.broadcast(exact), "feature")
    off = F.abs(F.col("cardinality") - F.col("exact"))
    return found.select("feature", "n", (off <= CARDINALITY_ERROR * F.col("exact")).alias("within_error"))


@register(
    "infer_without_identifiers",
    """SELECT feature_name, feature_type, count, cardinality FROM (
         SELECT 'c_custkey' AS feature_name, 'numeric' AS feature_type, count(c_custkey) AS count, NULL AS cardinality FROM customer
         UNION ALL SELECT 'c_nationkey', 'numeric', count(c_nationkey), NULL FROM customer
         UNION ALL SELECT 'c_acctbal', 'numeric', count(c_acctbal), NULL FROM customer
         UNION ALL SELECT 'c_mktsegment', 'categorical', count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer)""",
)
def infer_without_identifiers(spark, sf_dir):
    """c_name differs in every row and is left unwatched without an exact count."""
    with Monitor(Settings(infer_features=True, max_inferred_cardinality=100), spark) as monitor:
        profile = monitor.fit(table(spark, sf_dir, "customer")).baseline.profile
        return literal_table(spark, profile.select("feature_name", "feature_type", "count", "cardinality").collect(), "feature_name string, feature_type string, count bigint, cardinality bigint")


@register(
    "category_topk_large",
    """SELECT 'l_orderkey' AS feature, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n, CAST(row_number() OVER
              (ORDER BY count(*) DESC, CAST(l_orderkey AS VARCHAR)) AS INTEGER) AS position FROM lineitem
       GROUP BY l_orderkey QUALIFY position <= 1100""",
)
def category_topk_large(spark, sf_dir):
    """More categories than Spark ranks in the tasks, with very many ties."""
    counts = counting.category_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    return categories.most_frequent(counts, 1100).select("feature", "key", "n", "position")


@register("csv_copied_once", chain(PARTS, FEATURE_METRICS))
def csv_copied_once(spark, sf_dir):
    """Fit and compare on CSV, each table parsed once into a copy of its watched columns."""
    paths = [scratch(spark) for _ in range(2)]
    for path, df in zip(paths, (PARTS.reference_df(spark, sf_dir), PARTS.current_df(spark, sf_dir))):
        df.write.csv(path, header=True)
    reference, current = (read_csv(spark, path) for path in paths)
    # results are written before the copies go
    out = scratch(spark)
    with Monitor(PARTS.settings(copy_watched=True), spark) as monitor:
        monitor.store.save(rounded(monitor.fit(reference).compare(current).feature_metrics), out)
    return monitor.store.load(spark, out)


# ---- distances


def _distance(name: str, case: Case, metric: str, feature_type: str) -> None:
    sql_text = chain(case, f"SELECT feature, {r(metric)} AS {metric} FROM distances WHERE feature_type = '{feature_type}'")

    @register(name, sql_text)
    def query(spark, sf_dir):
        found = measured(case, spark, sf_dir).filter(F.col("feature_type") == feature_type)
        return rounded(found.select("feature", metric))


_distance("psi_numeric", LINEITEM, "psi", "numeric")
_distance("psi_categorical", ORDERS, "psi", "categorical")
_distance("js", DOCUMENTS, "js", "categorical")
_distance("hellinger", PARTS, "hellinger", "categorical")
_distance("ks_binned", LINEITEM, "ks_approx", "numeric")
_distance("chi_square", EVENTS, "chi_square", "categorical")
_distance("linf", DOCUMENT_LENGTHS, "linf", "numeric")


@register(
    "divergence_all",
    chain(
        EVENTS,
        "SELECT feature, feature_type, "
        + ", ".join(f"{r(m)} AS {m}" for m in ("psi", "js", "hellinger", "ks_approx", "chi_square", "linf"))
        + " FROM distances",
    ),
)
def divergence_all(spark, sf_dir):
    """Two count tables, matched and measured without any profile in between."""
    settings = EVENTS.settings()
    reference, current = EVENTS.reference_df(spark, sf_dir), EVENTS.current_df(spark, sf_dir)
    baseline = fit_baseline(reference, settings)
    sides = [counts_on_baseline(df, baseline) for df in (reference, current)]
    return rounded(divergence.measure(*sides, eps=settings.eps))


@register(
    "aligned_distribution",
    chain(
        LINEITEM,
        f"SELECT feature, key, n_ref, n_cur, {r('p')} AS p_ref, {r('q')} AS p_cur, {r('gap')} AS cdf_gap FROM running",
    ),
)
def aligned_distribution(spark, sf_dir):
    settings = LINEITEM.settings()
    baseline = fit_baseline(LINEITEM.reference_df(spark, sf_dir), settings)
    paired = divergence.pair(
        profile_bins(baseline.profile), counts_on_baseline(LINEITEM.current_df(spark, sf_dir), baseline)
    )
    return rounded(
        divergence.align(paired, settings.eps).select("feature", "key", "n_ref", "n_cur", "p_ref", "p_cur", "cdf_gap")
    )


# ---- severity


@register(
    "classify_metric",
    chain(
        EVENTS,
        """SELECT feature, CAST(psi_level AS INTEGER) AS psi_level, CAST(js_level AS INTEGER) AS js_level,
                  CAST(hellinger_level AS INTEGER) AS hellinger_level,
                  CAST(CASE WHEN ks_approx >= 0.2 THEN 3 WHEN ks_approx >= 0.1 THEN 2
                            WHEN ks_approx >= 0.05 THEN 1 ELSE 0 END AS INTEGER) AS ks_approx_level,
                  0 AS chi_square_level FROM levels""",
    ),
)
def classify_metric(spark, sf_dir):
    settings = EVENTS.settings()
    metrics = ("psi", "js", "hellinger", "ks_approx", "chi_square")
    return measured(EVENTS, spark, sf_dir).select(
        "feature", *[F.expr(s.metric_level(m, m, settings)).alias(f"{m}_level") for m in metrics]
    )


def _consensus(spark, sf_dir, case: Case) -> DataFrame:
    settings = case.settings()
    levels = {t: s.metric_levels(settings.metrics_for(t), settings) for t in ("numeric", "categorical")}
    return (
        measured(case, spark, sf_dir)
        .withColumn(
            "levels",
            F.when(F.col("feature_type") == "numeric", F.expr(levels["numeric"])).otherwise(
                F.expr(levels["categorical"])
            ),
        )
        .withColumn("primary_level", F.expr(s.metric_level("psi", "psi", settings)))
        .withColumn("consensus_level", F.expr(s.consensus_level("primary_level", "levels")))
    )


@register(
    "consensus",
    chain(
        EVENTS,
        """SELECT feature, CAST(psi_level AS INTEGER) AS primary_level, CAST(high_votes AS INTEGER) AS high_votes,
                  CAST(medium_votes AS INTEGER) AS medium_votes, CAST(consensus_level AS INTEGER) AS consensus_level
           FROM agreed""",
    ),
)
def consensus(spark, sf_dir):
    return _consensus(spark, sf_dir, EVENTS).select(
        "feature",
        "primary_level",
        F.expr(s.count_at_least("levels", s.HIGH)).alias("high_votes"),
        F.expr(s.count_at_least("levels", s.MEDIUM)).alias("medium_votes"),
        "consensus_level",
    )


@register(
    "structural_escalation",
    chain(
        ORDERS,
        f"""SELECT feature, CAST(consensus_level AS INTEGER) AS consensus_level, {r('new_category_share')} AS share,
                   severity_score AS score,
                   greatest(severity_score, CASE WHEN feature = 'o_orderstatus' THEN 4 ELSE 0 END) AS with_schema_issue,
                   ['none', 'low', 'medium', 'high', 'critical'][severity_score + 1] AS severity FROM scored""",
    ),
)
def structural_escalation(spark, sf_dir):
    level = s.escalate("consensus_level", "new_category_share", "schema_issue")
    return rounded(
        _consensus(spark, sf_dir, ORDERS).select(
            "feature",
            "consensus_level",
            F.col("new_category_share").alias("share"),
            F.expr(level).alias("score"),
            F.expr(s.escalate("consensus_level", "new_category_share", "feature = 'o_orderstatus'")).alias("with_schema_issue"),
            F.expr(s.label(level)).alias("severity"),
        )
    )


@register(
    "new_category_share",
    chain(
        ORDERS,
        f"""SELECT feature, {r('new_category_share')} AS new_category_share,
                   {r('new_category_row_share')} AS new_category_row_share
            FROM distances WHERE feature_type = 'categorical'""",
    ),
)
def new_category_share(spark, sf_dir):
    baseline = fit_baseline(ORDERS.reference_df(spark, sf_dir), ORDERS.settings())
    paired = divergence.pair(
        profile_bins(baseline.profile), counts_on_baseline(ORDERS.current_df(spark, sf_dir), baseline)
    )
    return rounded(
        paired.filter("feature_type = 'categorical'")
        .groupBy("feature")
        .agg(
            categories.new_category_share().alias("new_category_share"),
            categories.new_category_row_share().alias("new_category_row_share"),
        )
    )


@register(
    "rank_score",
    chain(LINEITEM, f"SELECT feature_name, {r('rank_score')} AS rank_score, 0.0::DOUBLE AS without_consensus FROM ordered"),
)
def rank_score(spark, sf_dir):
    settings = LINEITEM.settings()
    baseline = fit_baseline(LINEITEM.reference_df(spark, sf_dir), settings)
    current = LINEITEM.current_df(spark, sf_dir)
    plain = compare(current, baseline, LINEITEM.settings(use_metric_consensus=False)).feature_metrics
    scored = compare(current, baseline, settings).feature_metrics.select("feature_name", "rank_score")
    return rounded(
        scored.join(plain.select("feature_name", F.col("rank_score").alias("without_consensus")), "feature_name")
    )


@register("missing_delta", chain(EVENTS, f"SELECT feature_name, {r('missing_delta')} AS missing_delta FROM ordered"))
def missing_delta(spark, sf_dir):
    return rounded(report(EVENTS, spark, sf_dir).feature_metrics.select("feature_name", "missing_delta"))


@register("recommendation_code", chain(EVENTS, "SELECT feature_name, severity, advice FROM ordered"))
def recommendation_code(spark, sf_dir):
    rows = report(EVENTS, spark, sf_dir).feature_metrics
    code = s.advice_code("severity_score", "missing_delta", "new_category_share")
    return rows.select("feature_name", "severity", F.expr(code).alias("advice"))


# ---- reports


def _feature_metrics(name: str, case: Case) -> None:
    @register(name, chain(case, FEATURE_METRICS))
    def query(spark, sf_dir):
        return rounded(report(case, spark, sf_dir).feature_metrics)


_feature_metrics("feature_metrics", LINEITEM)
_feature_metrics("feature_metrics_mild", LINEITEM_MILD)
_feature_metrics("feature_metrics_events", EVENTS)
_feature_metrics("feature_metrics_orders", ORDERS)
_feature_metrics("feature_metrics_documents", DOCUMENTS)
_feature_metrics("feature_metrics_document_lengths", DOCUMENT_LENGTHS)
_feature_metrics("feature_metrics_parts", PARTS)


@register("feature_metrics_sketched", chain(LINEITEM_SKETCHED, FEATURE_METRICS))
def feature_metrics_sketched(spark, sf_dir):
    """Sketched quantiles, as fit takes them by default."""
    case = LINEITEM_SKETCHED
    settings = case.settings(exact_quantiles=False, relative_error=0.0005)
    monitor = Monitor(settings, spark).fit(case.reference_df(spark, sf_dir))
    return rounded(monitor.compare(case.current_df(spark, sf_dir)).feature_metrics)


SCHEMA_POLICY_SQL = f"""SELECT feature_name, {{severity}} AS severity,
    CASE WHEN feature_name <> 'l_tax' THEN {r('psi')} END AS psi FROM ordered {{rows}}"""


def _schema_policy(policy: str, severity: str, rows: str) -> None:
    @register(f"schema_policy_{policy}", chain(LINEITEM, SCHEMA_POLICY_SQL.format(severity=severity, rows=rows)))
    def query(spark, sf_dir):
        """A watched column gone and one of another type."""
        monitor = Monitor(LINEITEM.settings(schema_policy=policy), spark).fit(LINEITEM.reference_df(spark, sf_dir))
        current = LINEITEM.current_df(spark, sf_dir).drop("l_tax")
        current = current.withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
        return rounded(monitor.compare(current).feature_metrics.select("feature_name", "severity", "psi"))


_schema_policy("critical", "CASE WHEN feature_name IN ('l_tax', 'l_linenumber') THEN 'critical' ELSE severity END", "")
_schema_policy("ignore", "severity", "WHERE feature_name <> 'l_tax'")


@register(
    "metric_selection",
    chain(
        LINEITEM,
        f"""SELECT feature AS feature_name, 'js' AS primary_metric, {r('js')} AS primary_value, {r('js')} AS js,
                   {r('ks_approx')} AS ks_approx, CAST(NULL AS DOUBLE) AS psi,
                   CAST(CASE WHEN js_level >= 3 AND ks_level >= 3 THEN 3
                             WHEN js_level >= 2 AND ks_level >= 2 THEN greatest(js_level, 2)
                             ELSE js_level END AS INTEGER) AS severity_score
            FROM levels WHERE feature_type = 'numeric'""",
    ),
)
def metric_selection(spark, sf_dir):
    """Two metrics only; the first one given is the primary one."""
    settings = LINEITEM.settings(categorical_features=(), metrics_numeric=("js", "ks_approx"))
    monitor = Monitor(settings, spark).fit(LINEITEM.reference_df(spark, sf_dir))
    rows = monitor.compare(LINEITEM.current_df(spark, sf_dir)).feature_metrics
    names = ("feature_name", "primary_metric", "primary_value", "js", "ks_approx", "psi", "severity_score")
    return rounded(rows.select(*names))


@register("features_resolved_once", chain(LABELS, f"SELECT feature_name, feature_type, {r('psi')} AS psi FROM ordered"))
def features_resolved_once(spark, sf_dir):
    """Features are inferred at fit; a column that only the current table has is not watched."""
    settings = Settings(infer_features=True, exact_quantiles=True)
    monitor = Monitor(settings, spark).fit(LABELS.reference_df(spark, sf_dir))
    current = LABELS.current_df(spark, sf_dir).withColumn("extra", F.lit(1))
    return rounded(monitor.compare(current).feature_metrics.select("feature_name", "feature_type", "psi"))


@register(
    "row_weighted_new_categories",
    chain(
        ORDERS,
        f"""SELECT feature AS feature_name,
                   CASE WHEN feature_type = 'categorical' THEN {r('new_category_row_share')} ELSE 0 END AS new_category_share,
                   CAST(CASE WHEN feature_type = 'numeric' THEN consensus_level
                             WHEN new_category_row_share >= 0.2 THEN 4
                             WHEN new_category_row_share >= 0.1 THEN greatest(consensus_level, 3)
                             ELSE consensus_level END AS INTEGER) AS severity_score FROM agreed""",
    ),
)
def row_weighted_new_categories(spark, sf_dir):
    monitor = Monitor(ORDERS.settings(new_category_weight="rows"), spark).fit(ORDERS.reference_df(spark, sf_dir))
    rows = monitor.compare(ORDERS.current_df(spark, sf_dir)).feature_metrics
    return rounded(rows.select("feature_name", "new_category_share", "severity_score"))


@register("dataset_summary", chain(LINEITEM, sql.DATASET_SUMMARY))
def dataset_summary(spark, sf_dir):
    return rounded(report(LINEITEM, spark, sf_dir).dataset_summary)


@register(
    "recommendations",
    chain(
        EVENTS,
        with_text(f"SELECT rank, feature_name, severity, {r('rank_score')} AS rank_score, advice FROM ordered"),
    ),
)
def recommendations(spark, sf_dir):
    return rounded(report(EVENTS, spark, sf_dir).recommendations)


@register(
    "drifted_features",
    chain(ORDERS, "SELECT rank, feature_name, severity FROM ordered WHERE severity_score > 0"),
)
def drifted_features(spark, sf_dir):
    return report(ORDERS, spark, sf_dir).drifted_features().select("rank", "feature_name", "severity")


@register(
    "order_by_severity",
    chain(LINEITEM, "SELECT rank, feature_name, severity, severity_score FROM ordered"),
)
def order_by_severity(spark, sf_dir):
    rows = report(LINEITEM, spark, sf_dir).order_by_severity()
    return rows.select("rank", "feature_name", "severity", "severity_score")


# ---- special columns


@register(
    "constant_reference",
    """SELECT CAST(CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity = 5 THEN 1 ELSE 2 END AS INTEGER) AS ord,
              CAST(0 AS BIGINT) AS n_ref, count(*) AS n_cur FROM lineitem WHERE l_quantity <> 5 GROUP BY 1
       UNION ALL SELECT 1, (SELECT count(*) FROM lineitem), count(*) FROM lineitem WHERE l_quantity = 5""",
)
def constant_reference(spark, sf_dir):
    """A column that was constant and then spreads out: below, equal, above."""
    df = table(spark, sf_dir, "lineitem")
    settings = Settings(numeric_features=["l_quantity"])
    baseline = fit_baseline(df.withColumn("l_quantity", F.lit(5.0)), settings)
    paired = divergence.pair(profile_bins(baseline.profile), counts_on_baseline(df, baseline))
    return paired.select("ord", "n_ref", "n_cur")


@register(
    "two_valued_column",
    f"""SELECT CAST(toxic + 1 AS INTEGER) AS ord, count(*) FILTER (WHERE quality = 1) AS n_ref,
               count(*) FILTER (WHERE quality = 0) AS n_cur FROM labels GROUP BY toxic""",
)
def two_valued_column(spark, sf_dir):
    """With outer edges kept, both values of a flag have a bin of their own."""
    df = table(spark, sf_dir, "labels")
    settings = Settings(numeric_features=["toxic"], edge_policy="extend_ends")
    baseline = fit_baseline(df.filter("quality = 1"), settings)
    current = counts_on_baseline(df.filter("quality = 0"), baseline)
    return divergence.pair(profile_bins(baseline.profile), current).select("ord", "n_ref", "n_cur")


# ---- curves


@register(
    "density_histogram",
    f"""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders),
        b AS (SELECT least(CAST(floor(30 * (o_totalprice - lo) / (hi - lo)) AS INTEGER), 29) AS bin, count(*) AS c
              FROM orders, s GROUP BY 1)
        SELECT CAST(i AS INTEGER) AS bin, {r('lo + i * ((hi - lo) / 30)')} AS lower,
               {r('lo + (i + 1) * ((hi - lo) / 30)')} AS upper, coalesce(c, 0) AS n,
               round(coalesce(c, 0) / (n * ((hi - lo) / 30)), 12) AS density
        FROM s, range(0, 30) t(i) LEFT JOIN b ON b.bin = i""",
)
def density_histogram(spark, sf_dir):
    found = curves.density_histogram(table(spark, sf_dir, "orders"), "o_totalprice")
    return rounded(found.drop("density")).join(found.select("bin", F.round("density", 12).alias("density")), "bin")


@register(
    "kde_curve",
    f"""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n,
                          stddev_samp(value) * pow(count(*), -0.2) AS h FROM events),
        g AS (SELECT i, lo + i * ((hi - lo) / 199) AS x, n, h FROM s, range(0, 200) t(i))
        SELECT CAST(i AS INTEGER) AS point, {r('x')} AS x,
               {r('sum(exp(-0.5 * ((x - value) / h) * ((x - value) / h))) / (n * h * sqrt(2 * pi()))')} AS density
        FROM g, events GROUP BY i, x, n, h""",
)
def kde_curve(spark, sf_dir):
    return rounded(curves.density_curve(table(spark, sf_dir, "events"), "value"))


@register(
    "ecdf",
    f"""SELECT value, n, {r('sum(n) OVER (ORDER BY value) / sum(n) OVER ()')} AS cdf
        FROM (SELECT o_totalprice AS value, count(*) AS n FROM orders GROUP BY 1)""",
)
def ecdf(spark, sf_dir):
    return rounded(curves.ecdf(table(spark, sf_dir, "orders"), "o_totalprice"))


@register(
    "cdf_gap_at",
    chain(
        LINEITEM,
        f"""SELECT {r('a')} AS cdf_ref, {r('b')} AS cdf_cur, {r('abs(a - b)')} AS gap FROM (
              SELECT (SELECT avg(CAST(l_extendedprice <= 45000 AS DOUBLE)) FROM ref) AS a,
                     (SELECT avg(CAST(l_extendedprice <= 45000 AS DOUBLE)) FROM cur) AS b)""",
    ),
)
def cdf_gap_at(spark, sf_dir):
    sides = LINEITEM.reference_df(spark, sf_dir), LINEITEM.current_df(spark, sf_dir)
    return rounded(curves.cdf_gap_at(*sides, "l_extendedprice", 45000))


@register(
    "ks_exact",
    chain(
        LINEITEM,
        f"""SELECT {r('max(gap)')} AS ks, {r('arg_max(v, (gap, -v))')} AS at_value, max(a) AS n_ref, max(b) AS n_cur
            FROM (SELECT v, CAST(sum(x) OVER () AS BIGINT) AS a, CAST(sum(y) OVER () AS BIGINT) AS b,
                         abs(sum(x) OVER w / sum(x) OVER () - sum(y) OVER w / sum(y) OVER ()) AS gap
                  FROM (SELECT v, sum(x) AS x, sum(y) AS y FROM (
                          SELECT l_extendedprice AS v, 1 AS x, 0 AS y FROM ref
                          UNION ALL SELECT l_extendedprice, 0, 1 FROM cur) GROUP BY v)
                  WINDOW w AS (ORDER BY v))""",
    ),
)
def ks_exact(spark, sf_dir):
    sides = LINEITEM.reference_df(spark, sf_dir), LINEITEM.current_df(spark, sf_dir)
    return rounded(curves.ks_exact(*sides, "l_extendedprice"))
