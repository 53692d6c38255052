"""New categories against a saved baseline, large top-k lists, estimated cardinalities, footers, and CSV parsed once."""

import shutil

import pytest
from pyspark.sql import Window, functions as F

from conftest import SF_SMALL, rows
from test_plans import final_plan
from tidemark import Monitor, Settings
from tidemark.operators import cardinality, categories, counting
from tidemark.sources import footers
from tidemark.sources.shared import Scratch
from tidemark.sources.tables import load_bucketed, read_csv, save_bucketed


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c string")


# ---- stored categories


@pytest.mark.parametrize("reference", [["a", "", None], ["a", ""], [None], ["__MISSING__", "a"], []])
def test_saved_and_fitted_baselines_find_the_same_new_categories(spark, tmp_path, reference):
    reference, current = texts(spark, reference), texts(spark, ["a", "", None, None, "b", "__MISSING__"])
    with Monitor(Settings(categorical_features=["c"]), spark) as monitor:
        monitor.fit(reference).save_baseline(str(tmp_path / "b"))
        fitted = rows(monitor.new_categories(current))
    loaded = Monitor(Settings(), spark).load_baseline(str(tmp_path / "b"))
    assert rows(loaded.new_categories(current)) == fitted
    assert fitted == rows(categories.new_categories(reference, current, ["c"]))
    assert len(loaded.new_categories(current, listed=1).collect()) == min(1, len(fitted))


def test_new_categories_do_not_shuffle_the_saved_side(spark, tmp_path):
    lineitem = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    settings = Settings(categorical_features=["l_orderkey", "l_returnflag"])
    with Monitor(settings, spark) as monitor:
        monitor.fit(lineitem.filter("l_tax < 0.05")).save_baseline(str(tmp_path / "b"))
    loaded = Monitor(settings, spark).load_baseline(str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = final_plan(loaded.new_categories(lineitem))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ours, saved = plan.split("LeftAnti", 1)[1].split("Bucketed: true")[0], plan.split("FileScan parquet spark_catalog")
    assert len(saved) == 2 and ours.count("Exchange hashpartitioning") == 2
    assert "Exchange" not in ours[ours.rindex("FileScan parquet spark_catalog") - 400 :]


def test_buckets_survive_names_and_overwriting(spark, tmp_path):
    path = str(tmp_path / "it's here")
    keys = spark.createDataFrame([("f", "value", str(i), i) for i in range(100)], "feature string, kind string, key string, n bigint")
    save_bucketed(keys, path, ("feature", "kind", "key"), 100)
    save_bucketed(keys.limit(7), path, ("feature", "kind", "key"), 10**8)
    loaded = load_bucketed(spark, path)
    assert loaded.count() == 7 and not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_")]


# ---- the most frequent categories beyond what tasks narrow down by themselves


def ranked(counts, k):
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("key").asc_nulls_first())
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """One column with long common beginnings and many ties, one with hardly any categories, beginnings that are keys."""
    path = str(tmp_path_factory.mktemp("many"))
    name = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE concat('Name#', id % 60000) END AS a"
    df = spark.range(150_000).selectExpr(name, "CASE WHEN id % 7 = 0 THEN '' ELSE repeat('x', CAST(id % 5 AS INT)) END AS b")
    counting.category_counts(df, ["a", "b"]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("k, ties", [(1, 1), (1001, 100), (20_000, 1), (20_000, 100_000), (10**6, 1)])
def test_candidates_hold_the_most_frequent(many, k, ties):
    found = categories.candidates(many, k, ties)
    wanted = ranked(many, k).drop("position")
    assert wanted.exceptAll(found.select(wanted.columns)).count() == 0
    for feature, n in ((r["feature"], r["count"]) for r in found.groupBy("feature").count().collect()):
        # the missing category may be one more
        assert n <= k + ties + 1, feature


def test_only_candidates_are_ranked_above_a_thousand(many, monkeypatch):
    monkeypatch.setattr(categories, "TIES_RANKED", 1)
    for k in (1001, 20_000):
        assert rows(categories.most_frequent(many, k)) == rows(ranked(many, k))
        monkeypatch.setattr(categories, "TOP_K_IN_TASK", 10**9)
        assert "LeftOuter" not in final_plan(categories.most_frequent(many, k))
        monkeypatch.setattr(categories, "TOP_K_IN_TASK", 1000)
        # the filter by thresholds lies below both rankings
        plan = final_plan(categories.most_frequent(many, k))
        assert plan.index("Window") < plan.index("LeftOuter") and "NestedLoop" not in plan


def test_empty_counts_have_no_candidates(many):
    assert categories.most_frequent(many.limit(0), 5000).count() == 0


# ---- estimated cardinality


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_estimates_keep_within_their_error(spark, error):
    df = spark.range(40_000).selectExpr("CAST(id % 30000 AS STRING) AS a", "CASE WHEN id % 2 = 0 THEN '' END AS b", "NULL AS c")
    exact = {"a": 30_000, "b": 2, "c": 1}
    sketches = cardinality.cardinality_sketches(df, list(exact), error)
    twice = cardinality.merged_cardinality_sketches(sketches, sketches)
    for found in (sketches, twice):
        for r in cardinality.estimated_cardinality(found).collect():
            assert abs(r["cardinality"] - exact[r["feature"]]) <= error * exact[r["feature"]]
    assert rows(twice.select("n").distinct()) == [dict(n=80_000)]


def test_sketches_of_nothing(spark):
    assert cardinality.estimated_cardinality(cardinality.cardinality_sketches(texts(spark, []), ["c"], 0.1)).collect() == []
    for wrong in (0, 1, 0.001):
        with pytest.raises(ValueError):
            cardinality.sketch_size(wrong)


def test_identifiers_stay_unwatched_only_when_inferred(spark):
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS name", "CAST(id % 4 AS STRING) AS kind")
    watched = lambda **given: Monitor(Settings(max_inferred_cardinality=50, **given), spark).fit(df).baseline.categorical
    assert watched(infer_features=True) == ["kind"]
    assert watched(categorical_features=["name"]) == ["name"]


# ---- footers


def test_footers_are_read_instead_of_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN 'x' END AS `a.b`", "array(id) AS nested", "CAST(id AS DOUBLE) AS d")
    df.repartition(3).write.parquet(path)
    plan = footers.footer_aggregate(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(id), MIN(id), MAX(id), COUNT(`a.b`), COUNT(d)]" in plan
    found = rows(footers.footer_statistics(spark, path))
    assert found == [
        dict(feature="a.b", n=1000, n_valued=250, null_rate=0.75, lo=None, hi=None),
        dict(feature="d", n=1000, n_valued=1000, null_rate=0.0, lo=None, hi=None),
        dict(feature="id", n=1000, n_valued=1000, null_rate=0.0, lo="0", hi="999"),
    ]
    # the caller's session keeps its reader
    assert "BatchScan" not in spark.read.parquet(path)._jdf.queryExecution().executedPlan().toString()


def test_an_empty_table_has_no_rates(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "t"))
    assert rows(footers.footer_statistics(spark, str(tmp_path / "t"))) == [
        dict(feature="id", n=0, n_valued=0, null_rate=None, lo=None, hi=None)
    ]


def test_files_without_statistics_are_scanned(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"id": [3, None, 1]}), tmp_path / "t.parquet", write_statistics=False)
    (row,) = footers.footer_statistics(spark, str(tmp_path / "t.parquet")).collect()
    assert (row["n"], row["n_valued"], row["lo"], row["hi"]) == (3, 2, "1", "3")


# ---- rows parsed once


def test_csv_is_parsed_once_after_inference(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "csv")
    spark.range(500).selectExpr("id AS x", "id % 3 AS k", "'unwatched' AS z").write.csv(path, header=True)
    settings = Settings(numeric_features=["x"], categorical_features=["k"], copy_watched=True, exact_quantiles=True)
    pin = Scratch.pin

    def pin_and_lose_the_source(self, df):
        copy = pin(self, df)
        shutil.rmtree(path, ignore_errors=True)
        return copy

    df = read_csv(spark, path)
    monkeypatch.setattr(Scratch, "pin", pin_and_lose_the_source)
    with Monitor(settings, spark) as monitor:
        baseline = monitor.fit(df).baseline  # nothing after the copy can read the text
        assert baseline.schema == {"x": "int", "k": "int", "z": "string"}
        report = monitor.compare(spark.range(500).selectExpr("CAST(id AS INT) AS x", "CAST(id % 3 AS INT) AS k", "'' AS z"))
        assert {r["severity"] for r in report.feature_metrics.collect()} == {"none"}
        # a watched column that is gone
        assert monitor.compare(spark.range(5).selectExpr("id AS other")).feature_metrics.count() == 2
