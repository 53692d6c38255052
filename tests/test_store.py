import os

import pytest

from conftest import SF_SMALL, rows
from tidemark import Baseline, Monitor, Settings, TableStore, compare
from tidemark.plans.profiling import PROFILE_SCHEMA
from tidemark.operators import curves, quantiles
from tidemark.sources.shared import Scratch, shared_folder
from tidemark.sources.tables import literal_table, read_csv


def test_formats():
    assert TableStore("PARQUET").format == "parquet" and TableStore("Delta").format == "delta"
    with pytest.raises(ValueError):
        TableStore("csv")


def test_csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n1,1.5,x\n2,,y\n")
    inferred = read_csv(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in inferred.schema.fields] == [
        ("a", "int"),
        ("b", "double"),
        ("c", "string"),
    ]
    given = read_csv(spark, path, "a bigint, b double, c string")
    assert rows(given) == [dict(a=1, b=1.5, c="x"), dict(a=2, b=None, c="y")]


def test_save_modes(spark, tmp_path):
    store, path = TableStore(), str(tmp_path / "t")
    store.save(spark.range(3), path)
    store.save(spark.range(2), path, mode="append")
    assert store.load(spark, path).count() == 5
    store.save(spark.range(1), path)
    assert store.load(spark, path).count() == 1


def test_literal_table(spark):
    assert literal_table(spark, [], "a int, b string").collect() == []
    assert rows(literal_table(spark, [(1, "x")], "a int, b string")) == [dict(a=1, b="x")]


def test_pinned_table_is_written_to_the_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    scratch = Scratch(spark)
    pinned = scratch.pin(spark.range(5))
    assert pinned.count() == 5
    assert all(shared_folder(spark) in f for f in pinned.inputFiles())
    scratch.close()
    assert not scratch.paths and not any(os.path.exists(f.removeprefix("file://")) for f in pinned.inputFiles())


def test_nothing_is_left_behind(spark, tmp_path):
    folder = str(tmp_path / "shared")
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    before = sorted(os.listdir(shared_folder(spark)))
    with Monitor(Settings(infer_features=True, exact_quantiles=True), spark, folder=folder) as monitor:
        monitor.fit(df).compare(df).dataset_summary.collect()
        assert os.listdir(folder)
    assert os.listdir(folder) == []
    curves.ecdf(df, "o_totalprice").collect()
    curves.ks_exact(df, df, "o_totalprice").collect()
    quantiles.exact_quantiles(df, ["o_totalprice"], 10).collect()
    assert sorted(os.listdir(shared_folder(spark))) == before


def test_saved_baseline_compares_like_the_fitted_one(spark, tmp_path):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    reference, current = df.filter("l_quantity <= 30"), df.filter("l_quantity > 20")
    monitor = Monitor(Settings(infer_features=True), spark).fit(reference)
    monitor.save_baseline(str(tmp_path / "baseline"))
    loaded = Monitor(Settings(), spark).load_baseline(str(tmp_path / "baseline"))

    assert loaded.baseline.edges == monitor.baseline.edges
    assert loaded.baseline.schema == monitor.baseline.schema
    assert rows(loaded.baseline.profile) == rows(monitor.baseline.profile)
    wanted = "".join(c for c in PROFILE_SCHEMA if c != " ")
    found = ",".join(f"{f.name}{f.dataType.simpleString()}" for f in loaded.baseline.profile.schema.fields)
    assert found == wanted.replace(":", ":")

    report = monitor.compare(current)
    assert rows(loaded.compare(current).feature_metrics) == rows(report.feature_metrics)

    monitor.save_report(report, str(tmp_path / "report"))
    monitor.save_dataset_summary(report, str(tmp_path / "summary"))
    assert rows(monitor.store.load(spark, str(tmp_path / "report"))) == rows(report.feature_metrics)
    assert rows(monitor.store.load(spark, str(tmp_path / "summary"))) == rows(report.dataset_summary)


def test_a_loaded_baseline_needs_no_reference_table(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(100).selectExpr("CAST(id AS DOUBLE) AS x").write.parquet(source)
    settings = Settings(numeric_features=["x"])
    Monitor(settings, spark).fit(spark.read.parquet(source)).save_baseline(str(tmp_path / "b"))
    baseline = Baseline.load(spark, TableStore(), str(tmp_path / "b"))
    (row,) = compare(spark.range(50, 150).selectExpr("CAST(id AS DOUBLE) AS x"), baseline, settings).feature_metrics.collect()
    assert row["severity"] == "high"
