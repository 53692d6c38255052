from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import sharding


def check(found, limit):
    """Shards are disjoint prefixes that fit, and no shard's parent would have fitted."""
    size, rows = Counter(), Counter()
    for r in found:
        size[r["shard"]] += r["n_bytes"]
        rows[r["shard"]] += 1
        assert len(r["shard"]) == r["depth"]
    for r in found:
        assert (r["shard_bytes"], r["shard_rows"]) == (size[r["shard"]], rows[r["shard"]])
        assert r["oversized"] == (r["shard_bytes"] > limit)
        assert not r["oversized"] or r["shard_rows"] == 1
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    parents = defaultdict(int)
    for name in names:
        for depth in range(len(name)):
            parents[name[:depth]] += size[name]
    assert all(n > limit for n in parents.values())


def test_shards_fit(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', CAST(id % 97 AS INT))").alias("text"), F.lit(1).alias("depth"))
    for limit in (500, 20_000, 10**9):
        found = sharding.shards(df.repartition(5), limit).collect()
        assert len(found) == 3000
        check(found, limit)


def test_a_hot_key_is_split(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("y" * 10).alias("text"))
    found = sharding.shards(df.repartition(4), 100).collect()
    assert len(found) == 900 and max(r["shard_bytes"] for r in found) <= 100
    check(found, 100)


def test_odd_rows(spark):
    rows = [(1, "a" * 1000), (2, None), (None, "b"), (None, "c"), (3, ""), (4, "d"), (4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shards(df, 3).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert [r["doc_id"] for r in found if r["oversized"]] == [1]
    check(found, 3)
    assert sharding.shards(df.limit(0), 3).collect() == []


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("é" * 5).alias("text"), F.col("id").alias("shard"))
    path = str(tmp_path / "shards")
    sharding.write_shards(df, path, 300)
    back = spark.read.parquet(path)
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(200))
    sizes = back.groupBy("shard_of_row").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(sizes) > 1 and max(r["n"] for r in sizes) <= 300


def test_no_python_on_the_main_path(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    plan = sharding.shards(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
