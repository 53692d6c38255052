"""What the operators share: tables that are kept, files of shuffles, sizes of batches."""

import glob
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x for f in folders for x in glob.glob(f"{f.toString()}/*/shuffle_*.data")}


def shuffled(spark):
    same = lambda batches: batches
    return spark.range(1000).repartition(7).groupBy("id").count().mapInArrow(same, "id long, count long")


def test_files_of_shuffles_go_with_the_next_table(spark):
    before = shuffle_files(spark)
    common.keep(shuffled(spark), "test")
    made = shuffle_files(spark) - before
    assert made
    common.let_go(spark)
    for _ in range(30):
        if not made & shuffle_files(spark):
            break
        time.sleep(0.1)
    assert not made & shuffle_files(spark)


def test_sizes_of_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    asked = spark.range(200).repartition(1).select(F.repeat(F.lit("x"), 10_000).alias("text")).mapInArrow(sizes, "n long")
    before = spark.conf.get(common.BATCH_SETTING)
    assert [r["n"] for r in common.keep(asked, "test").collect()] == [200]
    few = [r["n"] for r in common.keep(asked, "test", batch_bytes=100_000).collect()]
    assert sum(few) == 200 and max(few) <= 20
    assert spark.conf.get(common.BATCH_SETTING) == before
    with pytest.raises(ZeroDivisionError), common.small_batches(spark, 1000):
        assert spark.conf.get(common.BATCH_SETTING) == "1000"
        1 / 0
    assert spark.conf.get(common.BATCH_SETTING) == before
    spark.conf.set(common.BATCH_SETTING, "500b")
    try:
        with common.small_batches(spark, 1000):
            assert spark.conf.get(common.BATCH_SETTING) == "500b"
    finally:
        spark.conf.set(common.BATCH_SETTING, before)
