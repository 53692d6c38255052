"""What several operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import tidemark

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
READER_SETTING = "spark.sql.parquet.columnarReaderBatchSize"

_shipped: set[str] = set()
_written: list[tuple[object, str]] = []


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, as `--py-files` does, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(tidemark.__file__))
    package = os.path.join(tempfile.mkdtemp(prefix="py-files-"), "tidemark.zip")
    with zipfile.ZipFile(package, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(package)
    _shipped.add(context.applicationId)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir, deleted when the driver ends.

    A session without that setting must have a checkpoint folder of its own; only a local one may go
    without and gets /tmp/checkpoints.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system Spark itself uses for it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            continue


def let_go(spark: SparkSession) -> None:
    """Have the files of shuffles deleted that nothing refers to any more.

    Spark deletes them once the driver's JVM has collected what refers to them. Python's part of that may be in a cycle, the JVM
    hears of what Python has dropped by a queue that is looked into once a second, and the threads that listen to events hold the
    last one, the end of the query before with its plan, until another comes.
    """
    gc.collect()
    waiting = getattr(getattr(spark.sparkContext._gateway, "_gateway_client", None), "finalizer_deque", None)
    with suppress(IndexError):  # the thread that looks there may take the last one
        while waiting and isinstance(waiting[-1], tuple):
            client, target = waiting.pop()
            client.garbage_collect_object(target, False)
    spark.sql("SET spark.checkpoint.dir")  # another event
    with suppress(Py4JError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(1000)
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, most: int | None, rows: int | None = None) -> Iterator[None]:
    """Python functions of the jobs within get batches of about `most` bytes, if that is less than the session has (64 MB by default):
    a task holds a batch in the JVM, outside of its heap, and in Python, and both may take twice its size while it is put together.
    Parquet files are read by so many `rows` at a time (4096 by default), all of which a task has in its heap."""
    before = {}
    for name, wanted in ((BATCH_SETTING, most), (READER_SETTING, rows)):
        with suppress(PySparkException):  # other versions of Spark may not know it
            now = spark.conf.get(name)
            size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)
            if wanted is not None and not 0 < size <= wanted:
                before[name] = now
                spark.conf.set(name, str(wanted))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def keep(df: DataFrame, name: str = "stage", batch_bytes: int | None = None, read_rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder and return the written table: later jobs neither repeat the
    work nor depend on the executors that did it.

    Shuffle files of earlier jobs are let go first: long chains of jobs would hold the files of all of them otherwise.
    With `batch_bytes`, Python functions get batches of about that size; with `read_rows`, Parquet files are read by so many rows.
    """
    spark = df.sparkSession
    let_go(spark)
    path = work_folder(spark, name)
    with small_batches(spark, batch_bytes, read_rows):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def release(df: DataFrame) -> None:
    """Delete a table that keep() has written and nothing will read again."""
    delete(df.sparkSession, df.kept_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches where `column` reaches `most` bytes; a longer value stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


# What this Python worker remembers from one task to the next.
remembered: list[dict] = []


def give_back_memory(keeping: dict | None = None) -> None:
    """Forget what tasks of other operators remember, all of `remembered` but `keeping`, and return what earlier tasks of this
    Python worker have freed to the system; allocators hold on to it otherwise, and the workers of one machine share its memory
    with the JVM."""
    for known in remembered:
        if known is not keeping:
            known.clear()
    pa.default_memory_pool().release_unused()
    # a function of the GNU C library, not of others
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


FILTER_BITS = 1 << 26


def rows_with_keys(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key may be in the one column of `keys`; some others come along.

    A bit set of fixed size, 8 MB, is all that reaches the driver and the tasks, however many keys there are. It spares most rows the
    shuffle of an exact join.
    """
    spark = df.sparkSession
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(FILTER_BITS))
    bit = place(keys[keys.columns[0]])
    words = keys.select(F.shiftright(bit, 5).cast("int").alias("word"), F.pmod(bit, F.lit(32)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(np.bool_)))

    marked = df.withColumn("__bit", place(key))
    return marked.mapInArrow(run, marked.schema).drop("__bit")
