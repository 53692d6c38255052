"""Results that later jobs read more than once, written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, or the session's checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share, or name one to the Monitor")
    return named


class Scratch:
    """Tables written for one owner and deleted by close(), or else when the driver ends."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder
        self.paths: list[str] = []
        atexit.register(self.close)

    def pin(self, df: DataFrame) -> DataFrame:
        """Run df once, write it and return the written table.

        The result survives the loss of executors, starts a short lineage, and its file sizes tell the
        optimizer how large it really is.
        """
        path = f"{self.folder or shared_folder(self.spark)}/tidemark-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete what was written, through the file system Spark uses for it."""
        context = self.spark.sparkContext
        if context._jsc is None:  # the session has ended
            return
        for path in self.paths:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        self.paths.clear()
        atexit.unregister(self.close)
