"""Tables between jobs: written once to the folder that driver and executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a core gets of a large table at once: Spark's own split of files.
SPLIT_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session without it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodestone.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("lodestone.shared.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df and reads it back, so that what is built on it is worked out once and survives lost executors."""
    path = path or f"{shared_dir(df.sparkSession)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(spark: SparkSession, *done: DataFrame | str) -> None:
    """Deletes tables of stored(), or paths, that nothing reads any more."""
    for df in done:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df if isinstance(df, str) else df._lodestone_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def modified(spark: SparkSession, path: str) -> int:
    """When a path of any file system was last changed, in ms."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getModificationTime()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all cores by its keys, if it is so small that its files may hold less than a split for each core; larger tables stay as they are read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < cores * SPLIT_BYTES else df
