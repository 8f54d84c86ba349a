"""Helpers shared by the corpus operators: durable intermediate tables, word rules, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than these; ``bytes.split()`` without an argument splits at exactly these six.
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (local tests, where driver and executors are one process)
    is a temporary folder made and remembered for the session.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    own = spark.conf.get("lodestone.shared.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("lodestone.shared.dir", own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def settle(spark: SparkSession, *done: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more, and lets Spark delete the shuffle files of finished jobs."""
    for df in done:
        remove(spark, df._lodestone_path)
    for _ in range(2):  # the driver's cleaner works beside the jobs: give it a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when a task ends, what the worker process has freed goes back to the system, as workers are kept for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with every column but the needed ones renamed to ``other 0``, ``other 1``, ..., and {new name: name}: work columns then can't clash with a caller's."""
    names = {f"other {k}": c for k, c in enumerate(docs.columns) if c not in needed}
    back = {c: n for n, c in names.items()}
    return docs.select(*(F.col(f"`{c}`").alias(back.get(c, c)) for c in docs.columns)), names


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
