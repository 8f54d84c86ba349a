"""Index statistics, diagnostics and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.classify import needs_text_upgrade
from lodestone.schema import STATUSES

SLOWEST = 20
#: Fixed value: values of a format that percentiles are drawn from.
RESERVOIR = 20_000


def _statuses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in STATUSES], "status string")


def status_counts(documents: DataFrame) -> DataFrame:
    """documents by status; statuses that don't occur have 0."""
    counts = documents.groupBy("status").agg(F.count("*").alias("n"))
    return _statuses(documents.sparkSession).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("documents"))


def extension_stats(documents: DataFrame) -> DataFrame:
    """By extension: documents, source_bytes and a count for each status, in one pass."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return documents.groupBy("extension").agg(F.count("*").alias("documents"), F.sum("size_bytes").alias("source_bytes"), *counts)


def text_upgrade_pending(documents: DataFrame) -> DataFrame:
    """By extension: text documents that an older parser version wrote."""
    return documents.where(needs_text_upgrade(F.col("extension"), F.col("status"), F.col("parse_version"))).groupBy("extension").agg(F.count("*").alias("documents"))


def content_stats(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: documents, blocks and characters of content."""
    of_blocks = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.char_length("content")), F.lit(0)).alias("characters"))
    rows = documents.agg(F.count("*").alias("documents"))
    return rows.withColumn("_k", F.lit(1)).join(of_blocks.withColumn("_k", F.lit(1)), "_k").drop("_k")


def documents_by_root(documents: DataFrame) -> DataFrame:
    return documents.groupBy("root_path").agg(F.count("*").alias("documents"))


def issues(documents: DataFrame) -> DataFrame:
    """Documents with an error code, by path."""
    return documents.where("error_code is not null").select("path", "status", "error_code", "error_message").orderBy("path")


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics by stage and code, and by stage alone (code null)."""
    return diagnostics.groupBy("stage", "code").agg(F.count("*").alias("n")).unionByName(diagnostics.groupBy("stage").agg(F.count("*").alias("n")).withColumn("code", F.lit(None).cast("string")))


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """By group: n, p50, p95 and max by nearest rank; exact. A group without values has 0."""
    at = lambda share: F.coalesce(F.expr(f"percentile_disc({share}) within group (order by {value})").cast("long"), F.lit(0))
    return rows.groupBy(by).agg(F.count(value).alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.coalesce(F.max(value), F.lit(0)).alias("max"))


def reservoir(rows: DataFrame, by: str, value: str, key: Column, size: int = RESERVOIR) -> DataFrame:
    """Up to ``size`` values of each group, those of least MD5 of ``key``: a sample that doesn't depend on how rows are dealt, and that is merged by taking the least again. Tasks hand on no more than
    ``size`` values of a group."""
    order = Window.partitionBy(by).orderBy(F.md5(key.cast("string")), value)
    return rows.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n")


def sampled_percentiles(rows: DataFrame, by: str, value: str, key: Column, size: int = RESERVOIR) -> DataFrame:
    """As percentiles(), from a reservoir of each group; n and max are of all rows. Ranks are off by about half a share of 1 / sqrt(size)."""
    some = percentiles(reservoir(rows, by, value, key, size), by, value).select(by, "p50", "p95")
    whole = rows.groupBy(by).agg(F.count(value).alias("n"), F.coalesce(F.max(value), F.lit(0)).alias("max"))
    return whole.join(some, by, "left").select(by, "n", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("p50", "p95")), "max")


def slowest(rows: DataFrame, value: str, tie: str, n: int = SLOWEST) -> DataFrame:
    return rows.orderBy(F.desc(value), F.asc(tie)).limit(n)


def storage_total(files: DataFrame, *by: str) -> DataFrame:
    """One row (or one for each value of ``by``): files, and bytes or null if the size of any file isn't known."""
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.when(F.count_if(F.col("size_bytes").isNull()) == 0, F.coalesce(F.sum("size_bytes"), F.lit(0))).alias("bytes"))


def phase_totals(phases: DataFrame) -> DataFrame:
    """By phase: milliseconds in all, and the highest memory."""
    return phases.groupBy("phase").agg(F.sum("ms").alias("ms"), F.max("memory_bytes").alias("memory_bytes"))
