"""Live updates: filtering, absorbing and debouncing file events, and applying them in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.paths import ancestors

#: Fixed values, in milliseconds or counts.
DEBOUNCE_MS, LEAST_DEBOUNCE_MS, MOST_DEBOUNCE_MS = 1500, 200, 60_000
RECONCILE_FOREGROUND_MS, RECONCILE_BACKGROUND_MS = 300_000, 21_600_000
QUEUE_LIMIT = 10_000
RETRY_SECONDS = (1, 2, 5, 15, 30)
FAILED_RETRY_MINUTES = (1, 5, 15)
IGNORE_FILE = ".lodestoneignore"


def valid_debounce(ms: int) -> int:
    if not LEAST_DEBOUNCE_MS <= ms <= MOST_DEBOUNCE_MS:
        raise ValueError(f"the delay has to be {LEAST_DEBOUNCE_MS} to {MOST_DEBOUNCE_MS} ms")
    return ms


def routed(events: DataFrame) -> DataFrame:
    """Events (root, path, ...) that matter, with route: reconcile for those without a path, of the root itself or of its ignore file, else local."""
    inside = F.col("path").startswith(F.concat(F.col("root"), F.lit("/")))
    hidden = F.col("path").rlike(r"(^|/)(\.git|node_modules|\.lodestone)(/|$)|(^|/)~\$")
    whole = F.col("path").isNull() | (F.col("path") == F.col("root")) | (F.col("path") == F.concat(F.col("root"), F.lit(f"/{IGNORE_FILE}")))
    return events.where(whole | (inside & ~hidden)).withColumn("route", F.when(whole, "reconcile").otherwise("local"))


def absorb(pending: DataFrame, path: str = "path") -> DataFrame:
    """The least set of paths that covers all pending ones: those with an ancestor among them go. An equality join on ancestors."""
    named = pending.select(path).distinct()
    above = named.select(F.col(path), F.explode(ancestors(F.col(path))).alias("_above")).where(F.col("_above") != F.col(path))
    covered = above.join(named.select(F.col(path).alias("_above")), "_above", "left_semi").select(path).distinct()
    return named.join(covered, path, "left_anti")


def debounced(events: DataFrame, gap: str = f"{DEBOUNCE_MS} milliseconds") -> DataFrame:
    """One row for each burst of a root's events: every event puts the end off by ``gap``. Works on batches and, with a watermark, on streams."""
    return events.groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")).select("root", "events", "first_at", "last_at", F.col("w.end").alias("due_at"))


def queue_modes(events: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """By root: pending paths, and whether they are too many to be looked at one by one."""
    return events.groupBy("root").agg(F.count_distinct("path").alias("pending")).withColumn("mode", F.when(F.col("pending") > limit, "reconcile").otherwise("local"))


def event_stream(spark, folder: str, schema) -> DataFrame:
    """Events that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def burst_stream(events: DataFrame, *, debounce_ms: int = DEBOUNCE_MS, late: str = "10 minutes") -> DataFrame:
    """Debounced bursts of a stream of routed events; a burst is emitted once the watermark has passed its end."""
    return debounced(routed(events.withWatermark("ts", late)), f"{valid_debounce(debounce_ms)} milliseconds")


def apply_stream(events: DataFrame, apply: Callable[[str, list[str] | None], None], checkpoint: str, *, limit: int = QUEUE_LIMIT, trigger: dict | None = None) -> StreamingQuery:
    """Hands each micro-batch to ``apply(root, paths)``, root by root; paths is None where the whole root has to be reconciled.

    One writer at a time: foreachBatch runs in order, and a batch that fails is run again from the checkpoint. Of a root's paths only the
    absorbed ones are collected, and only while they are no more than ``limit``.
    """

    def run(batch: DataFrame, _: int) -> None:
        batch = routed(batch).persist()
        try:
            modes = queue_modes(batch.withColumn("path", F.coalesce("path", F.lit(""))), limit)
            whole = batch.groupBy("root").agg(F.max((F.col("route") == "reconcile").cast("int")).alias("whole"))
            for r in modes.join(whole, "root").orderBy("root").toLocalIterator():
                if r["whole"] or r["mode"] == "reconcile":
                    apply(r["root"], None)
                else:
                    apply(r["root"], sorted(p["path"] for p in absorb(batch.where(F.col("root") == r["root"])).collect()))
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def status(query: StreamingQuery) -> dict:
    """A snapshot of a running update."""
    last = query.lastProgress
    return {
        "active": query.isActive,
        "state": "failed" if query.exception() else "running" if query.isActive else "stopped",
        "batch": last["batchId"] if last else None,
        "rows": last["numInputRows"] if last else 0,
        "at": last["timestamp"] if last else None,
    }
