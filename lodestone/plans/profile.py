"""Anonymous profile of a synchronisation: how long what took, by phase and format, without names or contents."""

from __future__ import annotations

import json
import os
import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import stats

#: The size of a profile file, and entries in the list of slow files.
LARGEST_PROFILE, SLOWEST = 1024 * 1024, stats.SLOWEST


class Profile:
    """Collects phases on the driver; files' timings are a DataFrame (extension, status, size_bytes, ms)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.phases: list[tuple[str, float, int]] = []

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.phases.append((name, (time.perf_counter() - began) * 1000, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024))

    def report(self, files: DataFrame) -> dict:
        """Phases, percentiles by extension (nearest rank, from a reservoir of each) and the slowest files by number only. What the files' rows hold beside extension, status, size_bytes and ms doesn't
        get into it."""
        files = files.select("extension", "status", "size_bytes", F.col("ms").cast("double").alias("ms"))
        phases = {r["phase"]: {"ms": round(r["ms"], 2), "memory_bytes": r["memory_bytes"]} for r in stats.phase_totals(self.spark.createDataFrame(self.phases, "phase string, ms double, memory_bytes long")).collect()} if self.phases else {}
        formats = {r["extension"]: {k: r[k] for k in ("n", "p50", "p95", "max")} for r in stats.sampled_percentiles(files, "extension", "ms", F.concat_ws(":", "size_bytes", "ms")).collect()}
        slow = [{"extension": r["extension"], "status": r["status"], "size_bytes": r["size_bytes"], "ms": r["ms"]} for r in stats.slowest(files, "ms", "size_bytes", SLOWEST).collect()]
        return {"phases": phases, "formats": formats, "slowest": slow}


def write_profile(path: str, report: dict) -> dict:
    """Writes a report of at most LARGEST_PROFILE bytes: beyond that first the slow files go, then the formats. Returns what was written."""
    for drop in ((), ("slowest",), ("slowest", "formats")):
        kept = {k: v for k, v in report.items() if k not in drop} | ({"omitted": list(drop)} if drop else {})
        text = json.dumps(kept, ensure_ascii=False)
        if len(text.encode()) <= LARGEST_PROFILE:
            with open(path, "w", encoding="utf-8") as file:
                file.write(text)
            os.chmod(path, 0o600)
            return kept
    raise ValueError("the profile is too large")
