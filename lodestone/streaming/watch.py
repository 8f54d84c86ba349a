"""A running watch: file events become work by root, with debouncing, retries and periodic scans as timers of a stateful stream.

What is pending, what is being worked on, and when something is due lie in the stream's state, so they outlive the driver. What came of the
work returns to the state as rows of a second stream; work that was lost with a driver is done again, which changes nothing that is done already.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestone.functions.paths import covers
from lodestone.streaming.live import DEBOUNCE_MS, FAILED_RETRY_MINUTES, QUEUE_LIMIT, RECONCILE_BACKGROUND_MS, RECONCILE_FOREGROUND_MS, RETRY_SECONDS, routed, valid_debounce

#: Events and outcomes as one stream. kind: event, reconcile, root (it is watched), done, failed or gone; value: JSON of what belongs to the kind.
INPUT = "root string, kind string, value string"
WORK = "root string, attempt long, paths array<string>, state string, failures int"


@dataclass
class Settings:
    debounce_ms: int = DEBOUNCE_MS
    limit: int = QUEUE_LIMIT
    period_ms: int = RECONCILE_FOREGROUND_MS

    @classmethod
    def of(cls, *, debounce_ms: int = DEBOUNCE_MS, limit: int = QUEUE_LIMIT, background: bool = False) -> Settings:
        return cls(valid_debounce(debounce_ms), limit, RECONCILE_BACKGROUND_MS if background else RECONCILE_FOREGROUND_MS)


@dataclass
class Watched:
    """The state of a root. Times in ms; None: nothing is due. While an attempt runs, events gather for the next one."""

    pending: list[str] = field(default_factory=list)
    whole: bool = False
    attempt: int = 0
    running: bool = False
    held: list[str] = field(default_factory=list)
    held_whole: bool = False
    failures: int = 0
    quiet_at: int | None = None
    retry_at: int | None = None
    scan_at: int | None = None

    def see(self, kind: str, value: dict, now: int, how: Settings) -> None:
        """Takes in an event or an outcome."""
        if kind in ("event", "reconcile"):
            self.add([value["path"]] if kind == "event" else [], kind == "reconcile", how)
            self.quiet_at = now + how.debounce_ms
            self.scan_at = self.scan_at or now + how.period_ms
        elif kind == "root":
            self.scan_at = self.scan_at or now + how.period_ms
        elif self.running and value["attempt"] == self.attempt:  # outcomes of other attempts came twice
            self.running = False
            if kind == "done":
                if self.held_whole:
                    self.scan_at = now + how.period_ms  # counted from the end of a scan
                self.failures, self.retry_at = 0, None
                self.add(value.get("unstable", ()), False, how)
                if value.get("unstable"):
                    self.retry_at = now + 1000 * RETRY_SECONDS[0]
            else:
                self.failures += 1
                self.add(self.held, self.held_whole or self.failures > len(RETRY_SECONDS), how)
                late = self.failures - len(RETRY_SECONDS)
                self.retry_at = now + (1000 * RETRY_SECONDS[self.failures - 1] if late <= 0 else 60_000 * FAILED_RETRY_MINUTES[min(late, len(FAILED_RETRY_MINUTES)) - 1])
            self.held, self.held_whole = [], False

    def add(self, paths: list[str], whole: bool, how: Settings) -> None:
        """The least set of paths that covers all; too many are the whole root."""
        for path in paths:
            if not any(covers(p, path) for p in self.pending):
                self.pending = [p for p in self.pending if not covers(path, p)] + [path]
        if whole or self.whole or len(self.pending) > how.limit:
            self.whole, self.pending = True, []

    @property
    def label(self) -> str:
        return "watching" if not self.failures else "retrying" if self.failures <= len(RETRY_SECONDS) else "degraded"

    def due_at(self) -> int | None:
        """When work is to begin next. After a failure, events wait for the retry."""
        if self.running:
            return None
        if self.retry_at is not None:
            return self.retry_at
        times = [t for t in (self.quiet_at if self.pending or self.whole else None, self.scan_at) if t is not None]
        return min(times, default=None)

    def begin(self, now: int) -> list[str] | None:
        """Starts the attempt that is due and returns its paths, None for the whole root."""
        if self.scan_at is not None and self.scan_at <= now:
            self.whole, self.pending = True, []
        self.held, self.held_whole = self.pending, self.whole
        self.pending, self.whole, self.quiet_at, self.retry_at = [], False, None, None
        self.running, self.attempt = True, self.attempt + 1
        return None if self.held_whole else self.held


class RootProcessor(StatefulProcessor):
    """Watched roots as keyed state with a processing-time timer each."""

    def __init__(self, how: Settings):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watched", "value string")

    def _load(self) -> Watched:
        found = self.state.get()
        return Watched(**json.loads(found[0])) if found else Watched()

    def _settle(self, key: tuple, watched: Watched, now: int) -> Iterator[Row]:
        """Begins what is due, and sets the timer for what comes next."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        due = watched.due_at()
        if due is not None and due <= now:
            yield Row(root=key[0], attempt=watched.attempt + 1, paths=watched.begin(now), state=watched.label, failures=watched.failures)
        elif due is not None:
            self.handle.registerTimer(due)
        self.state.update((json.dumps(asdict(watched)),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, watched = timerValues.getCurrentProcessingTimeInMs(), self._load()
        for row in rows:
            if row["kind"] == "gone":
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                self.state.clear()
                return
            watched.see(row["kind"], json.loads(row["value"] or "{}"), now, self.how)
        yield from self._settle(key, watched, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, self._load(), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def as_input(events: DataFrame) -> DataFrame:
    """Routed events as rows of INPUT."""
    return routed(events).select("root", F.when(F.col("route") == "reconcile", "reconcile").otherwise("event").alias("kind"), F.to_json(F.struct("path")).alias("value"))


def work(inputs: DataFrame, how: Settings) -> DataFrame:
    """The stream of work (WORK) of a stream of events and outcomes (INPUT)."""
    return inputs.groupBy("root").transformWithState(RootProcessor(how), WORK, "append", "ProcessingTime")


def tell(spark: SparkSession, folder: str, rows: list[tuple[str, str, dict]]) -> None:
    """Adds (root, kind, value) to the stream of outcomes."""
    if rows:
        spark.createDataFrame([(root, kind, json.dumps(value)) for root, kind, value in rows], INPUT).coalesce(1).write.mode("append").json(folder)


def watch(spark: SparkSession, events: DataFrame, apply: Callable[[str, list[str] | None], dict], folder: str, roots: Callable[[], list[str]], *, how: Settings | None = None, trigger_ms: int = 500, on_work: Callable[[Row, str | None], None] | None = None) -> StreamingQuery:
    """Applies a stream of events (root, path, ...) to roots as they come due. ``folder``: a shared one for outcomes and the checkpoint; a watch that is started on it again goes on
    where the last one was. ``apply(root, paths)`` does the work (None: all of the root) and returns a report; LookupError ends the root's watch, other errors put it off. ``roots()``: those that
    are watched now; it is asked with each batch."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    outcomes = f"{folder}/outcomes"
    known: set[str] = set(roots())
    tell(spark, outcomes, [(r, "root", {}) for r in sorted(known)] or [("", "root", {})])

    def run(batch: DataFrame, _: int) -> None:
        told = [(r, "root", {}) for r in sorted(set(roots()) - known)]
        known.update(r for r, _, _ in told)
        for row in batch.where("root <> ''").collect():  # one row at most for each root that is due
            error = None
            try:
                report = apply(row["root"], row["paths"])
                if report.get("offline"):
                    raise OSError("the root can't be reached")
                told.append((row["root"], "done", {"attempt": row["attempt"], "unstable": report.get("unstable", [])}))
            except LookupError:
                known.discard(row["root"])
                told.append((row["root"], "gone", {}))
            except (OSError, RuntimeError) as failed:
                error = f"{type(failed).__name__}: {failed}"
                told.append((row["root"], "failed", {"attempt": row["attempt"], "error": error}))
            if on_work:
                on_work(row, error)
        tell(spark, outcomes, told)

    inputs = as_input(events).unionByName(spark.readStream.schema(INPUT).json(outcomes))
    return work(inputs, how or Settings()).writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(processingTime=f"{trigger_ms} milliseconds").start()
