"""Keeps an index up to date with file events: applies them root by root, looks whole roots through from time to time, and tries again what failed."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.index import Index
from lodestone.sources.store import LockedError
from lodestone.streaming.live import DEBOUNCE_MS, FAILED_RETRY_MINUTES, QUEUE_LIMIT, RECONCILE_BACKGROUND_MS, RECONCILE_FOREGROUND_MS, RETRY_SECONDS, apply_stream, valid_debounce


@dataclass
class RootState:
    """state: watching, retrying (soon again) or degraded (only whole scans, in minutes). Times in seconds."""

    state: str = "watching"
    failures: int = 0
    due_at: float | None = None
    scanned_at: float = 0.0
    error: str | None = None
    pending: set[str] = field(default_factory=set)
    whole: bool = False

    def failed(self, error: Exception, now: float) -> None:
        self.failures += 1
        self.error = f"{type(error).__name__}: {error}"
        if self.failures <= len(RETRY_SECONDS):
            self.state, self.due_at = "retrying", now + RETRY_SECONDS[self.failures - 1]
        else:
            late = min(self.failures - len(RETRY_SECONDS), len(FAILED_RETRY_MINUTES)) - 1
            self.state, self.due_at, self.whole = "degraded", now + 60 * FAILED_RETRY_MINUTES[late], True

    def succeeded(self, now: float, scanned: bool) -> None:
        self.state, self.failures, self.due_at, self.error = "watching", 0, None, None
        self.whole = False
        if scanned:
            self.scanned_at = now


class Updater:
    """Applies events to the index of a store. Which roots there are is read again for each batch, so roots come and go while it runs; events of others are dropped."""

    def __init__(self, index: Index, *, background: bool = False, clock: Callable[[], float] = time.time):
        self.index, self.clock = index, clock
        self.period = (RECONCILE_BACKGROUND_MS if background else RECONCILE_FOREGROUND_MS) / 1000
        self.roots: dict[str, RootState] = {}
        self.beat_at = clock()

    def refresh(self) -> dict[str, RootState]:
        named = self.index.store.meta()["roots"]
        self.roots = {root: self.roots.get(root) or RootState(scanned_at=self.clock()) for root in named}
        return self.roots

    def apply(self, root: str, paths: list[str] | None) -> None:
        """Takes a batch's paths of a root (None: all of it). What fails, and files that are still being written, stay pending."""
        state = self.refresh().get(root)
        if state is None:
            return
        if paths is None:
            state.whole = True
        else:
            state.pending |= set(paths)
        self._work(root, state)

    def _work(self, root: str, state: RootState) -> None:
        now = self.clock()
        whole, paths = state.whole, sorted(state.pending)
        if not whole and not paths:
            return
        try:
            report = self.index.apply(root, None if whole else paths, wait=False)
        except (OSError, LockedError, LookupError, RuntimeError) as error:
            state.failed(error, now)
            return
        state.pending = set(report.get("unstable", ()))
        state.succeeded(now, whole)
        if state.pending:
            state.due_at = now + RETRY_SECONDS[0]

    def tick(self) -> None:
        """Does what is due: retries, and a scan of each root that hasn't had one for the period. Scans are counted from the end of the one before."""
        self.beat_at = now = self.clock()
        for root, state in self.refresh().items():
            if state.due_at is not None:
                if state.due_at <= now:
                    self._work(root, state)
            elif now - state.scanned_at >= self.period:
                state.whole = True
                self._work(root, state)

    def watch(self, events: DataFrame, checkpoint: str, *, debounce_ms: int = DEBOUNCE_MS, limit: int = QUEUE_LIMIT) -> StreamingQuery:
        """Applies a stream of events: all that come within the delay are absorbed and applied together, by the cluster's clock, so no event waits for a watermark."""
        return apply_stream(events, self.apply, checkpoint, limit=limit, trigger={"processingTime": f"{valid_debounce(debounce_ms)} milliseconds"})

    def status(self) -> list[dict]:
        return [{"root": root, "state": s.state, "failures": s.failures, "error": s.error, "pending": len(s.pending), "scanned_at": s.scanned_at, "beat_at": self.beat_at} for root, s in sorted(self.roots.items())]
