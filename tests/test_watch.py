"""The state of a watched root by a manual clock, and the running stream: events from listings, work, retries."""

import json
import time

from lodestone.plans.index import Index
from lodestone.streaming import watch as w
from lodestone.streaming.source import FolderReader, folder_events

HOW = w.Settings(debounce_ms=1500, limit=3, period_ms=300_000)


def test_every_event_puts_the_work_off():
    s = w.Watched()
    s.see("event", {"path": "/r/a/b"}, 0, HOW)
    s.see("event", {"path": "/r/a"}, 1000, HOW)
    assert s.due_at() == 2500 and s.pending == ["/r/a"]
    assert s.begin(2500) == ["/r/a"] and s.due_at() is None
    s.see("event", {"path": "/r/c"}, 2600, HOW)  # waits for the outcome
    assert s.due_at() is None
    s.see("done", {"attempt": 1, "unstable": ["/r/a/x"]}, 3000, HOW)
    assert (s.due_at(), sorted(s.pending)) == (4000, ["/r/a/x", "/r/c"])


def test_too_many_paths_are_the_whole_root():
    s = w.Watched()
    for k in range(4):
        s.see("event", {"path": f"/r/{k}"}, k, HOW)
    assert s.whole and s.pending == [] and s.begin(1503) is None


def test_failures_are_tried_again_and_lose_nothing():
    s, waits, now = w.Watched(), [], 0
    s.see("event", {"path": "/r/a"}, now, HOW)
    for _ in range(9):
        due = s.due_at()
        waits.append(due - now)
        now = due
        paths = s.begin(now)
        s.see("failed", {"attempt": s.attempt}, now, HOW)
        s.see("failed", {"attempt": s.attempt}, now, HOW)  # told twice, counted once
    assert waits == [1500, 1000, 2000, 5000, 15_000, 30_000, 60_000, 300_000, 900_000] and paths is None and s.label == "degraded"
    s.begin(s.due_at())
    s.see("done", {"attempt": s.attempt}, now, HOW)
    assert (s.label, s.due_at()) == ("watching", now + 300_000)


def test_scans_are_counted_from_the_end_of_the_one_before():
    s = w.Watched()
    s.see("root", {}, 0, HOW)
    assert s.due_at() == 300_000 and s.begin(300_000) is None
    s.see("done", {"attempt": 1}, 350_000, HOW)
    assert s.due_at() == 650_000


def test_listings_differ(tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("a")
    (root / "sub" / "b.txt").write_text("b")
    reader = FolderReader({"roots": json.dumps([str(root)]), "state": str(tmp_path / "state"), "buckets": "3", "interval_ms": "0"})

    def step(start):
        end = reader.latestOffset()
        rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
        again = [r for p in reader.partitions(start, end) for r in reader.read(p)]
        assert rows == again  # a task that is run again gives the same
        return end, sorted((r[2][len(str(root)) + 1 :], r[3]) for r in rows)

    first, rows = step(reader.initialOffset())
    assert rows == []
    (root / "a.txt").write_text("aa")
    (root / "sub" / "b.txt").unlink()
    (root / "c.txt").write_text("c")
    second, rows = step(first)
    assert rows == [("a.txt", "change"), ("c.txt", "rename"), ("sub/b.txt", "rename")]
    reader.commit(second)
    assert step(second)[1] == []


def test_a_folder_is_watched(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.txt").write_text("alpha")
    index = Index.open(spark, str(tmp_path / "store"))
    index.sync(str(root))
    calls, failures = [], [OSError("busy")]

    def apply(where, paths):
        calls.append((where, paths))
        if failures:
            raise failures.pop()
        return index.apply(where, paths)

    events = folder_events(spark, [str(root)], str(tmp_path / "listings"), buckets=2, interval_ms=300)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = w.watch(spark, events, apply, str(tmp_path / "watch"), lambda: list(index.store.meta()["roots"]), how=w.Settings(debounce_ms=300), trigger_ms=200)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        began = time.time()
        while not (tmp_path / "listings" / "2").exists() and time.time() - began < 90:
            time.sleep(0.2)
        (root / "b.txt").write_text("beta")
        while index.documents.count() < 2 and time.time() - began < 150 and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    assert query.exception() is None and sorted(r["filename"] for r in index.documents.collect()) == ["a.txt", "b.txt"]
    assert calls[:2] == [(str(root), [str(root / "b.txt")])] * 2  # failed once, then done
