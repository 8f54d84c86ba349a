import datetime as dt

from lodestone import schema as S
from lodestone.streaming import live

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def test_absorb(spark):
    df = spark.createDataFrame([(p,) for p in ("/r/a", "/r/a/b", "/r/ab", "/r/a/b/c", "/r/x/y", "/r/a")], "path string")
    assert sorted(r[0] for r in live.absorb(df).collect()) == ["/r/a", "/r/ab", "/r/x/y"]


def test_routes(spark):
    rows = [(at(0), "/r", p, "change") for p in (None, "/r", "/r/.lodestoneignore", "/r/a.txt", "/r/.git/x", "/r/n/~$a.doc", "/q/a")]
    got = [(r["path"], r["route"]) for r in live.routed(spark.createDataFrame(rows, S.EVENTS)).collect()]
    assert got == [(None, "reconcile"), ("/r", "reconcile"), ("/r/.lodestoneignore", "reconcile"), ("/r/a.txt", "local")]


def test_every_event_puts_the_end_off(spark):
    rows = [("/r", at(ms)) for ms in (0, 1000, 2400, 5000)] + [("/q", at(100))]
    got = sorted((r["root"], r["events"], r["due_at"]) for r in live.debounced(spark.createDataFrame(rows, "root string, ts timestamp")).collect())
    assert got == [("/q", 1, at(1600)), ("/r", 1, at(6500)), ("/r", 3, at(3900))]


def test_stream_is_applied_root_by_root(spark, tmp_path):
    events = [(at(0), "/r", "/r/a", "change"), (at(1), "/r", "/r/a/b", "change"), (at(2), "/q", None, "rename"), (at(3), "/s", "/s/1", "change"), (at(3), "/s", "/s/2", "change")]
    folder = str(tmp_path / "in")
    spark.createDataFrame(events, S.EVENTS).coalesce(1).write.parquet(folder)
    calls = []
    query = live.apply_stream(live.event_stream(spark, folder, S.EVENTS), lambda root, paths: calls.append((root, paths)), str(tmp_path / "check"), limit=2)
    query.awaitTermination(120)
    assert calls == [("/q", None), ("/r", ["/r/a"]), ("/s", ["/s/1", "/s/2"])]
    assert live.status(query)["state"] == "stopped"
    calls.clear()
    query = live.apply_stream(live.event_stream(spark, folder, S.EVENTS), lambda root, paths: calls.append((root, paths)), str(tmp_path / "check"), limit=1)
    query.awaitTermination(120)
    assert calls == []  # the checkpoint remembers what is done


def test_overflow(spark):
    rows = [("/r", f"/r/{k}") for k in range(4)] + [("/q", "/q/1")]
    got = {r["root"]: r["mode"] for r in live.queue_modes(spark.createDataFrame(rows, "root string, path string"), 3).collect()}
    assert got == {"/r": "reconcile", "/q": "local"}
