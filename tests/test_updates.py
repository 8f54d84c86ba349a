"""Live updates of a real store, contexts of selected documents, imported files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.text import document_reference
from lodestone.operators.search import search
from lodestone.plans import context, reporting
from lodestone.plans.index import Index
from lodestone.sources import imports
from lodestone.sources.store import FormatError, Store
from lodestone.streaming import live
from lodestone.streaming.updater import RootState, Updater


def names(index):
    return sorted(r["filename"] for r in index.documents.collect())


def test_events_change_the_store(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    (root / "sub").mkdir(parents=True)
    other.mkdir()
    for name, text in (("a.txt", "alpha"), ("b.txt", "beta"), ("sub/c.txt", "gamma"), ("sub/d.txt", "delta")):
        (root / name).write_text(text)
    index = Index.open(spark, str(tmp_path / "store"))
    index.sync(str(root))
    ids = {r["filename"]: r["id"] for r in index.documents.collect()}
    now = [1000.0]
    updater = Updater(index, clock=lambda: now[0])
    (root / "a.txt").write_text("alpha two")
    os.remove(root / "b.txt")
    os.remove(root / "sub" / "c.txt"), os.remove(root / "sub" / "d.txt"), os.rmdir(root / "sub")
    (root / "new").mkdir()
    (root / "new" / "e.txt").write_text("epsilon")
    (root / "quiet.txt").write_text("no event")
    events = [(dt.datetime(2024, 1, 1), str(root), str(root / p), "change") for p in ("a.txt", "b.txt", "sub", "sub/c.txt", "new")] + [(dt.datetime(2024, 1, 1), str(other), str(other / "x"), "change")]
    folder = str(tmp_path / "events")
    spark.createDataFrame(events, S.EVENTS).coalesce(1).write.parquet(folder)
    query = live.apply_stream(live.event_stream(spark, folder, S.EVENTS), updater.apply, str(tmp_path / "check"))
    query.awaitTermination(180)
    assert names(index) == ["a.txt", "e.txt"]
    assert {r["filename"]: r["id"] for r in index.documents.collect()}["a.txt"] == ids["a.txt"]
    assert [r["content"] for r in index.blocks.orderBy("content").collect()] == ["alpha two", "epsilon"]
    assert search(index.documents, index.blocks, "two", candidates=index.candidates("alpha two")).count() == 1
    updater.tick()
    assert names(index) == ["a.txt", "e.txt"]  # nothing is due yet
    now[0] += updater.period
    updater.tick()
    assert names(index) == ["a.txt", "e.txt", "quiet.txt"] and [s["state"] for s in updater.status()] == ["watching"]
    assert index.store.format_status()["pending"] == [] and index.clear() == 3 and index.documents.count() == 0


def test_failures_are_tried_again_later_and_later():
    state, at = RootState(), []
    for k in range(9):
        state.failed(OSError("x"), 100.0)
        at.append((state.state, state.due_at - 100))
    assert at == [("retrying", 1), ("retrying", 2), ("retrying", 5), ("retrying", 15), ("retrying", 30), ("degraded", 60), ("degraded", 300), ("degraded", 900), ("degraded", 900)]
    state.succeeded(200.0, True)
    assert (state.state, state.failures, state.scanned_at) == ("watching", 0, 200.0)


def test_commits_write_only_what_changed(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for k in range(30):
        (root / f"f{k}.txt").write_text(f"text {k}")
    index = Index.open(spark, str(tmp_path / "store"))
    index.sync(str(root))
    before = index.store.manifest(index.number)["tables"]
    (root / "f3.txt").write_text("changed")
    index.sync(str(root))
    after = index.store.manifest(index.number)["tables"]
    for table in ("documents", "blocks", "postings"):
        assert len([p for p in after[table] if after[table][p] != before[table].get(p)]) == 1
    assert index.blocks.count() == 30 and index.documents.count() == 30
    meta = index.store.meta() | {"format": 99}
    path = index.store._manifest_path(index.number)
    text = open(path).read()
    open(path, "w").write(text.replace('"format": 3', '"format": 99'))
    with pytest.raises(FormatError):
        Store(spark, str(tmp_path / "store")).meta()
    assert meta["format"] == 99


def test_selected_documents_are_checked_again(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "one.md").write_text("# Head\nneedle here\n# Other\nneedle there")
    (root / "needle.txt").write_text("nothing")
    index = Index.open(spark, str(tmp_path / "store"))
    index.sync(str(root))
    hits = search(index.documents, index.blocks, "needle").withColumn("reference", document_reference(F.col("id"), F.col("path")))
    picked = {r["filename"]: r["reference"] for r in hits.collect()}
    rows = context.prepare(index, [("needle", picked["one.md"]), ("needle", picked["needle.txt"])], seen=hits.select("reference", "rank", "ordinal"))
    assert [len(r["passages"]) for r in rows] == [2, 1] and rows[1]["filename_only"] and rows[0]["last_sync_complete"] is True
    assert "needle here" in context.markdown(rows, ["needle"])
    both = context.prepare(index, [("here there", picked["one.md"])], all_terms=True)
    assert {p["heading"] for p in both[0]["passages"]} == {"Head", "Other"}
    bad = hits.select("reference", (F.col("rank") + 1).alias("rank"))
    for code, call in {
        "CONTEXT_INDEX_CHANGED": lambda: context.prepare(index, [("needle", picked["one.md"])], seen=bad),
        "CONTEXT_REFERENCE_MISSING": lambda: context.prepare(index, [("nothing", picked["one.md"])]),
        "CONTEXT_SELECTION_INVALID": lambda: context.prepare(index, [("needle", "x")]),
        "CONTEXT_OPTIONS_INVALID": lambda: context.prepare(index, [("needle", picked["one.md"])], passages=11),
    }.items():
        with pytest.raises(context.ContextError) as error:
            call()
        assert error.value.code == code
    (root / "one.md").write_text("changed")
    with pytest.raises(context.ContextError) as error:
        context.prepare(index, [("needle", picked["one.md"])])
    assert error.value.code == "CONTEXT_SOURCE_CHANGED"


def test_imports():
    assert imports.upload_name(" a/b\\c‮.txt ") == "a_b_c_.txt" and imports.upload_name("\t") == "_" and imports.upload_name("") == imports.NAMELESS
    with pytest.raises(ValueError):
        imports.upload_extension("a.exe")
    one = imports.import_document("line one\n\nline 三".encode(), "x/y.TXT")
    assert (one.filename, one.extension, one.status, len(one.blocks)) == ("x_y.TXT", ".txt", "indexed", 2)
    whole = imports.render_imported([one])
    assert not whole.truncated and whole.bytes == len(whole.text.encode()) and "### line 第 3 行" in whole.text
    long = imports.import_document(("漢" * 100_000).encode(), "l.txt")
    cut = imports.combine("indexed part", [one, long])
    assert cut.truncated and cut.bytes <= imports.MOST_BYTES and cut.text.endswith(imports.CUT_MARK)
    with pytest.raises(ValueError):
        imports.render_imported([imports.import_document(b" ", "e.txt")])


def test_reporting(tmp_path):
    log = reporting.rotating_log(str(tmp_path / "log"), size=300, files=3)
    for k in range(40):
        log.info("line %d", k)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["log", "log.1", "log.2"] and all(p.stat().st_size <= 300 for p in tmp_path.iterdir())
    (tmp_path / "link").symlink_to(tmp_path)
    assert reporting.instance_hash(str(tmp_path / "link")) == reporting.instance_hash(str(tmp_path))
    out, now = [], [0.0]
    progress = reporting.Progress(out.append, clock=lambda: now[0])
    for phase, at in (("listed", 0), ("listed", 4), ("compared", 4.5), ("compared", 9.6)):
        now[0] = at
        progress(phase, {"files": 1})
    assert out == ["listed: files 1", "compared: files 1", "compared: files 1"]
