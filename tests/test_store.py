"""Commits, layouts, parts, deletions that can't be confirmed, and listing by rounds."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import document_reference
from lodestone.operators.search import search
from lodestone.plans.index import Index, SourceError
from lodestone.sources import listing, store
from lodestone.sources.listing import scan, scan_tree
from lodestone.sources.store import SnapshotChanged, Store


def tree(root, n=12):
    for k in range(n):
        path = root / f"d{k % 3}" / f"e{k % 2}" / f"f{k}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"common text {k}")


def test_rounds_list_what_one_walk_does(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, 40)
    (root / ".git").mkdir()
    (root / ".git" / "x").write_text("x")
    (root / "skip").mkdir()
    (root / "skip" / "y.txt").write_text("x")
    (root / "link.txt").symlink_to(root / "d0")
    (root / listing.IGNORE_FILE).write_text("/skip/\n")
    wanted = scan(str(root))
    for most in (1, 7, 1000):  # many rounds, some, one
        found = scan_tree(spark, str(root), most=most)
        assert sorted(map(tuple, found.files.collect())) == sorted(wanted.files)
        assert found.skipped == dict(wanted.skipped) and found.counts["file"] == 41 and found.protected.count() == 0
    some = scan_tree(spark, str(root), [str(root / "d1"), str(root / "d0/e0/f0.txt"), str(root / "gone"), str(root / "skip/y.txt")])
    assert sorted(r["filename"] for r in some.files.collect()) == sorted({f[1] for f in wanted.files if "/d1/" in f[0]} | {"f0.txt"})
    away = scan_tree(spark, str(tmp_path / "nowhere"), [str(tmp_path / "nowhere" / "a")])
    assert [r["path"] for r in away.protected.collect()] == [str(tmp_path / "nowhere" / "a")] and away.counts == {"error": 1}


def test_a_root_that_is_offline_keeps_its_documents(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, 5)
    index = Index.open(spark, str(tmp_path / "store"))
    index.sync(str(root))
    os.rename(root, tmp_path / "away")
    report = index.apply(str(root), [str(root / "d0/e0/f0.txt")])
    assert (report["removed"], report["complete"], index.documents.count()) == (0, False, 5) and report["unstable"]
    with pytest.raises(NotADirectoryError):
        index.sync(str(root))
    os.rename(tmp_path / "away", root)
    os.remove(root / "d0/e0/f0.txt")
    assert index.apply(str(root), [str(root / "d0/e0/f0.txt")])["removed"] == 1 and index.documents.count() == 4


def old_layout(folder, index):
    """The index as layout 2 had it: no postings, no list of parts that have them."""
    path = index.store._manifest_path(index.store.current())
    with open(path) as file:
        found = json.load(file)
    found["meta"]["format"] = 2
    del found["tables"]["postings"], found["posted"]
    with open(path, "w") as file:
        json.dump(found, file)
    return Index.open(index.store.spark, folder)


def test_an_upgrade_loses_no_hit_and_goes_on_where_it_was(spark, tmp_path):
    root, folder = tmp_path / "root", str(tmp_path / "store")
    tree(root, 20)
    index = Index.open(spark, folder)
    index.sync(str(root))
    index = old_layout(folder, index)
    hits = lambda: search(index.documents, index.blocks, "common text", limit=100, candidates=index.candidates("common text")).count()
    assert hits() == 20
    (root / "d0/e0/f0.txt").write_text("common text anew")
    index.sync(str(root))
    status = index.store.format_status()
    assert hits() == 20 and status["format"] == 2 and 0 < status["pending_parts"] < status["parts"]
    left = index.store.upgrade(batch=2, most=1)  # as if it were killed after a commit
    assert left == status["pending_parts"] - 2
    index = Index.open(spark, folder)
    assert hits() == 20 and index.store.upgrade(batch=3) == 0
    index = Index.open(spark, folder)
    assert hits() == 20 and index.store.format_status()["pending_parts"] == 0 and index.store.format_status()["format"] == store.FORMAT_VERSION
    assert index.postings.groupBy("gram", "document_id").count().where("count > 1").count() == 0


def test_of_two_writers_from_one_snapshot_one_fails(spark, tmp_path):
    one = Store(spark, str(tmp_path / "store"))
    documents, blocks = one.table("documents"), one.table("blocks")
    assert one.commit(documents, blocks, one.meta(), base=0) == 1
    with pytest.raises(SnapshotChanged):
        one.commit(documents, blocks, one.meta(), base=0)
    with pytest.raises(SnapshotChanged):
        one.record(0, one.meta())
    assert one.current() == 1


def test_a_lock_is_renewed_while_its_holder_lives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LEASE_SECONDS", 0.5)
    one = Store(spark, str(tmp_path / "store"))
    path = tmp_path / "store" / "writer.lock"
    with one.writing():
        path.write_text(json.dumps({"host": "elsewhere", "pid": 1, "at": 0}))
        for _ in range(12):
            time.sleep(0.1)
            assert not Store._abandoned(str(path))
        (tmp_path / "store" / "writer.lock.judge").write_text("")  # of one that was killed
        os.utime(tmp_path / "store" / "writer.lock.judge", (1, 1))
        assert not Store._abandoned(str(path)) and not Store._abandoned(str(path))
    path.write_text(json.dumps({"host": "elsewhere", "pid": 1, "at": 0}))
    os.utime(path, (1, 1))
    assert Store._abandoned(str(path)) and threading.active_count() < 50


def test_parts_double_when_the_largest_is_too_large(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, 24)
    index = Index(Store(spark, str(tmp_path / "store"), parts=2, part_bytes=1))
    index.sync(str(root))
    assert index.store.manifest(index.number)["parts"] == 2
    reader = Index.open(spark, str(tmp_path / "store"))
    for k, parts in ((0, 4), (1, 8)):
        (root / f"new{k}.txt").write_text(f"common more {k}")
        index.sync(str(root))
        found = index.store.manifest(index.number)
        assert found["parts"] == parts and index.documents.count() == index.blocks.count() == 25 + k
        assert search(index.documents, index.blocks, "common", limit=100, candidates=index.candidates("common")).count() == 25 + k
    assert reader.documents.count() == 24 and reader.blocks.count() == 24  # it stays on the snapshot that it began with


def test_references_lead_to_files_or_say_why_not(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, 3)
    index = Index.open(spark, str(tmp_path / "store"))
    index.sync(str(root))
    rows = {r["filename"]: r["reference"] for r in index.documents.select("filename", document_reference(F.col("id"), F.col("path")).alias("reference")).collect()}
    assert index.resolve(rows["f0.txt"]) == {"path": str(root / "d0/e0/f0.txt"), "changed": False}
    (root / "d0/e0/f0.txt").write_text("other")
    assert index.resolve(rows["f0.txt"])["changed"]
    os.rename(root / "d1", root / "real")
    (root / "d1").symlink_to(root / "real")
    os.unlink(root / "d2/e0/f2.txt")
    (root / "d2/e0/f2.txt").mkdir()
    ident = rows["f1.txt"].split("-")[0]
    for reference, code in (("x", "INVALID"), (f"{ident}-{'0' * 16}", "STALE"), ("999-" + "0" * 16, "STALE"), (rows["f1.txt"], "LINK_REJECTED"), (rows["f2.txt"], "NOT_FILE")):
        with pytest.raises(SourceError) as failed:
            index.resolve(reference)
        assert failed.value.code.endswith(code)
    os.rmdir(root / "d2/e0/f2.txt")
    with pytest.raises(SourceError) as failed:
        index.resolve(rows["f2.txt"])
    assert failed.value.code == "ACTION_SOURCE_UNAVAILABLE"


def test_parts_that_double_bring_nothing_back(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, 20)
    index = Index.open(spark, str(tmp_path / "store"))
    index.sync(str(root))
    index.store.part_bytes = 1  # the next commit doubles
    gone = sorted(root.rglob("*.txt"))[0]
    os.remove(gone)
    assert index.sync(str(root))["removed"] == 1
    ids = {r["id"] for r in index.documents.collect()}
    assert len(ids) == 19 and index.store.manifest(index.number)["parts"] == 16
    for table in (index.blocks, index.postings):
        assert {r["document_id"] for r in table.select("document_id").distinct().collect()} == ids
    keys = index.blocks.groupBy("document_id", "ordinal").count()
    assert keys.where("count > 1").count() == 0


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    one = Store(spark, str(tmp_path / "store"), parts=2)
    documents = one.table("documents")
    rows = spark.range(0, 4000, 1, 8).selectExpr("id % 100 as document_id", "cast(id div 100 as int) as ordinal", "sha2(cast(id as string), 512) as norm_content")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        blocks = one.table("blocks").unionByName(rows, allowMissingColumns=True)
        one.commit(documents, blocks, one.meta())
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "store" / "tables" / "blocks").rglob("*.parquet"))) > 4
    assert one.table("blocks").select("document_id", "ordinal").distinct().count() == one.table("blocks").count() == 4000
    posted = one.table("postings")
    assert posted.count() == posted.distinct().count() and {r["document_id"] for r in posted.select("document_id").distinct().collect()} == set(range(100))


def test_rounds_of_a_listing_grow_with_the_logarithm(spark, tmp_path):
    folder = tmp_path / "root"
    for k in range(20):
        folder = folder / f"d{k}"
        folder.mkdir(parents=True)
        (folder / "f.txt").write_text("x")
    found = scan_tree(spark, str(tmp_path / "root"), most=1)
    assert found.files.count() == found.counts["file"] == 20
    assert len([n for n in os.listdir(found.folder.removeprefix("file:")) if n.startswith("round=")]) <= 6
