import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import classify, maintain, stats
from lodestone.plans import context
from lodestone.plans.index import Index
from lodestone.plans.session import SearchSession
from lodestone.sources.listing import scan
from lodestone.sources.store import LockedError, SnapshotChanged, Store


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_scan(tmp_path):
    write(tmp_path, a_dot_txt="x", _dot_hid__b_dot_txt="y", node_modules__c_dot_txt="z", skip__d_dot_txt="z", e_dot_bak="z", docs__f_dot_md="z")
    (tmp_path / "~$tmp.docx").write_text("z")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    (tmp_path / ".lodestoneignore").write_text("/skip/\n*.bak\n")
    found = scan(str(tmp_path))
    assert [f[1] for f in found.files] == ["b.txt", ".lodestoneignore", "a.txt", "f.md"]
    assert dict(found.skipped) == {"builtin": 2, "ignored": 2, "link": 1}
    assert [f[1] for f in scan(str(tmp_path), start=str(tmp_path / "docs")).files] == ["f.md"]
    assert scan(str(tmp_path), start=str(tmp_path / "skip")).files == []


def test_lifecycle(spark, tmp_path):
    root = tmp_path / "root"
    write(root, a_dot_txt="alpha beta", b_dot_md="# Head\nbeta", sub__c_dot_txt="gamma", d_dot_bin="q", bad_dot_csv='"')
    index = Index.open(spark, str(tmp_path / "store"))
    report = index.sync(str(root))
    assert (report["found"], report["added"], report["parser_calls"], report["metadata_only"], report["complete"]) == (5, 5, 4, 1, True)
    ids = {r["filename"]: r["id"] for r in index.documents.collect()}
    assert sorted(ids.values()) == [1, 2, 3, 4, 5]
    again = index.sync(str(root))
    assert (again["unchanged"], again["parser_calls"], again["reasons"]) == (4, 1, {"unchanged": 4, "error-retry": 1})
    write(root, a_dot_txt="alpha delta", e_dot_txt="new")
    os.remove(root / "sub" / "c.txt")
    third = index.sync(str(root))
    assert (third["added"], third["removed"], third["reasons"]["source-changed"]) == (1, 1, 1)
    now = {r["filename"]: r["id"] for r in index.documents.collect()}
    assert {k: v for k, v in now.items() if k != "e.txt"} == {k: v for k, v in ids.items() if k != "c.txt"} and now["e.txt"] == 6
    session = SearchSession(index, "delta")
    assert [r["path"] for r in session.page().rows.collect()] == [str(root / "a.txt")]
    statuses = {r["status"]: r["documents"] for r in index.status()["statuses"].collect()}
    assert statuses == {"indexed": 3, "no_text": 0, "unsupported": 1, "too_large": 0, "encrypted": 0, "error": 1}
    part = index.sync(str(root / "sub"))
    assert part["found"] == 0 and "successful_at_ms" not in part
    with pytest.raises(SnapshotChanged):
        session.append("alpha")
    assert index.changed_since(str(root / "a.txt")) is False and index.changed_since("/nowhere") is None
    merged = index.sync(str(tmp_path))
    assert set(index.meta["roots"]) == {str(tmp_path)} and index.meta["history"] == [[str(root), str(tmp_path)]]
    assert merged["reasons"]["unchanged"] >= 4
    assert index.remove_root(str(tmp_path)) == index_count(merged) and index.documents.count() == 0


def index_count(report):
    return report["found"]


def test_sessions_refine(spark, tmp_path):
    root = tmp_path / "root"
    write(root, **{f"n{k}_dot_txt": "common " + ("rare" if k % 3 == 0 else "x") for k in range(7)})
    index = Index.open(spark, str(tmp_path / "store"))
    index.sync(str(root))
    session = SearchSession(index, "common")
    assert session.page(1, 3).total == 7
    session.append("rare")
    page = session.page(1, 2)
    assert (page.total, page.page_count, [r["position"] for r in page.rows.collect()]) == (3, 2, [1, 2])
    session.back()
    assert session.page().total == 7
    rows = context.bundle(index.documents, index.blocks, "rare", limit=2).collect()
    assert len(rows) == 2 and rows[0]["passages"][0]["content"] == "common rare"
    assert "common rare" in context.markdown([r.asDict(True) for r in rows], ["rare"])


def test_lock(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with store.writing():
        with pytest.raises(LockedError):
            with store.writing():
                pass
    (tmp_path / "writer.lock").write_text("999999999")
    with store.writing():  # its owner is gone
        pass


def test_classify_reasons(spark):
    listing = spark.createDataFrame([(p, p, e, 1, 1.0) for p, e in [("new", ".txt"), ("size", ".txt"), ("time", ".txt"), ("err", ".txt"), ("old", ".txt"), ("large", ".txt"), ("unsup", ".pdf"), ("same", ".docx"), ("bin", ".bin")]], "path string, filename string, extension string, size_bytes long, modified_at_ms double")
    before = spark.createDataFrame([("size", "indexed", 1, 2, 1.0), ("time", "indexed", 1, 1, 1.5), ("err", "error", 1, 1, 1.0), ("old", "indexed", None, 1, 1.0), ("large", "too_large", None, 1, 1.0), ("unsup", "unsupported", None, 1, 1.0), ("same", "indexed", None, 1, 1.0), ("bin", "unsupported", None, 1, 1.0)], "path string, status string, parse_version int, size_bytes long, modified_at_ms double")
    got = {r["path"]: (r["reason"], r["action"]) for r in classify.compare(listing, before).collect()}
    assert got == {"new": ("added", "parse"), "size": ("source-changed", "parse"), "time": ("source-changed", "parse"), "err": ("error-retry", "parse"), "old": ("text-upgrade", "parse"), "large": ("unchanged", "skip"), "unsup": ("unsupported-retry", "parse"), "same": ("unchanged", "skip"), "bin": ("unchanged", "skip")}
    assert {r["reason"] for r in classify.compare(listing, before, rebuild=True).collect()} == {"rebuild"}


def test_remove_missing_is_by_component(spark):
    docs = spark.createDataFrame([(1, "/r", "/r/a/x"), (2, "/r", "/r/ab/x"), (3, "/q", "/q/x"), (4, "/r", "/r/k")], "id long, root_path string, path string")
    listed = spark.createDataFrame([("/r/k",)], "path string")
    scopes = spark.createDataFrame([("/r/a",)], "path string")
    got = {r["id"]: r["outcome"] for r in maintain.remove_missing(docs, listed, root="/r", protected=scopes).collect()}
    assert got == {1: "protected", 2: "deleted", 3: "kept", 4: "kept"}


def test_history_with_circles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "former_path string, parent_path string")
    assert sorted(tuple(r) for r in maintain.root_history(edges).collect()) == [("a", "c", 2), ("b", "c", 1)]


def test_percentiles_are_nearest_rank(spark):
    rows = spark.createDataFrame([("g", v) for v in range(1, 21)] + [("e", None)], "k string, v long")
    got = {r["k"]: (r["n"], r["p50"], r["p95"], r["max"]) for r in stats.percentiles(rows, "k", "v").collect()}
    assert got == {"g": (20, 10, 19, 20), "e": (0, 0, 0, 0)}
    total = stats.storage_total(spark.createDataFrame([(1,), (None,)], "size_bytes long")).first()
    assert (total["files"], total["bytes"]) == (2, None)


def test_selection():
    chosen = context.Selection()
    chosen.toggle([f"{k}-x" for k in range(20)], "q")
    with pytest.raises(ValueError):
        chosen.toggle(["0-x", "a", "b"], "q")
    assert len(chosen.references) == 20
    chosen.toggle(["0-x", "a"], "r")
    assert chosen.references[-1] == "a" and chosen.queries == ["q", "r"] and chosen.page(2) == chosen.references[10:20]
    with pytest.raises(ValueError):
        context.serialize([{"t": "x" * context.MOST_BYTES}], ["q"])
    assert F is not None
