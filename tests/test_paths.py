import pytest

from lodestone.functions import paths as P
from lodestone.plans.roots import ownership_base, plan_root, resolve_scope


@pytest.mark.parametrize("parent, child, wanted", [("/tmp/備份", "/tmp/備份2", False), ("/tmp/備份", "/tmp/備份/x", True), ("D:\\備份", "D:\\備份2", False), ("D:\\Data", "d:/data/x", True), ("\\\\host\\share", "\\\\HOST\\share\\a", True), ("\\\\host\\share", "\\\\host\\share2", False), ("/", "/a", True), ("D:\\", "/a", False)])
def test_covers(parent, child, wanted):
    assert P.covers(parent, child) is wanted


def test_same_and_strict():
    assert P.same_path("/a/b/", "/a/./b") and not P.same_path("/a/B", "/a/b") and P.same_path("C:\\A", "c:\\a\\")
    assert not P.covers("/a", "/a", strictly=True)
    with pytest.raises(ValueError):
        P.parse_path("a/b")


def test_root_plan():
    roots = ["/data", "/data/deep/er", "/other"]
    assert plan_root(roots, "/data").kind == "existing"
    assert plan_root(roots, "/data/deep/er/x") == plan_root(roots, "/data/deep/er/x") and plan_root(roots, "/data/deep/er/x").root == "/data/deep/er"
    assert plan_root(["/a/b", "/a/c", "/d"], "/a").children == ("/a/b", "/a/c")
    assert plan_root(roots, "/new").kind == "independent"


def test_resolve_scope():
    history = {"/old": "/mid", "/mid": "/data", "/loop": "/loop2", "/loop2": "/loop"}
    assert resolve_scope(["/data"], [("/data", "/base")], history, "/data") == ("/data", None)
    assert resolve_scope(["/data"], [("/data", "/base")], history, "/base") == ("/data", "/base")
    assert resolve_scope(["/data"], [], history, "/data/x") == ("/data", "/data/x")
    assert resolve_scope(["/data"], [], history, "/old") == ("/data", "/old")
    with pytest.raises(LookupError):
        resolve_scope(["/data"], [], history, "/loop")
    assert ownership_base("/r", ["/b"], "/b/x") == "/b" and ownership_base("/r", ["/b"], "/r/x") == "/r"


@pytest.mark.parametrize("path, folder, wanted", [("cache", True, True), ("cache", False, False), ("x/cache", True, False), ("x/archive", True, True), ("a.BAK", False, True), ("x/a.bak", False, True), ("reports/q/draft1.txt", False, True), ("reports/draft1.txt", False, True), ("reports/q/draft12.txt", False, False), ("x/reports/draft1.txt", False, False)])
def test_ignore_rules(path, folder, wanted):
    rules = P.ignore_rules("# comment\n/cache/\narchive/\n*.bak\nreports/**/draft?.txt\n")
    assert any(r.matches(path, folder) for r in rules) is wanted


def test_ignore_rules_reject_negation():
    with pytest.raises(ValueError):
        P.ignore_rules("!keep")


def test_columns(spark):
    df = spark.createDataFrame([("/a/b/c.TXT",), ("/a/.hidden",), ("/x",)], "p string")
    got = df.select(P.basename(df["p"]), P.extension(P.basename(df["p"])), P.ancestors(df["p"])).collect()
    assert [tuple(r) for r in got] == [("c.TXT", ".txt", ["/a", "/a/b", "/a/b/c.TXT"]), (".hidden", "", ["/a", "/a/.hidden"]), ("x", "", ["/x"])]
    order = spark.createDataFrame([("～",), ("🧪",)], "p string").orderBy(P.utf16_order(df["p"]) if False else P.utf16_order(__import__("pyspark.sql.functions", fromlist=["col"]).col("p"))).collect()
    assert [r[0] for r in order] == ["🧪", "～"]
