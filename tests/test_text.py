import pytest

from lodestone.functions import text as T
from lodestone.functions.snippet import clusters, locate, make_snippet


@pytest.mark.parametrize("raw, wanted", [("ＡＢＣ", "abc"), ("İ", "i̇"), ("ΟΣ", "ος"), ("ｶﾞ", "ガ"), ("e\u0301", "é"), ("Straße", "straße")])
def test_normalize(raw, wanted):
    assert T.normalize(raw) == wanted


def test_norm_column_equals_python(spark):
    values = ["ABC", "İstanbul", "ΟΣ", "", None, "ﬁne ①", "x" * 70000]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(T.norm(df["v"])).collect()]
    assert got == [None if v is None else T.normalize(v) for v in values]


def test_query_terms():
    assert T.query_terms("  A b ") == ("a b", ["a b"])
    assert T.query_terms("  甲\t乙  甲 ", True) == ("甲\t乙  甲", ["甲", "乙"])
    assert T.query_terms("\u3000ＡＢ\u00a0ab", True)[1] == ["ab"]
    for blank in ("", " \t", "\ufeff\u3000"):
        with pytest.raises(ValueError):
            T.query_terms(blank)


def test_parse_types():
    assert T.parse_types(" .PDF , DocX,pdf ") == [".pdf", ".docx"]
    for bad in ("pdf,,txt", "a/b", "a\\b", ""):
        with pytest.raises(ValueError):
            T.parse_types(bad)


def test_utf8_prefix_and_display():
    assert T.utf8_prefix("aé漢🧪", 3) == "aé"
    assert T.utf8_prefix("aé漢🧪", 9) == "aé漢"
    assert T.display_width("a漢e\u0301") == 4
    assert T.clip_width("漢字漢字", 5) == "漢字…"
    assert T.terminal_text("a\x1b[0m\u202eb\n\t") == "a\\u001b[0m\\u202eb\\u000a\\u0009"
    assert T.format_mib(1572864) == "1.50 MiB"
    assert T.format_percent(99999, 100000) == "99.99%" and T.format_percent(5, 5) == "100.00%"
    assert T.format_elapsed(3_723_000) == "1:02:03"


def test_references():
    assert T.parse_reference("12-0123456789abcdef") == (12, "0123456789abcdef")
    for bad in ("12", "x-0123456789abcdef", "1-0123456789ABCDEF"):
        with pytest.raises(ValueError):
            T.parse_reference(bad)


@pytest.mark.parametrize("source, query, wanted", [("caf\u0065\u0301 noir", "café", "cafe\u0301 noir"), ("ＡＢＣ def", "abc", "ＡＢＣ def"), ("in İstanbul now", "istanbul", None), ("the ΟΣ end", "ος", "the ΟΣ end"), ("ｶﾞﾗｽ", "ガ", "ｶﾞﾗｽ"), ("각", "각", "각")])
def test_snippet_keeps_the_source(source, query, wanted):
    text, cut = make_snippet(source, [T.normalize(query)])
    assert not cut
    if wanted is not None:
        assert text == wanted


def test_locate_maps_to_whole_clusters():
    assert locate("xｶﾞy", "ガ") == (1, 3)
    assert locate("abc", "zz") is None
    assert clusters("e\u0301a") == [(0, 2), (2, 3)]


def test_snippet_lengths():
    assert make_snippet("x" * 160, ["x" * 160]) == ("x" * 160, False)
    assert make_snippet("x" * 159 + " y", ["x" * 159]) == ("x" * 159 + "…", False)
    text, cut = make_snippet("🧪" * 200, ["🧪" * 200])
    assert cut and len(text) <= 160 and text.endswith("…")
    long = "w " * 200 + "needle" + " v" * 200
    text, cut = make_snippet(long, ["needle"])
    assert len(text) <= 160 and "needle" in text and text.startswith("…") and text.endswith("…") and not cut
    assert make_snippet("a\n\t b", ["a"]) == ("a b", False)
