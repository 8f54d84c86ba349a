import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import is_blank, norm
from lodestone.operators import candidates, passages, search
from lodestone.operators.search import Scope


def build(spark, files):
    """files: (filename, mtime, status, [(heading, content)])."""
    docs = [(k + 1, "/r", f"/r/{n}", n, "." + n.rpartition(".")[2], float(m), s) for k, (n, m, s, _) in enumerate(files)]
    blocks = [(k + 1, o, h, c) for k, f in enumerate(files) for o, (h, c) in enumerate(f[3])]
    d = spark.createDataFrame(docs, "id long, root_path string, path string, filename string, extension string, modified_at_ms double, status string").withColumn("norm_filename", norm(F.col("filename")))
    b = spark.createDataFrame(blocks, "document_id long, ordinal int, heading string, content string").withColumns({"norm_heading": norm(F.col("heading")), "norm_content": norm(F.col("content"))})
    return d, b


def names(rows):
    return [(r["filename"], r["rank"]) for r in rows.collect()]


def test_rank_and_order(spark):
    d, b = build(spark, [("Z.txt", 1, "indexed", [(None, "needle.txt")]), ("A.txt", 1, "indexed", [(None, "needle.txt")]), ("ä.txt", 1, "indexed", [(None, "a needle.txt")]), ("new.txt", 2000, "indexed", [(None, "needle.txt")]), ("title.md", 1, "indexed", [(None, "needle.txt early"), ("needle.txt", "x")]), ("prefix-needle.txt", 1, "indexed", []), ("needle.txt", 1, "indexed", [])])
    assert names(search.search(d, b, "needle.txt")) == [("needle.txt", 4), ("prefix-needle.txt", 3), ("title.md", 2), ("new.txt", 1), ("A.txt", 1), ("Z.txt", 1), ("ä.txt", 1)]
    assert [r["ordinal"] for r in search.search(d, b, "needle.txt").collect()] == [None, None, 1, 0, 0, 0, 0]


def test_literal_query(spark):
    d, b = build(spark, [("f.txt", 1, "indexed", [(None, "a\nb * AND ?")])])
    assert [search.search(d, b, q).count() for q in ("a b", "a\nb", "* AND ?", "a AND b")] == [0, 1, 1, 0]


def test_statuses_are_found_by_filename_and_scope_comes_first(spark):
    d, b = build(spark, [(f"hit-{s}.txt", 1, s, []) for s in ("indexed", "no_text", "unsupported", "too_large", "encrypted", "error")])
    assert search.search(d, b, "hit-").count() == 6
    d, b = build(spark, [("hit.pdf", 9, "indexed", []), ("hit.txt", 1, "indexed", [])])
    assert names(search.search(d, b, "hit", scope=Scope(types=(".txt",)), limit=1)) == [("hit.txt", 3)]
    assert search.search(d, b, "hit", scope=Scope(subtree="/r/hit")).count() == 0


def test_all_terms(spark):
    d, b = build(spark, [("f.txt", 1, "indexed", [(None, "付款"), (None, "例外"), (None, "核准")]), ("g-付款.txt", 1, "indexed", [("例外", "核准 x")])])
    assert search.search(d, b, "付款 例外 核准").count() == 0
    rows = search.search(d, b, "付款 例外 核准", all_terms=True).collect()
    assert {(r["filename"], r["rank"], r["source_kind"], r["ordinal"]) for r in rows} == {("f.txt", 1, "content", 0), ("g-付款.txt", 1, "heading", 0)}
    d, b = build(spark, [("甲乙.txt", 1, "indexed", []), ("h.md", 1, "indexed", [(None, "x"), ("甲 乙", "y")]), ("c.md", 1, "indexed", [(None, "甲"), (None, "乙 甲")])])
    rows = search.search(d, b, "  甲\t乙  甲 ", all_terms=True).collect()
    assert [(r["rank"], r["ordinal"]) for r in rows] == [(3, None), (2, 1), (1, 1)]


def test_all_terms_representative(spark):
    d, b = build(spark, [("f.txt", 1, "indexed", [(None, "a"), (None, "b c"), ("b", "a b"), (None, "c b")])])
    row = search.search(d, b, "a b c", all_terms=True).first()
    assert (row["rank"], row["source_kind"], row["ordinal"]) == (1, "content", 1)


def test_passages(spark):
    d, b = build(spark, [("f.txt", 1, "indexed", [(None, "甲甲甲"), (None, "甲乙"), (None, "丙")])])
    got = passages.all_terms_passages(d, b, "甲 乙 丙", 2).orderBy("passage_no").collect()
    assert [(r["ordinal"], r["matched"]) for r in got] == [(1, 2), (2, 1)]
    assert passages.all_terms_passages(d, b, "甲 丁").count() == 0
    d, b = build(spark, [("f.txt", 1, "indexed", [(None, "x q"), ("q", "y"), (None, "q")])])
    assert [r["ordinal"] for r in passages.phrase_passages(b, "q", 2).orderBy("passage_no").collect()] == [1, 0]


def test_paging(spark):
    d, b = build(spark, [(f"hit{k:02d}.txt", k, "indexed", []) for k in range(45)])
    ranked = search.numbered(search.search(d, b, "hit", limit=None)).persist()
    pages = [search.page_of(ranked, p, 20) for p in (1, 2, 3)]
    assert [(p.start, p.end, p.total, p.page_count) for p in pages] == [(1, 20, 45, 3), (21, 40, 45, 3), (41, 45, 45, 3)]
    found = [r["filename"] for p in pages for r in p.rows.collect()]
    assert found == [f"hit{k:02d}.txt" for k in range(44, -1, -1)]
    with pytest.raises(ValueError):
        search.page_of(ranked, 4, 20)
    empty = search.page_of(ranked.limit(0), 3, 20)
    assert (empty.start, empty.end, empty.page_count) == (0, 0, 1)


def test_refine_keeps_the_first_order(spark):
    files = [(f"n{k}.txt", k, "indexed", [(None, "later" if k in (0, 7) else "x")]) for k in range(10)]
    d, b = build(spark, files)
    first = search.numbered(search.search(d, b, "n", limit=None))
    second = search.refine(first, d, b, "later").orderBy("position").collect()
    assert [r["filename"] for r in second] == ["n7.txt", "n0.txt"] and {r["rank"] for r in second} == {1}


def test_pruning_changes_nothing(spark):
    words = ["ABC987", "abcd", "zz", "漢字漢字", "ab", ""]
    d, b = build(spark, [(f"f{k}.txt", k, "indexed", [("head " + w, w + " body")]) for k, w in enumerate(words)])
    posted = candidates.postings(b).persist()
    for q in ("abc987", "zz", "漢字漢", "body", "head ab", "none"):
        some = candidates.candidates(posted, q)
        assert names(search.search(d, b, q)) == names(search.search(d, b, q, candidates=some))
        full = {r["filename"] for r in search.search(d, b, q + " body", all_terms=True).collect()}
        assert full == {r["filename"] for r in search.search(d, b, q + " body", all_terms=True, candidates=candidates.candidates(posted, q + " body", d)).collect()}
    assert candidates.candidates(posted, "zz") is None


def test_long_block(spark):
    d, b = build(spark, [("f.txt", 1, "indexed", [(None, "x" * 65535 + " the phrase")])])
    assert search.search(d, b, "x the phrase").count() == 1


def test_grams_equal_brute_force():
    """Both ways to sort: one number for gram and document, and two where characters leave no room."""
    texts = {"narrow": ["abcabc", "ab", "", "bca b", "漢字漢字漢"], "wide": ["a\U0010ffff\U0001f600漢a\U0010ffff\U0001f600漢", "aaaa"]}
    for found in texts.values():
        ids = np.array([7 * 10**12 + k % 2 for k in range(len(found))], np.int64)
        expected = {(candidates.gram_code(t[k : k + 3]), i) for t, i in zip(found, ids.tolist()) for k in range(len(t) - 2)}
        got = list(zip(*(x.tolist() for x in candidates._grams(ids, found))))
        assert len(got) == len(set(got)) and set(got) == expected


def test_blank(spark):
    rows = [("",), (" \t　﻿",), ("\n x",), (None,), ("\U0001f600",)]
    got = spark.createDataFrame(rows, "t string").select(is_blank(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, None, False]
