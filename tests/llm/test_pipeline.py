"""The pipeline's stages on a small table: columns, decisions, and what they keep."""

import os
import random
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import language_id
from lodestone.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def docs_of(spark):
    r = random.Random(5)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"]) + str(r.randint(0, 99)) for _ in range(60)) for _ in range(30)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(100 + k, base[k], "en", "s0", len(base[k])) for k in range(5)] + [(200, base[7] + " end", "en", "s1", 1), (201, None, "en", "s1", 0), (202, "1234", "en", None, 4), (203, "write to a@b.example", "en", "s2", 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = docs_of(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[1] == "near_duplicates"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").persist()
        assert out.columns == corpus_pipeline.COLUMNS, name
        ids = sorted(x["doc_id"] for x in out.collect())
        if name == "language_id":
            assert ids == [*range(30), *range(100, 105), 200, 203]
        elif name == "near_duplicates":
            assert ids == [*range(30), 203]
        elif name == "personal_data":
            assert {x["text"] for x in out.where("doc_id = 203").collect()} == {"write to <EMAIL>"}
        else:
            assert set(ids) == {*range(30), 203}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.columns[0] == "doc_id" and packed.select("doc_id").distinct().count() == 31


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and language_id.UNKNOWN == "und"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_run_against_brute_force(spark):
    """Who is kept: by letters and by all pairs' shingle sets; what is packed: the tokenizer's ids of every kept document, whole."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lettered = sorted(i for i, t in docs.items() if t and any(c.isalpha() for c in t))
    sets = {}
    for i in lettered:
        w = docs[i].encode().lower().split()
        sets[i] = {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in lettered}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(lettered):
        for b in lettered[:n]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    kept = {find(i) for i in lettered}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == kept
    tokenizer = Tokenizer.from_file(tokenizer_path())
    plain = [i for i in kept if not any(c.isdigit() or c in "@<" for c in docs[i])]
    tokens = {i: len(tokenizer.encode(docs[i], add_special_tokens=False).ids) + 1 for i in plain}
    assert plain and all(p["doc_tokens"] == tokens[p["doc_id"]] for p in pieces if p["doc_id"] in tokens)
    covered, sequences = defaultdict(int), defaultdict(list)
    for p in pieces:
        covered[p["doc_id"], p["doc_tokens"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert all(n % size == 0 for (_, size), n in covered.items())  # every use of a document is whole
    for rows in sequences.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and sum(n for _, n in rows) <= 4096


def test_odd_tables(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, component long, text_key string, _rows int, position string"
    odd = [(1, None, None, None, None), (1, "", "en", None, 0), (2, "same text here", None, "a", 1), (2, "same text here", None, "a", 1), (2, "another text", "de", "b", 1), (None, "no id", "en", "a", 1), (None, None, None, None, None), (3, "long " * 40_000, "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 7, "k", 1, "p") for r in odd], kinds)
    kept = {"near_duplicates": 7, "personal_data": 8}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        out = stage(spark, docs, "")
        n = out.count()
        assert name == "packing" or (out.columns == corpus_pipeline.COLUMNS and n == kept.get(name, n)), (name, n)
    left = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert sorted(str(r["text"])[:12] for r in left.collect()) == ["another text", "long long lo", "no id", "same text he", "same text he"]
