import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import substring_dedup as S

WINDOW = S.WINDOW


def brute(docs):
    words = [(text or "").encode().split() for _, text in docs]
    seen = Counter(tuple(w[p : p + WINDOW]) for w in words for p in range(len(w) - WINDOW + 1))
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = [False] * len(w)
        for p in range(len(w) - WINDOW + 1):
            if seen[tuple(w[p : p + WINDOW])] > 1:
                gone[p : p + WINDOW] = [True] * WINDOW
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in S.remove_repeats(df.repartition(3)).collect()), key=key)


def random_corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(r.choice([1, 2, 3, 8, 200]))]
    passage = [r.choice(vocabulary) + "x" * r.randint(0, 1) for _ in range(90)]
    docs = []
    for k in range(30):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 160))]
        kind = r.randint(0, 5)
        if kind == 0:
            cut = r.randint(0, 50)
            words[10:10] = passage[cut : cut + r.randint(30, 60)]
        elif kind == 1:
            words = [vocabulary[0]] * r.randint(30, 400)
        elif kind == 2:
            period = [r.choice(vocabulary) for _ in range(r.randint(1, 9))]
            words += period * r.randint(1, 40)
        elif kind == 3 and docs:
            words = (docs[r.randrange(len(docs))][1] or "").split()
            if words:
                words[r.randrange(len(words))] = "edit"
        docs.append((k, r.choice([" ", "\n", "\t "]).join(words)))
    return docs


@pytest.mark.parametrize("seed", range(8))
def test_against_brute_force(spark, seed):
    docs = random_corpus(seed)
    assert run(spark, docs) == sorted(brute(docs), key=key)


def test_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(60))
    docs = [(1, None), (2, ""), (3, "a b"), (4, long), (4, long), (None, "x " + long), (5, long.replace(" ", " ")), (6, " ".join(f"u{k}" for k in range(20000)))]
    assert run(spark, docs) == sorted(brute(docs), key=key)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, k1 string, starts int")
    assert S.remove_repeats(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "q", 1)], "doc_id long, text string, k1 string, starts int")
    assert [tuple(r)[:3] for r in S.remove_repeats(df, keep_text=True).collect()] == [(1, 2, 0)]


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(5)
    passage = r.integers(1, 50, 120).astype(np.uint64)
    docs = [np.concatenate([r.integers(1, 50, r.integers(0, 80)).astype(np.uint64), passage, r.integers(1, 50, 40).astype(np.uint64)]) for _ in range(6)]
    parse = S.Parse(docs)
    parse.run()
    anchors = {}
    for i, start in enumerate(parse.starts):
        window = tuple(parse.words[start : start + WINDOW])
        a = parse.anchor[i]
        what = None if a < 0 else (parse.anchor_key[a], parse.anchor_at[a] - start)
        assert anchors.setdefault(window, what) == what
    assert (parse.anchor >= 0).mean() > 0.9


def test_range_hashes_are_of_content_only():
    items = np.array([5, 7, 9, 5, 7, 9, 1], np.uint64)
    h = S.RangeHash(items, S._BASES[0])
    assert h.of(np.array([0]), np.array([3])) == h.of(np.array([3]), np.array([6]))
    assert h.of(np.array([0]), np.array([3])) != h.of(np.array([3]), np.array([7]))


def test_batches_of_texts_that_a_task_has_had():
    text = " ".join(f"w{k}" for k in range(WINDOW + 5))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([text, text + " x"])], names=["k1", "k2", "text"])
    assert [[row for _, row in group] for group in S._documents(iter([batch, batch, batch.slice(0, 0)]))] == [[[1, 1], [2, 2]]]
