"""Words and texts that are made to collide, or to look alike, don't."""

import hashlib

import numpy as np
import pyarrow as pa

from lodestone.llm import jaccard_join, packing, pii, shingles, substring_dedup
from lodestone.llm.queries import tokenizer_path


def thue_morse(n, x, y):
    return "".join(x if bin(k).count("1") % 2 == 0 else y for k in range(n))


def test_complements_have_hashes_of_their_own():
    one, other = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    found = dict(shingles.hashed_rows(pa.array([one, other, "Abc abc", None])))
    assert found[0] != found[1] and found[2][0] != found[2][1] and len(found[3]) == 0
    assert len(set(dict(shingles.hashed_rows(pa.array(["Abc abc"]), lower=True))[0].tolist())) == 1
    items = {c: shingles.mix(np.array([k], np.uint64))[0] for k, c in enumerate("ab")}
    ranges = [shingles.PrimeRangeHash(np.array([items[c] for c in t], np.uint64)).of(np.array([0]), np.array([2048]))[0] for t in (one, other)]
    assert ranges[0] != ranges[1]


def test_windows_that_differ_in_one_word_stay(spark):
    words = [f"w{k}" for k in range(34)]
    docs = [(k, " ".join([*words, thue_morse(1024, x, y)])) for k, (x, y) in enumerate(("ab", "ba"))]
    got = sorted(map(tuple, substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == [(i, 35, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in docs]


def test_documents_that_differ_in_one_word_arent_linked(spark):
    docs = [(k, f"a b c d {thue_morse(1024, x, y)}") for k, (x, y) in enumerate(("ab", "ba"))]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 1)]


def test_special_tokens_count_as_they_are_written():
    words = packing.WordIds(tokenizer_path())
    for text in ("X<|ENDOFTEXT|>Y", "a <|endoftext|> b", "<|StartOfText|>", "<|startoftext|>x", "Plain, Text."):
        assert np.frombuffer(words.ids(text.encode()), np.uint32).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_runs_length_changes_no_mention():
    found = []
    for n in (10, 150, 190, 5000):
        places = list(pii._places("k=x" + "a" * n + "/4111111111111112"))
        found.append([(word, touches) for _, _, word, touches, _ in places])
    assert found == [[("4111111111111112", (False, False))]] * 4
    near = [near for *_, near in pii._places("call Anna: +1 555 0100 or card:4111-1111 now")]
    assert near[0][0].lower().startswith("anna") and near[-1] == ("card", "now")
