"""Phrases against counting in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lodestone.llm import phrases


def counted(rows, least, first):
    words, grams = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            words[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    grams[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in grams.items():
        kept = []
        frequent = {g: a for g, a in f.items() if a >= least and len(g) > 1}
        for g, a in frequent.items():
            inside = lambda h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))  # noqa: B023, E731
            if any(len(h) > len(g) and 100 * b >= 80 * a and inside(h) for h, b in frequent.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_plain_counting(spark, seed):
    r = random.Random(seed)
    vocabulary = ["The", "the", "a", "é", "漢", "x-y", "B", "b", "\x1cz", "zz"]
    rows = []
    for _ in range(150):
        n = r.randint(0, 30)
        rows.append((r.choice(["en", "de", None, "und"]), "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!\r\n", " ; "]) for _ in range(n)) + r.choice(["", "the a the a the a b zz."])))
    rows += [("en", None), ("en", ""), (None, " ,. "), *[("de", "one two three four five")] * 12, ("fr", "word " * 5000), ("fr", "a b. " * 3000)]
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, chunk int, id string").repartition(5)  # a chunk for each task
    got = sorted(tuple(x) for x in phrases.collocations(df, least=4, first=25).collect())
    assert got == counted(rows, 4, 25)


def test_empty_tables_give_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_slices_end_with_pieces():
    text = "One two. three four five, six " * 50
    whole = b" ".join(phrases.slices(text.encode(), 1 << 20)).split()
    parts = b" \xff ".join(phrases.slices(text.encode(), 40)).split()
    assert b" ".join(parts).replace(b"\xff", b" ").split() == b" ".join(whole).replace(b"\xff", b" ").split() and all(len(s) < 80 for s in phrases.slices(text.encode(), 40))
    assert list(phrases.slices(b"no end at all " * 20, 40)) == [b"no end at all " * 20]
