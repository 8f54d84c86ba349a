"""Fingerprints against a plain Python version of bins, densification and low-order bits."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from lodestone.llm import fingerprints as fp


def chained(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v, seed=seed).intdigest()
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return ""
    names = [chained(w).to_bytes(8, "little") for w in words]
    shingles = [chained(*names[k : k + 5]) for k in range(len(names) - 4)] if len(names) >= 5 else [chained(*names)]
    bins = [None] * fp.BINS
    for h in shingles:
        k = (h >> 57) ^ 64  # bins stand in the order of signed numbers
        bins[k] = h if bins[k] is None else min(bins[k], h)
    order, full = fp._order(), [k for k, b in enumerate(bins) if b is not None]
    out = []
    for i, b in enumerate(bins):
        if b is None:
            looked = [j for j in order[i * fp.PROBES : (i + 1) * fp.PROBES] if bins[j] is not None]
            last = min(full, key=lambda j: (signed(chained(i.to_bytes(4, "little"), j.to_bytes(4, "little"))) & ~127) | j)  # noqa: B023
            b = bins[looked[0] if looked else last]
        out.append(f"{b & 255:02X}")
    return "".join(out)


def alike(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[2 * k : 2 * k + 2] == b[2 * k : 2 * k + 2] for k in range(fp.BINS))
    return max(0.0, (same / fp.BINS - 1 / 256) / (1 - 1 / 256))


def test_equals_plain_python(spark):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "ü", "漢字", "A", "a"]
    texts = [None, "", " \n", "one", "One two", "a b c d e", "ünï çødé 漢字 🧪", "word " * 3000]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 6, 9, 40, 400]))) for _ in range(40)]
    texts += [texts[-1], texts[-2] + " more"]
    ids = r.sample(range(-50, 1000), len(texts))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], "doc_id long, text string, _words string, next_text string").repartition(3)
    rows = {x["doc_id"]: x for x in fp.fingerprint_edits(df).collect()}
    order = sorted(zip(ids, texts), key=lambda x: -x[0])
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        row = rows[i]
        assert row["fingerprint"] == plain(text) and row["edited_fingerprint"] == plain(edited), text
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and row["n_chars"] == len(text)
        assert abs(row["near_edited"] - alike(plain(text), plain(edited))) < 1e-12 and abs(row["near_next"] - alike(plain(text), plain(after))) < 1e-12
    assert fp.fingerprint_edits(df.limit(0)).count() == 0
    one = fp.fingerprint_edits(df.where(F.col("doc_id") == ids[-1])).first()
    assert one["near_next"] == 1.0
