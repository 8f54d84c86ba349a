"""The corpus operators against brute force on small tables, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprints, jaccard_join, jpeg, language_id, media, packing, pii, queries, resharding, shingles, warc
from lodestone.llm.queries import tokenizer_path

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (4, "a b"), (None, "x y z"), (5, "ünï çødé 漢字 🧪"), (6, "word " * 30000), (7, "12 34"), (8, "a b")]
SCHEMA = "doc_id long, text string, lang string, source string, hub string, spans int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, "h", 1) for k, (i, t) in enumerate(rows)], SCHEMA)


# Jaccard join ---------------------------------------------------------------------------------------------------------


def shingle_sets(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    return out


def linked(rows):
    sets = shingle_sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), None if rows[k][0] is None else min(groups[find(k)])) for k in range(len(rows))]


def near_corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for k in range(60):
        if rows and r.random() < 0.6:
            words = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(0, max(1, len(words) // 30))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                words += [r.choice(vocabulary) for _ in range(r.randint(1, 15))]
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([1, 4, 6, 9, 12, 40, 90, 200]))] + (passage if r.random() < 0.5 else [])
        rows.append((1000 - k * 7, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = near_corpus(seed)
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == sorted(linked(rows))


def test_near_duplicates_odd_rows(spark):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(frame(spark, ODD)).collect()), key=key)
    assert got == sorted(linked(ODD), key=key)
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0


def test_similar_sets_share_enough_keys():
    r = np.random.default_rng(3)
    hot = np.zeros(jaccard_join.HOT_BUCKETS, np.uint8)
    for n in (3, 9, 17, 60, 380, 500, 515, 3000, 4090):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
            keep = a[r.permutation(len(a))[: int(len(a) * r.uniform(0.86, 1.0)) or 1]]
            b = np.unique(np.concatenate([keep, r.integers(0, 1 << 62, r.integers(0, 1 + n // 8)).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if len(a) == len(b) == same or 100 * same < 75 * (len(a) + len(b) - same):
                continue
            common = len(np.intersect1d(jaccard_join.join_keys(a, hot), jaccard_join.join_keys(b, hot)))
            assert common >= min(jaccard_join.shared_keys(len(a)), jaccard_join.shared_keys(len(b)))
            assert jaccard_join.sketch_distance(jaccard_join.bit_sketch(a), jaccard_join.bit_sketch(b)) <= len(a) + len(b) - 2 * same


def test_word_hashes_are_of_words():
    import pyarrow as pa

    texts = ["a b", None, "", " a\tb\n", "B A", "x" * 700_000 + " tail " + "y " * 300_000, "ab"]
    got = {i: h.tolist() for i, h in shingles.hashed_rows(pa.array(texts), lower=True)}
    assert got[0] == got[3] == got[4][::-1] and got[1] == got[2] == [] and len(got[5]) == 300_002 and got[6][0] not in got[0]
    assert len({h for _, h in ((0, x) for x in got[5])}) == 3


# Fingerprints ---------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    r = random.Random(2)
    rows = [(k * 3, " ".join(r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(r.randint(0, 300)))) for k in range(40)] + [(500, rows_text := "same text here " * 9), (501, rows_text)]
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_edits(frame(spark, rows)).collect()}
    order = sorted((i for i, _ in rows), reverse=True)
    text = dict(rows)
    sets = lambda t: shingle_sets([(0, t)])[0]
    for k, i in enumerate(order):
        t, u = text[i], text[order[(k + 1) % len(order)]]
        n = len(t) // 3
        edited = t[: len(t) - n] + u[:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((got[i]["near_edited"], edited), (got[i]["near_next"], u)):
            a, b = sets(t), sets(other)
            assert abs(value - (1.0 if not a and not b else len(a & b) / len(a | b))) < 0.25
    assert got[500]["fingerprint"] == got[501]["fingerprint"] and got[501]["near_next"] == 1.0


def test_fingerprints_odd_rows(spark):
    got = fingerprints.fingerprint_edits(frame(spark, ODD)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    one = fingerprints.fingerprint_edits(frame(spark, [(1, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0


# Personal data --------------------------------------------------------------------------------------------------------


def slow_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(4)
    for _ in range(5000):
        text = "".join(r.choice("a1.@-+ (2_é") for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == slow_spans(text)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a@" * 50_000) == []


def test_repeated_mentions_take_the_label_of_observed_ones():
    field = pii.SkipChain.fit(pii.mentions([(k, f"pay 4111111111111111 or call +1 (555) 010-99{k % 10}9 x{k} {k}", pii.base_spans(f"pay 4111111111111111 or call +1 (555) 010-99{k % 10}9 x{k} {k}")) for k in range(60)]))
    text = "card 4111111111111111 again 4111111111111112 and 17"
    base = pii.base_spans(text)
    added = [s for _, s in field.added(pii.mentions([(0, text, base)]))]
    assert base == [("card", 5, 21)] and added == [("card", 28, 44)]


def test_evidence_reaches_all_mentions_of_a_key_and_a_shape():
    labels = len(pii.LABELS)
    field = pii.SkipChain(np.zeros((pii.FEATURES, labels)), np.zeros((labels, labels)), np.array([2.0, 1.5]))
    card = pii.LABELS.index("card")
    text = "card 4111111111111111 then " + " and ".join(f"41111111111{k:05}" for k in range(11120, 11160))
    text += " " + " or ".join(["4111111111111112"] * 40)
    m = pii.mentions([(0, text, pii.base_spans(text)[:1])])
    p = field.marginals(m)[m.observed < 0]
    assert len(p) == 80 and (p.argmax(1) == card).all() and np.ptp(p[:40, card]) < 0.01 and np.ptp(p[40:, card]) < 0.01
    assert len(m.edges) <= 3 * len(m.document)
    both = field.marginals(pii.mentions([(0, text, pii.base_spans(text)[:1]), (1, "7 " * 300 + "a1 a1", []), (2, "x@y", [])]))
    assert (both[: len(m.document)] == field.marginals(m)).all()  # documents settle by themselves


def test_long_runs_give_their_pieces():
    wanted = ["4111111111111112", "4111-1111-1111-1111", "+1(555)010-9999", "10.0.0.1", "a.b+c@d.example"]
    text = "é " + '{"k":"' + "x" * 300 + '","n":["' + '","'.join(wanted) + '"]}' + " 17, " + ",".join(wanted) + "," + "漢" * 300 + wanted[0]
    base = pii.base_spans(text)
    m = pii.mentions([(0, text, base)])
    found = [text[a:b] for a, b in zip(m.start, m.end)]
    assert found == [*wanted, "17", *wanted, wanted[0]] and [pii.LABELS[k] for k, w in zip(m.observed, found) if w == "a.b+c@d.example"] == ["email"] * 2
    assert not (m.edges[:, 2] == 0).any()  # a comma parts them
    labels = len(pii.LABELS)
    field = pii.SkipChain(np.zeros((pii.FEATURES, labels)), np.zeros((labels, labels)), np.array([2.0, 0.5]))
    field.unary[1 + 16, pii.LABELS.index("card")] = 3
    added = [s for _, s in field.added(m)]
    assert {text[a:b] for _, a, b in added} >= {"4111111111111112"} and sum(text[a:b] == wanted[0] for _, a, b in added) == 3
    for run in ("a" * 300_000, "a." * 150_000, "+" * 300_000, "@" * 300_000, "(" * 300_000, "a@" * 100_000, "-." * 150_000 + "1"):
        pii.mentions([(0, run, [])])  # in time


def test_messages_settle_along_a_chain():
    labels = len(pii.LABELS)
    field = pii.SkipChain(np.zeros((pii.FEATURES, labels)), 6.0 * np.eye(labels), np.zeros(2))
    text = "4111111111111111 " + " ".join(f"{k}" for k in range(30))
    m = pii.mentions([(0, text, [("card", 0, 16)])])
    p = field.marginals(m)[:, pii.LABELS.index("card")]
    stay = np.exp(6.0) / (np.exp(6.0) + labels - 1)
    assert np.abs(p[1:] - [1 / labels + (1 - 1 / labels) * ((labels * stay - 1) / (labels - 1)) ** k for k in range(1, 31)]).max() < 0.01


def test_pii_report_and_redaction(spark):
    rows = [*ODD, (20, "mail a.b@c.example now 10.0.0.1 and é +44 20 7946 0958 x 4111 1111 1111 1111"), (21, "300.1.1.1")]
    df = frame(spark, rows).withColumn("n_chars", F.char_length("text").cast("long"))
    field = pii.train(df)
    got = [r for r in pii.report(df, field).collect()]
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    text = dict(rows)[20]
    row = next(r for r in got if r["doc_id"] == 20)
    want = slow_spans(text)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest() and set(",".join(f"{k}:{a}:{b}" for k, a, b in want).split(",")) <= set(row["spans"].split(","))
    clean = next(r for r in pii.redact(df, field).collect() if r["doc_id"] == 20)
    assert clean["text"] == "mail <EMAIL> now <IP> and é <PHONE> x <CARD>" and clean["n_chars"] == len(clean["text"])
    assert pii.report(frame(spark, []), pii.train(frame(spark, []))).count() == 0


# Packing --------------------------------------------------------------------------------------------------------------


def test_packing_is_whole(spark):
    r = random.Random(1)
    rows = [*ODD, *((100 + k, " ".join(r.choice(["alpha,", "BETA.", "gamma's", "1234", "é!?"]) for _ in range(r.randint(0, 1500)))) for k in range(60))]
    got = packing.pack(frame(spark, rows).repartition(3), packing.word_encoder(tokenizer_path())).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_OF_DOCUMENT], np.uint32) for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(ids.tobytes()) and p["doc_tokens"] == len(want[p["doc_id"]])
        pieces[p["doc_id"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    repeats = Counter(i for i, _ in rows)
    for i, found in pieces.items():
        assert sum(n for _, n in found) == repeats[i] * len(want[i])
    padded = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        padded += at if at & (at - 1) == 0 else packing.CAPACITY
    assert padded <= 1.02 * sum(len(want[i]) * n for i, n in repeats.items()) + 3 * packing.CAPACITY
    assert packing.pack(frame(spark, []), packing.word_encoder(tokenizer_path())).count() == 0


def test_cuts():
    for n in (1, 31, 32, 33, 4095, 4096, 4097, 9000):
        assert sum(packing.cut(n)) == n and all(packing.class_of(p) * p <= 4096 for p in packing.cut(n))
    assert packing.power_cuts(4096 + 3000) == [4096, 2048, 512, 256, 128, 32, 16, 8]


def test_bins_hold_as_many_pieces_as_their_class():
    r = random.Random(2)
    packer = packing.Packer(0)
    rows = []
    lengths = [r.choice([1, 20, 31, 90, 400, 900, 1500, 2100, 4000, 4096, 9000]) for _ in range(600)]
    for k, n in enumerate(lengths):
        rows += packer.add(k, np.full(n, k, np.uint32).tobytes())
    early = len({x[5] for x in rows})
    rows += packer.close()
    by = {}
    for row in rows:
        by.setdefault(row[5], []).append(row)
    assert sum(x[2] for x in rows) == sum(lengths) and len(rows) <= 1.6 * len(lengths)
    for number in range(early):  # bins closed in time are full, and hold the pieces of one class but for what tops them up
        length = sum(x[2] for x in by[number])
        assert length == packing.CAPACITY
        k = packing.class_of(by[number][0][2])
        assert len(by[number]) >= k and all(packing.class_of(x[2]) == k for x in by[number][:k])


# Resharding -----------------------------------------------------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    r = random.Random(1)
    for _ in range(100):
        m, n = r.randint(1, 6), r.randint(1, 6)
        sizes = [r.randint(0, 60) for _ in range(m)]
        room = resharding.even_capacities(sum(sizes) + r.randint(0, 4), n)
        flow = resharding.plan_transfers(sizes, room)
        assert [sum(f) for f in flow] == sizes and all(sum(f[j] for f in flow) <= room[j] for j in range(n))
        moved = sum(flow[i][j] for i in range(m) for j in range(n) if i != j)
        assert moved == sum(sizes) - sum(min(sizes[i], room[i]) for i in range(min(m, n)))


def test_reshard(spark, tmp_path):
    rows = [(k, "x" * (k % 90)) for k in range(2000)] + [(k, "copy") for k in range(2000, 3000)] + [(None, None), (5, "dup"), (5, "dup")]
    df = frame(spark, rows).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    out = resharding.reshard(df, F.when(F.col("doc_id") < 1500, 0).otherwise(F.col("doc_id") % 4).cast("int"), 4, 6, size=F.col("size"), order=[F.col("doc_id"), F.col("text")]).persist()
    assert out.count() == len(rows)
    sizes = {r["shard"]: (r["b"], r["n"], r["top"], r["d"]) for r in out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("d")).collect()}
    total = sum(b for b, *_ in sizes.values())
    assert set(sizes) == set(range(6)) and all(top == n - 1 and d == n for _, n, top, d in sizes.values())
    assert all(abs(b - total / 6) < 400 for b, *_ in sizes.values())
    affected = resharding.rewrite(out, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == out.where(F.col("shard").isin(affected)).count()
    assert resharding.reshard(df.limit(0), F.lit(0), 4, 6, size=F.col("size"), order=[F.col("doc_id")]).count() == 0


def test_rewrite_leaves_other_shards_and_clears_emptied_ones(spark, tmp_path):
    path = str(tmp_path / "o")
    before = [(k, f"text {k}", k % 4) for k in range(40)]
    spark.createDataFrame([(k, t, s, k // 4) for k, t, s in before], "doc_id long, text string, shard int, slot long").write.partitionBy("shard").parquet(path)
    kept = sorted((f.name, f.read_bytes()) for f in (tmp_path / "o" / "shard=0").iterdir() if f.suffix == ".parquet")
    old = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    target = F.when(F.col("shard") == 3, 2).when(F.col("doc_id") == 1, 5).otherwise(F.col("shard"))
    assert resharding.rewrite(old.select("doc_id", "text", "slot", F.col("shard").alias("old_shard"), target.alias("shard")), path) == [1, 2, 3, 5]
    assert sorted((f.name, f.read_bytes()) for f in (tmp_path / "o" / "shard=0").iterdir() if f.suffix == ".parquet") == kept
    assert not (tmp_path / "o" / "shard=3").exists()
    got = {(r["doc_id"], r["text"], r["shard"]) for r in spark.read.parquet(path).collect()}
    assert got == {(k, t, 5 if k == 1 else 2 if s == 3 else s) for k, t, s in before}


def test_resharding_query_writes_texts_and_reads_them_back(spark, tmp_path):
    rows = [*((i, t, f"s{k % 7}") for k, (i, t) in enumerate(ODD)), *((100 + k, f"document {k} " * (k % 40), f"s{k % 7}") for k in range(600))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op5_flow_resharding(spark, str(tmp_path))
    raw = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["old_shard"]) for r in out.collect()) == Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t)), zlib.crc32(raw(s)) % 16) for i, t, s in rows)
    shards = {f.rpartition("shard=")[2].partition("/")[0] for f in out.inputFiles() if "shard=" in f}
    assert {str(r["shard"]) for r in out.where("shard <> old_shard").collect()} <= shards
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op5_flow_resharding(spark, str(tmp_path / "none")).count() == 0


# Media ----------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    got = media.describe(media.store(frame(spark, ODD))).collect()
    for r in got:
        texts = {(t or "").encode() for i, t in ODD if i == r["doc_id"]}
        assert r["payload_sha256"] in {hashlib.sha256(media.padded(t)).hexdigest() for t in texts} and r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (4, 8)}) == 1
    assert media.describe(media.store(frame(spark, []))).count() == 0


def test_media_query_stores_images_and_tensors(spark, tmp_path):
    frame(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op6_progressive_jpeg(spark, str(tmp_path))
    folder = out.inputFiles()[0].rpartition("/")[0]
    assert "/tensors-" in folder
    stored = spark.read.parquet(folder).collect()
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD)
    assert all(len(r["rgb"]) == 3 * r["width"] * r["height"] for r in stored)
    made = Counter(media.feature(np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)) for r in stored)
    assert made == Counter(r["feature"] for r in got)
    assert sorted(got, key=repr) == sorted(media.describe(media.store(frame(spark, ODD))).collect(), key=repr)


def test_pixels(spark):
    good = jpeg.encode_payload(bytes(range(256)) * 9)
    df = spark.createDataFrame([(1, good), (2, None), (3, b"nonsense"), (4, good[:-2]), (5, good[:400])], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.pixels(df).collect()}
    assert len(got[1]["rgb"]) == got[1]["width"] * got[1]["height"] * 3
    assert all(got[k]["rgb"] is None for k in (2, 3, 4, 5))


def test_images_repeat_what_payloads_repeat():
    r = np.random.default_rng(3)
    passage = bytes(r.integers(32, 127, 300).tolist())
    payload = b"".join(passage + b"." * k for k in range(1, 60))
    image = jpeg.encode_payload(payload)
    assert len(zlib.compress(image, 9)) < len(payload) / 8
    for size in (0, 1, 19, 20, 21, 251, 252, 253, 315, 378, 379, 378 * 4095 + 1):
        payload = bytes(r.integers(0, 256, size, np.uint8))
        assert jpeg.stored_payload(jpeg.decode(jpeg.encode_payload(payload))) == payload


class Writer:
    """A plain progressive encoder for any coefficients of one component, to test the decoder's symbol-by-symbol paths."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def number(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)


def general_jpeg(blocks, width, height):
    """blocks: [n, 64] zigzag. Codes are 8 bits each: the symbol's number in a table of all that may occur."""
    symbols = bytes([r << 4 | s for r in range(16) for s in range(11) if s or r in range(15) or r == 15])
    table = lambda kind, some: jpeg._segment(0xC4, bytes([kind]) + bytes(len(some) if k == 8 else 0 for k in range(1, 17)) + some)
    code = {s: k for k, s in enumerate(symbols)}
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\x00" + bytes(range(1, 65))), jpeg._segment(0xC2, bytes([8, 0, height, 0, width, 1, 1, 0x11, 0])), table(0, bytes(range(12))), table(0x10, symbols)]

    def scan(ss, se, ah, al, write):
        w = Writer()
        write(w)
        out.extend([jpeg._scan_head([1], ss, se, ah, al), jpeg._coded(np.array(w.bits, np.uint8))])

    def dc(w):
        last = 0
        for b in blocks:
            v = int(b[0]) >> 1
            w.put(abs(v - last).bit_length(), 8)
            if v != last:
                w.number(v - last)
            last = v

    shifted = lambda v, al: (abs(int(v)) >> al) * (1 if v > 0 else -1)

    def first(w):
        for b in blocks:
            zeros, k = 0, 1
            while k < 64:
                v = shifted(b[k], 1)
                if v:
                    while zeros > 15:
                        w.put(code[0xF0], 8)
                        zeros -= 16
                    w.put(code[zeros << 4 | abs(v).bit_length()], 8)
                    w.number(v)
                    zeros = 0
                else:
                    zeros += 1
                k += 1
            if zeros:
                w.put(code[0x00], 8)

    def refine(w):
        for b in blocks:
            pending, zeros, k = [], 0, 1
            last = max((k for k in range(1, 64) if abs(int(b[k])) == 1), default=0)
            while k < 64:
                if k > last:
                    w.put(code[0x00], 8)
                    for bit in pending:
                        w.put(bit, 1)
                    for j in range(k, 64):
                        if abs(int(b[j])) > 1:
                            w.put(abs(int(b[j])) & 1, 1)
                    pending = []
                    break
                v = int(b[k])
                if abs(v) > 1:
                    pending.append(abs(v) & 1)
                elif v == 0:
                    zeros += 1
                    if zeros == 16:
                        w.put(code[0xF0], 8)
                        for bit in pending:
                            w.put(bit, 1)
                        pending, zeros = [], 0
                else:
                    w.put(code[zeros << 4 | 1], 8)
                    w.put(int(v > 0), 1)
                    for bit in pending:
                        w.put(bit, 1)
                    pending, zeros = [], 0
                k += 1

    scan(0, 0, 0, 1, dc)
    scan(1, 63, 0, 1, first)
    scan(0, 0, 1, 0, lambda w: [w.put(int(b[0]) & 1, 1) for b in blocks])
    scan(1, 63, 1, 0, refine)
    return b"".join(out) + b"\xff\xd9"


def test_general_progressive_scans():
    r = np.random.default_rng(7)
    blocks = np.where(r.random((12, 64)) < 0.25, r.integers(-60, 61, (12, 64)), 0)
    blocks[r.random((12, 64)) < 0.1] = 1
    blocks[3, 1:] = 0
    blocks[:, 0] = r.integers(-200, 200, 12)
    image = jpeg.decode(general_jpeg(blocks, 32, 24))
    assert (image.components[0].coefficients.reshape(-1, 64) == blocks).all()
    scaled = blocks * np.arange(1, 65)
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    flat = np.zeros(64)
    flat[jpeg.ZIGZAG] = scaled[0]
    assert np.abs(c.T @ flat.reshape(8, 8) @ c + 128 - image.planes()[0][:8, :8]).max() < 0.05
    assert image.rgb().shape == (24, 32, 3)


# WARC -----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    body = "<p>\r\n\r\nWARC/1.1\r\n</p>" * 9
    rows = [(3, "http://a/", body), (1, "http://b/\r\nx", body), (2, None, body), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", body), (7, "u", "é漢" * 40), (7, "u", "é漢" * 40), (8, "u", "é漢" * 40), (9, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages).collect()), key=repr)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and h in first and i > first[h]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_archive_parser():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"HTTP/1.1 200\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    assert list(warc.parse_archive(b"")) == []


# Language -------------------------------------------------------------------------------------------------------------


def slow_bits(samples, text):
    """Code length by dictionaries, method C."""
    counts = [defaultdict(Counter) for _ in range(4)]
    joined = b"\n\n\n" + b"\n\n\n".join(samples)
    for k in range(3, len(joined)):
        for order in range(4):
            counts[order][joined[k - order : k]][joined[k]] += 1
    whole, total = b"\n\n\n" + text, 0.0
    for k in range(3, len(whole)):
        order, p = 3, 1.0
        while order >= 0:
            seen = counts[order].get(whole[k - order : k])
            if seen:
                n, d = sum(seen.values()), len(seen)
                if seen[whole[k]]:
                    p *= seen[whole[k]] / (n + d)
                    break
                p *= d / (n + d)
            order -= 1
        if order < 0:
            p /= 256
        total -= np.log2(p)
    return total


def test_code_lengths_equal_plain_counting():
    samples = {"aa": [b"abracadabra abra", b"cad abra"], "bb": [b"simsalabim sim", b"bim"]}
    model = language_id.PPM.fit(samples)
    texts = [b"abra", b"sim abra zz", b"", b"\xff\x00q", b"bimbam" * 5]
    want = [[slow_bits(samples[x], t) if t else 0.0 for x in ("aa", "bb")] for t in texts]
    assert np.allclose(model.bits(texts), want, rtol=1e-4, atol=1e-3)


def test_language_identification(spark):
    r = random.Random(3)
    words = {"aa": ["lorem", "dolor", "amet"], "bb": ["quick", "brown", "jumps"]}
    rows = [(k, " ".join(r.choice(words[x]) for _ in range(20)), x, "s", "h", 1) for k in range(200) for x in [("aa", "bb")[k % 2]]]
    got = language_id.identify_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(g["lang_pred"] == g["lang"] and 0.5 < g["score"] <= 1 for g in got)
    odd = language_id.identify_documents(spark.createDataFrame([*rows, *((1000 + k, t, None, None, None, None) for k, (_, t) in enumerate(ODD))], SCHEMA)).where("doc_id >= 1000").collect()
    assert {g["doc_id"]: g["lang_pred"] == "und" for g in odd} == {1000 + k: not re.search(r"[^\W\d_]", t or "") for k, (_, t) in enumerate(ODD)}
    none = language_id.identify_documents(frame(spark, [(1, "abc")]).withColumn("lang", F.lit(None).cast("string"))).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert language_id.identify_documents(frame(spark, [])).count() == 0


# Clashing columns -----------------------------------------------------------------------------------------------------


def test_work_columns_never_clash(spark):
    from lodestone.llm import mixing

    docs = frame(spark, [(1, "a b c"), (2, "d e")]).withColumn("source", F.lit("s"))
    for name in ("_source", "_block", "_tokens", "_uses", "_first", "_size", "_at", "_rank", "other 0"):
        own = docs.withColumn(name, F.concat(F.lit("own "), F.col("text")))
        mixed = mixing.mix(own, F.length("text"), repetition_limit=2.0)
        assert {r[name] for r in mixed.collect()} == {"own a b c", "own d e"}
        pages = own.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), name)
        assert {r[name] for r in warc.resolve_revisits(pages).collect()} == {"own a b c", "own d e"}
        moved = resharding.reshard(own, F.lit(0), 2, 2, size=F.length("text"), order=[F.col("doc_id")])
        assert {r[name] for r in moved.collect()} == {"own a b c", "own d e"} and moved.columns == [*own.columns, "old_shard", "shard", "slot"]


def test_large_groups_are_joined_as_small_ones_are(spark, monkeypatch):
    """All branches for long groups, several blocks and slices, and candidates in turn."""
    for name, value in (("HELD", 12), ("FEW", 2), ("BLOCK", 4), ("CHUNK", 3), ("SLICE", 3), ("HUBS", 1), ("RANKS", (1, float("inf"))), ("SALT", 2), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for k in range(70):  # one large group, similarities around the threshold
        words = list(base)
        for _ in range(r.randint(2, 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((k, " ".join(words)))
    for k in range(20):
        rows.append((100 + k, " ".join(base[:80] + [r.choice(vocabulary) for _ in range(40)])))
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(x) for x in got) == sorted(linked(rows))


def test_repeated_ids_go_by_their_own_texts(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(7, texts[0]), (7, texts[1]), (8, texts[1]), (9, texts[2])]
    got = jaccard_join.near_duplicate_rows(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(7, 7), (7, 7), (8, 7), (9, 9)]
    assert len({r["component"] for r in got}) == 3


@pytest.mark.parametrize("name", ["op1_recompression_dedup", "op8_jaccard_join", "op9_warc_revisits"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(repr(r) for r in found.fetchall())
