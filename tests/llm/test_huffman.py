"""Huffman codes against plain ones, and the files' round trip against the tokenizer."""

import heapq
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import huffman
from lodestone.llm.common import scratch
from lodestone.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", " a", "a ", "\n", "a\n b", "a \nb", "don't we'll x's", "1.5 2² ½", "é à, ü. ß", "x\0y", "x\1, y", "漢字 a", "a<|endoftext|>b", "<|ENDOFTEXT|> a", "\xa0 a\xa0b", "a\x85b", "\x1c a\x1c b", "ª º µ ×÷ a-b_c", "foo.\nBar, baz.", "!, x", ", a", ". ", "a. \nb", "a\xadb \xad c", "naïve café's", "🧪 ok"]


def plain_cost(counts):
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("n", [2, 3, 7, 40, 300])
def test_lengths_are_optimal_and_limited(n):
    counts = np.random.default_rng(n).integers(1, 10_000, n) ** 2
    free = huffman.code_lengths(counts, 40)
    assert (counts * free).sum() == plain_cost(counts.tolist()) and sum(2.0 ** -free.astype(float)) == 1
    tight = huffman.code_lengths(counts, int(np.ceil(np.log2(n))))
    assert tight.max() <= np.ceil(np.log2(n)) and sum(2.0 ** -tight.astype(float)) <= 1
    fibonacci = [1, 1]
    while len(fibonacci) < 24:
        fibonacci.append(sum(fibonacci[-2:]))
    lengths = huffman.code_lengths(np.array(fibonacci), 8)
    assert lengths.max() == 8 and sum(2.0 ** -lengths.astype(float)) == 1


def test_limited_codes_cost_the_least():
    """Against all length vectors of a small alphabet."""
    counts, limit = np.array([1, 1, 2, 9, 40]), 3
    every = [x for x in np.ndindex(*[limit] * 5) if sum(2.0 ** -(k + 1) for k in x) <= 1]
    least = min(sum(c * (k + 1) for c, k in zip(counts, x)) for x in every)
    assert (counts * huffman.code_lengths(counts, limit)).sum() == least
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0] and huffman.code_lengths(np.zeros(4, int)).tolist() == [0] * 4
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("step", [1, 5, 128])
def test_blocks_come_back(step):
    r = np.random.default_rng(step)
    counts = (r.pareto(0.6, 5000) * 10).astype(np.int64)
    lengths = huffman.code_lengths(counts)
    codes, table = huffman.canonical(lengths), huffman.decoding_table(lengths)
    used = np.flatnonzero(counts)
    for n in (0, 1, step, step + 1, 3000):
        ids = r.choice(used, n).astype(np.uint16)
        bits, checkpoints = huffman.encode_block(ids, codes, lengths, step)
        assert (huffman.decode_block(bits, checkpoints, n, table, step=step) == ids).all() and len(bits) == (int(lengths[ids].sum()) + 7) // 8


def test_pieces_are_what_the_tokenizer_gives():
    encoder = huffman.ByteIds(PATH, cache_words=50)
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("ab é,.'\n\t 1²sll\xa0\x85-_!\x1c\0") for _ in range(r.randint(1, 14))) for _ in range(3000)] + ["".join(r.choice("ab é,. \n! ") for _ in range(r.randint(1, 14))) for _ in range(3000)]
    for text, ids in zip([None, *texts], encoder.batch([None, *texts])):
        assert np.frombuffer(ids, np.uint16).tolist() == ([] if text is None else encoder.tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 300)  # many blocks to a page, many pages to a file
    monkeypatch.setattr(huffman, "PAGE", 700)
    rows = [(k * 3, t, "x", 1) for k, t in enumerate(ODD)] + [(1, None, "x", 1), (1, None, "x", 1), (None, "null id", "x", 1), (5000, "long text, " * 20_000, "x", 1), (5000, "another", "x", 1)]
    rows += [(k + 9000, f"text number {k} of many" * (k % 5), "x", 1) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, range int").repartition(5)
    got = huffman.round_trip(df, huffman.byte_encoder(PATH)).collect()
    tokenizer = huffman.ByteIds(PATH).tokenizer
    of = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(of(t)), zlib.crc32(np.array(of(t), "<u4").tobytes())) for i, t, *_ in rows)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == (np.cumsum([0] + [r["n_tokens"] for r in got])[:-1]).tolist()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert huffman.round_trip(df.limit(0), huffman.byte_encoder(PATH)).count() == 0


def test_a_page_stands_alone(spark):
    path = scratch(spark, "ids")
    huffman.archive_ids(spark.createDataFrame([(k, "alpha beta " * k) for k in range(50)], "doc_id long, text string"), huffman.byte_encoder(PATH), path)
    pages = spark.read.parquet(f"{path}/pages")
    table = huffman.decoding_table(np.frombuffer(spark.read.parquet(f"{path}/codes").first()[0], np.uint8))
    page = pages.orderBy("range", "first").collect()[-1]
    block = page["blocks"][-1]
    ids = huffman.decode_block(bytes(block["bits"]), np.frombuffer(block["checkpoints"], np.uint32), block["n"], table)
    assert len(ids) == block["n"] and ids[-1] == huffman.END_OF_DOCUMENT and huffman.described(spark, path).count() == 50
