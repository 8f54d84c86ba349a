"""Payloads and their sketches: a second, smaller index beside the postings.

A document's blocks are gathered, in order, into payloads of bounded size. Documents and payloads have a sketch of 8,192 bits, two for each trigram, so a search can pass over
documents that can't match and read only those payloads of the others that may hold a trigram of the query. What is read is always checked exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a payload, bits of a sketch, seeds and multiplier of its hashes.
PAYLOAD_BYTES, SKETCH_BITS = 64 * 1024, 8192
SEEDS, MULTIPLIER = (0x811C9DC5, 0x9E3779B9), 0x01000193
GRAM = 3
#: Characters and rows whose sketches are made together.
LOT, LOT_ROWS = 1 << 20, 500
_PAYLOAD = "document_id long, payload int, bytes long, first int, last int, sketch array<long>"

_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]


def gram_bits(points: np.ndarray) -> np.ndarray:
    """The bits of all trigrams of a text's code points, twice as many as there are trigrams."""
    points = points.astype(np.uint32)
    out = []
    for seed in SEEDS:
        h = np.full(max(0, len(points) - GRAM + 1), seed, np.uint32)
        for k in range(GRAM):
            h = (h ^ points[k : len(points) - GRAM + 1 + k]) * np.uint32(MULTIPLIER)
        out.append(h % np.uint32(SKETCH_BITS))
    return np.concatenate(out)


def term_bits(term: str) -> list[list[int]]:
    """For each trigram of a normalised term, its bits; none if the term is too short to tell anything."""
    bits = gram_bits(np.array([ord(c) for c in term], np.uint32)).reshape(len(SEEDS), -1)
    return [sorted(set(pair)) for pair in bits.T.tolist()]


class _Sketches:
    """Sketches of rows that come one after the other: texts are gathered and hashed together, LOT characters at a time. Trigrams never reach over a text's end."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.texts: list[str] = []
        self.owners: list[int] = []
        self.size = 0
        self.first: np.ndarray | None = None  # the bits of the first row, from the lot before

    def row(self, *values: object) -> None:
        self.rows.append(values)

    def text(self, text: str) -> None:
        """A text of the last row."""
        self.texts.append(text), self.owners.append(len(self.rows) - 1)
        self.size += len(text)

    def full(self) -> bool:
        return self.size >= LOT or len(self.rows) > LOT_ROWS

    def take(self, end: bool = False) -> tuple[list[tuple], pa.ListArray]:
        """The rows and their sketches; the last row stays, as it may get more texts, unless this is the end."""
        bits = np.zeros((len(self.rows), SKETCH_BITS), bool)
        points = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(x) for x in self.texts], np.int64)
        inside = np.ones(len(points), bool)
        ends = np.cumsum(lengths)
        for k in range(1, GRAM):
            inside[ends[lengths >= k] - k] = False
        at = np.flatnonzero(inside)
        if len(at):
            owner = np.repeat(np.array(self.owners, np.int64), lengths)[at] * SKETCH_BITS
            for found in gram_bits(points).reshape(len(SEEDS), -1):
                bits.reshape(-1)[owner + found[at]] = True
        if self.first is not None:
            bits[0] |= self.first
        n = len(self.rows) if end else len(self.rows) - 1
        rows, self.rows = self.rows[:n], self.rows[n:]
        self.first = None if end else bits[n]
        self.texts, self.owners, self.size = [], [], 0
        words = np.packbits(bits[:n], axis=1, bitorder="little").view(np.int64)
        return rows, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(words.reshape(-1)))


def payloads(blocks: DataFrame, size: int = PAYLOAD_BYTES) -> DataFrame:
    """(document_id, payload, bytes, first, last, sketch) of blocks (document_id, ordinal, norm_content): a document's contents in order, as many as fit ``size`` bytes of UTF-8; contents of more
    than ``size`` characters come in pieces. first and last are the ordinals that a payload reaches from and to. Blocks stream past in order, so a task holds one payload. Null contents are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Sketches()
        document, number, held, first, last, block, tail = None, 0, None, 0, 0, None, ""

        def table(end: bool = False) -> pa.RecordBatch:
            if made.rows:  # what is known of the last payload by now
                made.rows[-1] = (document, number, held, first, last)
            rows, found = made.take(end)
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)] + [found], names=[x.split()[0] for x in _PAYLOAD.split(", ")])

        for batch in batches:
            for ident, ordinal, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                for at in range(0, max(1, len(text)), size):
                    piece = text[at : at + size]
                    n = len(piece.encode("utf-8", "surrogatepass"))
                    if held is None or ident != document or held + n > size:
                        if held is not None:
                            made.rows[-1] = (document, number, held, first, last)
                        number = 0 if ident != document else number + 1
                        document, held, first, block, tail = ident, 0, ordinal, None, ""
                        made.row()
                    joined = tail + piece if block == ordinal else piece  # pieces of a block that lie together
                    made.text(joined)
                    held, last, block, tail = held + n, ordinal, ordinal, joined[-(GRAM - 1) :]
                    if made.full():
                        yield table()
        if made.rows:
            yield table(True)

    ordered = blocks.select(F.col("document_id").cast("long"), F.col("ordinal").cast("int"), "norm_content").repartition("document_id").sortWithinPartitions("document_id", "ordinal")
    return ordered.mapInArrow(run, _PAYLOAD)


def document_sketches(blocks: DataFrame) -> DataFrame:
    """(document_id, sketch) over headings and contents. Blocks are dealt by document and stream past in its order, so texts are shuffled once and sketches never."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Sketches()

        def table(end: bool = False) -> pa.RecordBatch:
            rows, found = made.take(end)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), found], names=["document_id", "sketch"])

        for batch in batches:
            for ident, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                if not made.rows or made.rows[-1][0] != ident:
                    made.row(ident)
                for text in texts:
                    for at in range(0, len(text or ""), PAYLOAD_BYTES):
                        made.text(text[at : at + PAYLOAD_BYTES + GRAM - 1])
                        if made.full():
                            yield table()
        if made.rows:
            yield table(True)

    texts = blocks.select(F.col("document_id").cast("long"), "norm_heading", "norm_content").repartition("document_id").sortWithinPartitions("document_id")
    return texts.mapInArrow(run, "document_id long, sketch array<long>")


def bits_set(sketch: Column) -> Column:
    return F.aggregate(sketch, F.lit(0), lambda n, word: n + F.bit_count(word)).cast("long")


def _has(sketch: Column, bits: list[int]) -> Column:
    return reduce(lambda a, b: a & b, (F.getbit(F.get(sketch, F.lit(b // 64)), F.lit(b % 64)) == 1 for b in bits))


def may_contain(sketch: Column, term: str) -> Column:
    """Whether a text with this sketch may contain the term: it has the bits of all its trigrams. Terms that are too short may be anywhere."""
    grams = term_bits(term)
    return reduce(lambda a, b: a & b, (_has(sketch, bits) for bits in grams)) if grams else F.lit(True)


def may_contain_any(sketch: Column, terms: list[str]) -> Column:
    """Whether a payload is worth reading: it may hold a trigram of a term. All of them can't be asked for, as a hit may reach over a payload's end."""
    found = [_has(sketch, bits) for term in terms for bits in term_bits(term)]
    short = any(not term_bits(term) for term in terms)
    return F.lit(True) if short or not found else reduce(lambda a, b: a | b, found)


def reads(documents: DataFrame, sketches: DataFrame, held: DataFrame, terms: list[str], all_terms: bool = False) -> DataFrame:
    """(id, payload, first, last) of the payloads that a search has to read, of documents (id).

    A document without a sketch may match; one with a sketch has to hold the phrase, or at least one of the terms. Of its payloads those are read that may hold a trigram, or all if
    none does, as the trigram may lie over an end. Documents without payloads come with a null payload: all their blocks are read.
    """
    looked = terms if all_terms else terms[:1]
    possible = reduce(lambda a, b: a | b, (may_contain(F.col("sketch"), t) for t in looked)) if looked else F.lit(True)
    known = sketches.select(F.col("document_id").alias("id"), possible.alias("_possible"))
    some = documents.select("id").join(known, "id", "left").where(F.coalesce("_possible", F.lit(True))).select("id")
    marked = held.select(F.col("document_id").alias("id"), "payload", "first", "last", may_contain_any(F.col("sketch"), looked).alias("_worth"))
    found = some.join(marked, "id", "left")
    any_worth = found.groupBy("id").agg(F.max("_worth").alias("_any"))
    return found.join(any_worth, "id").where(F.coalesce("_worth", F.lit(False)) | ~F.coalesce("_any", F.lit(False))).select("id", "payload", "first", "last")


def blocks_to_read(blocks: DataFrame, read: DataFrame) -> DataFrame:
    """The blocks that lie in the payloads of reads(), each once."""
    spans = read.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("_spans"), F.max(F.col("payload").isNull()).alias("_all"))
    joined = blocks.join(spans, blocks["document_id"] == spans["id"])
    inside = F.exists("_spans", lambda s: F.col("ordinal").between(s["first"], s["last"]))
    return joined.where(F.col("_all") | inside).select(*(blocks[c] for c in blocks.columns))
