"""Candidate pruning by trigrams: a superset of the documents whose blocks can match. Exact predicates always run after it.

Postings are worked out once, when blocks are written, and each file of them lies sorted by gram, so a query reads the pages of its own grams only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import query_terms

GRAM, BITS = 3, 21
#: Characters of blocks that a task takes together.
TOGETHER = 1 << 20


def gram_code(gram: str) -> int:
    """A gram as one number: the code points of its characters, BITS bits each."""
    return sum(ord(c) << BITS * (GRAM - 1 - k) for k, c in enumerate(gram))


def gram_text(code: Column) -> Column:
    """The gram that a number stands for."""

    @F.pandas_udf("string")
    def text(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: "".join(chr(c >> BITS * (GRAM - 1 - k) & (1 << BITS) - 1) for k in range(GRAM)))

    return text(code)


def _grams(ids: np.ndarray, lengths: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, document), each once and by gram, of texts laid end to end as code points, ``lengths`` each; grams never reach over a border."""
    inside = np.ones(len(points), bool)
    ends = np.cumsum(lengths)
    for k in range(1, GRAM):
        inside[ends[lengths >= k] - k] = False
    at = np.flatnonzero(inside)
    known, rank = np.unique(ids, return_inverse=True)
    document = np.repeat(rank, lengths)[at]
    # one number for gram and document sorts much faster than two; few texts have characters or documents too many for that
    width, low = int(points.max(initial=0)).bit_length(), len(known).bit_length()
    if GRAM * width + low < 63:
        pairs = np.unique(_codes(points, at, width) << low | document)
        codes, document = pairs >> low, pairs & (1 << low) - 1
        codes = sum((codes >> width * k & (1 << width) - 1) << BITS * k for k in range(GRAM))
        return codes, known[document]
    codes = _codes(points, at, BITS)
    order = np.lexsort((document, codes))
    codes, document = codes[order], document[order]
    fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (document[1:] != document[:-1])]) if len(codes) else np.zeros(0, bool)
    return codes[fresh], known[document[fresh]]


def _codes(points: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The grams that begin at ``at``, ``bits`` bits a character."""
    return sum(points[at + k] << bits * (GRAM - 1 - k) for k in range(GRAM))


def text_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, code points) of a text column, laid end to end; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = (column.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[offsets[0] : offsets[-1]]
    if data.isascii():
        return np.diff(offsets), np.frombuffer(data, np.uint8).astype(np.int64)
    return pc.utf8_length(column).to_numpy().astype(np.int64), np.frombuffer(data.decode().encode("utf-32-le"), np.uint32).astype(np.int64)


def postings(blocks: DataFrame) -> DataFrame:
    """(gram, document_id), each once: of contents and headings (norm_heading, norm_content), never across their border.

    Blocks are dealt by document and stream past in its order, so only texts are shuffled, never the postings, which are many times as large. A document that goes on in the next
    lot leaves its grams behind, and those aren't given again.
    """
    texts = blocks.select(F.col("document_id").cast("long"), "norm_heading", "norm_content")
    return document_postings(texts.repartition("document_id"))


def document_postings(texts: DataFrame) -> DataFrame:
    """postings() of (document_id, norm_heading, norm_content) in partitions that hold whole documents; they stay in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, last, had = 0, None, np.zeros(0, np.int64)

        def table() -> pa.RecordBatch:
            nonlocal last, had
            ids = np.concatenate([x[0] for x in lot])
            codes, document = _grams(ids, *(np.concatenate([x[k] for x in lot]) for k in (1, 2)))
            end = ids.max()
            mine = codes[document == end]
            if last is not None and document.size:
                fresh = np.ones(len(codes), bool)
                again = np.flatnonzero(document == last)
                fresh[again] = ~np.isin(codes[again], had)
                codes, document = codes[fresh], document[fresh]
            last, had = end, np.union1d(had, mine) if end == last else mine
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(document)], names=["gram", "document_id"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for column in (1, 2):
                lengths, points = text_points(batch.column(column))
                if len(points):
                    lot.append((ids, lengths, points))
                    size += len(points)
            if size >= TOGETHER:
                yield table()
                lot, size = [], 0
        if lot:
            yield table()

    return texts.sortWithinPartitions("document_id").mapInArrow(run, "gram long, document_id long")


def query_grams(term: str) -> list[int]:
    return sorted({gram_code(term[k : k + GRAM]) for k in range(len(term) - GRAM + 1)})


def term_candidates(posted: DataFrame, term: str) -> DataFrame | None:
    """document_id of those that have all grams of a term; None if the term is too short to tell."""
    wanted = query_grams(term)
    if not wanted:
        return None
    hits = posted.where(F.col("gram").isin(*wanted))
    return hits.groupBy("document_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("document_id")


def candidates(posted: DataFrame, raw_query: str, documents: DataFrame | None = None) -> DataFrame | None:
    """document_id of a superset of the matches, or None if nothing can be pruned.

    For a search of all terms, every long term prunes on its own; a term may also be found in the filename, so documents (id, norm_filename) whose
    name holds it stay.
    """
    found = []
    terms = query_terms(raw_query, documents is not None)[1]
    for term in terms:
        one = term_candidates(posted, term)
        if one is not None and documents is not None:
            one = one.union(documents.where(F.contains("norm_filename", F.lit(term))).select(F.col("id").alias("document_id"))).distinct()
        if one is not None:
            found.append(one)
    return reduce(lambda a, b: a.join(b, "document_id", "left_semi"), found) if found else None


def without_postings(documents: DataFrame, posted: DataFrame) -> DataFrame:
    """Documents (id) that no posting names: those with too little text, or those that an interrupted upgrade has left out."""
    return documents.join(posted.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")


def may_contain_any(posted: DataFrame, terms: list[str]) -> DataFrame | None:
    """document_id of those that may hold at least one of the terms; None if a term is too short to tell."""
    found = [term_candidates(posted, t) for t in terms]
    return None if any(f is None for f in found) else reduce(DataFrame.union, found).distinct()
