"""Matching passages of documents: one candidate a block, chosen to cover the terms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import query_terms

DEFAULT_PASSAGES, MOST_PASSAGES = 3, 10


def running_headings(blocks: DataFrame, ident: str, ordinal: str, heading: str) -> DataFrame:
    """blocks with heading, the last own one so far, and section, how many there have been."""
    so_far = Window.partitionBy(ident).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumns({"section": F.count(heading).over(so_far), "heading": F.last(heading, True).over(so_far)})


def passage_candidates(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """Blocks that hold a term: rank 2 by their heading, else 1 by their content, and which terms (array of 0/1)."""
    heading, content = F.coalesce("norm_heading", F.lit("")), F.coalesce("norm_content", F.lit(""))
    in_heading, in_content = ([F.contains(c, F.lit(t)).cast("int") for t in terms] for c in (heading, content))
    by_heading = reduce(lambda a, b: a + b, in_heading) > 0
    rows = blocks.withColumns({"rank": F.when(by_heading, 2).otherwise(1), "hits": F.when(by_heading, F.array(*in_heading)).otherwise(F.array(*in_content))})
    return rows.where(F.exists("hits", lambda h: h > 0))


def phrase_passages(blocks: DataFrame, raw_query: str, limit: int = DEFAULT_PASSAGES) -> DataFrame:
    """The first passages of each document for a phrase: headings first, then by ordinal, with passage_no from 1."""
    rows = passage_candidates(blocks, query_terms(raw_query)[1])
    order = Window.partitionBy("document_id").orderBy(F.desc("rank"), "ordinal")
    return rows.withColumn("passage_no", F.row_number().over(order)).where(F.col("passage_no") <= limit).drop("hits")


def greedy(rows: list[tuple[int, int, list[int]]], terms: int, limit: int) -> list[int]:
    """Numbers of the chosen rows (ordinal, rank, hits): each time the one that covers most new terms, then most terms, then the best rank, then the first."""
    left, covered, chosen = list(range(len(rows))), [False] * terms, []
    while left and len(chosen) < limit:

        def worth(k: int) -> tuple:
            ordinal, rank, hits = rows[k]
            return sum(1 for h, c in zip(hits, covered) if h and not c), sum(hits), rank, -ordinal

        best = max(left, key=worth)
        left.remove(best)
        chosen.append(best)
        covered = [c or bool(h) for c, h in zip(covered, rows[best][2])]
    return chosen


def all_terms_passages(documents: DataFrame, blocks: DataFrame, raw_query: str, limit: int = DEFAULT_PASSAGES) -> DataFrame:
    """(document_id, passage_no, ordinal, rank, matched, terms) for each document in which every term occurs in the filename, a heading or a content.

    Of the candidates of a document only the first ``limit`` of each set of hit terms and rank can ever be chosen, so only these are gathered: at most
    limit * 2**(terms + 1) of them, however many blocks the document has.
    """
    query, terms = query_terms(raw_query, True)
    rows = passage_candidates(blocks, terms)
    seen = rows.groupBy("document_id").agg(*(F.max(F.contains(F.coalesce("norm_heading", F.lit("")), F.lit(t)) | F.contains(F.coalesce("norm_content", F.lit("")), F.lit(t))).alias(f"t{k}") for k, t in enumerate(terms)))
    whole = seen.join(documents.select(F.col("id").alias("document_id"), "norm_filename"), "document_id")
    for k, t in enumerate(terms):
        whole = whole.where(F.col(f"t{k}") | F.contains("norm_filename", F.lit(t)))
    alike = Window.partitionBy("document_id", "rank", "hits").orderBy("ordinal")
    few = rows.join(whole.select("document_id"), "document_id", "left_semi").withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= limit)
    gathered = few.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "rank", "hits"))).alias("found"))
    schema = pa.schema([("document_id", pa.int64()), ("passage_no", pa.int32()), ("ordinal", pa.int32()), ("rank", pa.int32()), ("matched", pa.int32()), ("terms", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                as_rows = [(f["ordinal"], f["rank"], f["hits"]) for f in found]
                for number, k in enumerate(greedy(as_rows, len(terms), limit), 1):
                    out.append((ident, number, as_rows[k][0], as_rows[k][1], sum(as_rows[k][2]), len(terms)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return gathered.select(F.col("document_id").cast("long"), "found").mapInArrow(run, "document_id long, passage_no int, ordinal int, rank int, matched int, terms int")


def within_budget(rows: DataFrame, by: str, order: str, text: str, limit: int) -> DataFrame:
    """Of each group the first rows whose texts take ``limit`` UTF-8 bytes at most together, with used, the bytes up to each."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.octet_length(F.coalesce(text, F.lit("")))).over(so_far)).where(F.col("used") <= limit)
