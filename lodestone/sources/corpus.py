"""Adapters: Parquet tables as indexed documents and blocks."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import is_blank, norm
from lodestone.operators.candidates import postings
from lodestone.sources.tables import modified, shared_dir, spread, stored

#: Where a source line begins.
LINE_END = r"\r\n|\n|\r"
EXTENSIONS = (".txt", ".adoc", ".java", ".sql", ".js", ".xml")
ROOT = "/corpus"
FIRST_CHANGE_MS = 1_700_000_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_blocks(texts: DataFrame, ident: str = "document_id", text: str = "text") -> DataFrame:
    """One block for each line that isn't blank; ordinal is the line's number from 0, so blank lines leave gaps. Null texts have no blocks."""
    lines = texts.select(F.col(ident).alias("document_id"), F.posexplode(F.split(F.col(text), LINE_END, -1)).alias("ordinal", "content"))
    lines = lines.where(~is_blank(F.col("content")))
    return lines.select("document_id", "ordinal", F.lit(None).cast("string").alias("heading"), "content", F.lit("line").alias("location_kind"), F.format_string("第 %d 行", F.col("ordinal") + 1).alias("location_value"))


def with_norms(blocks: DataFrame) -> DataFrame:
    """Blocks with norm_heading and norm_content, which searches read instead of working them out."""
    return blocks.withColumns({"norm_heading": norm(F.col("heading")), "norm_content": norm(F.col("content"))})


def corpus_documents(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """The table ``documents`` as indexed files of one root, with further columns of the table."""
    docs = table(spark, folder, "documents")
    ext = F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (F.pmod(F.col("doc_id"), F.lit(len(EXTENSIONS))) + 1).cast("int"))
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("lang"), ext)
    return docs.select(
        (F.col("doc_id") + 1).alias("id"),
        F.lit(ROOT).alias("root_path"),
        F.concat_ws("/", F.lit(ROOT), F.col("lang"), F.col("source"), name).alias("path"),
        name.alias("filename"),
        ext.alias("extension"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.lit(FIRST_CHANGE_MS) + F.col("doc_id") * 1000).cast("double").alias("modified_at_ms"),
        F.lit("indexed").alias("status"),
        F.lower(name).alias("norm_filename"),
        *more,
    )


class Indexed(NamedTuple):
    """An indexed corpus: normalised once, blocks sorted by document, postings by gram within each file."""

    documents: DataFrame
    blocks: DataFrame
    postings: DataFrame


def build(spark: SparkSession, folder: str) -> Indexed:
    """Writes documents, blocks and postings of the table ``documents`` to the shared folder."""
    path = f"{shared_dir(spark)}/lodestone/index-{uuid.uuid4().hex}"
    documents = stored(corpus_documents(spark, folder), "documents", f"{path}/documents")
    blocks = stored(corpus_blocks(spark, folder).sortWithinPartitions("document_id", "ordinal"), "blocks", f"{path}/blocks")
    posted = stored(postings(blocks).sortWithinPartitions("gram"), "postings", f"{path}/postings")
    return Indexed(documents, blocks, posted)


def indexed(spark: SparkSession, folder: str, anew: bool = False) -> Indexed:
    """The index of a folder, built at its first use in a session, again if the table has changed since, and whenever asked for anew."""
    known = spark.sparkContext.__dict__.setdefault("_lodestone_indexes", {})
    key = folder, modified(spark, f"{folder}/documents.parquet")
    if anew or key not in known:
        known[key] = build(spark, folder)
    return known[key]


def corpus_blocks(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select((F.col("doc_id") + 1).alias("document_id"), "text"), "document_id")
    return line_blocks(docs).withColumns({"norm_heading": F.lit(None).cast("string"), "norm_content": norm(F.col("content"))})  # lines have no headings


def conversation_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each conversation."""
    ids = table(spark, folder, "conversations").select("conv_id").distinct()
    name = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".md"))
    return ids.select(
        (F.col("conv_id") + 1).cast("long").alias("id"),
        F.lit("/conversations").alias("root_path"),
        F.concat(F.lit("/conversations/"), name).alias("path"),
        name.alias("filename"),
        F.lit(".md").alias("extension"),
        (F.lit(FIRST_CHANGE_MS) + F.col("conv_id") * 1000).cast("double").alias("modified_at_ms"),
        F.lit("indexed").alias("status"),
        name.alias("norm_filename"),
    )


def conversation_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One block for each turn, under its role as heading."""
    turns = table(spark, folder, "conversations")
    return with_norms(turns.select((F.col("conv_id") + 1).cast("long").alias("document_id"), F.col("turn").cast("int").alias("ordinal"), F.col("role").alias("heading"), F.col("text").alias("content"), F.lit("section").alias("location_kind"), F.col("turn").cast("string").alias("location_value")))
