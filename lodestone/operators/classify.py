"""Incremental indexing: why a file is processed again, what is done, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.schema import TEXT_EXTENSIONS, TEXT_PARSE_VERSION

#: Extensions that have a parser.
SUPPORTED_EXTENSIONS = (".txt", ".adoc", ".java", ".sql", ".js", ".xml", ".md", ".csv", ".html", ".htm", ".xhtml", ".mht", ".mhtml", ".docx", ".pptx", ".xlsx", ".xlsm", ".odt", ".pdf", ".rtf", ".doc", ".xls", ".msg")


def needs_text_upgrade(extension: Column, status: Column, version: Column) -> Column:
    """Whether a text file was parsed by an older version; files that were too large weren't parsed."""
    return extension.isin(*TEXT_EXTENSIONS) & (status != "too_large") & (F.coalesce(version, F.lit(0)) < TEXT_PARSE_VERSION)


def reason(rebuild: bool = False) -> Column:
    """The first reason that applies, on rows of compare(): the listing's columns, and the previous row's with the prefix ``old_``."""
    old = lambda c: F.col(f"old_{c}")
    return (
        F.when(F.lit(rebuild), "rebuild")
        .when(old("status").isNull(), "added")
        .when((F.col("size_bytes") != old("size_bytes")) | (F.col("modified_at_ms") != old("modified_at_ms")), "source-changed")
        .when(old("status") == "error", "error-retry")
        .when(needs_text_upgrade(F.col("extension"), old("status"), old("parse_version")), "text-upgrade")
        .when((old("status") == "unsupported") & F.col("extension").isin(*SUPPORTED_EXTENSIONS), "unsupported-retry")
        .otherwise("unchanged")
    )


def action(reason_column: Column, extension: Column) -> Column:
    return F.when(reason_column == "unchanged", "skip").when(~extension.isin(*SUPPORTED_EXTENSIONS), "metadata").otherwise("parse")


def compare(listing: DataFrame, previous: DataFrame, rebuild: bool = False) -> DataFrame:
    """The listing with reason and action: one join with the previous documents by path."""
    old = previous.select("path", *(F.col(c).alias(f"old_{c}") for c in ("status", "parse_version", "size_bytes", "modified_at_ms")))
    return listing.join(old, "path", "left").withColumn("reason", reason(rebuild)).withColumn("action", action(F.col("reason"), F.col("extension"))).select(*listing.columns, "reason", "action")


def reason_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("reason").agg(F.count("*").alias("files"))


def sync_totals(compared: DataFrame) -> DataFrame:
    """One row of counts for a report."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    return compared.agg(
        F.count("*").alias("found"),
        of("reason", "added").alias("added"),
        F.count_if(~F.col("reason").isin("added", "unchanged")).alias("reprocessed"),
        of("action", "skip").alias("unchanged"),
        of("action", "parse").alias("parser_calls"),
        of("action", "metadata").alias("metadata_only"),
    )


def totals_of(tally: dict[tuple[str, str], int]) -> dict:
    """The numbers of sync_totals() and reason_counts(), from counts by reason and action."""
    of = lambda keep: sum(n for (why, do), n in tally.items() if keep(why, do))
    return {
        "found": of(lambda *_: True),
        "added": of(lambda why, _: why == "added"),
        "reprocessed": of(lambda why, _: why not in ("added", "unchanged")),
        "unchanged": of(lambda _, do: do == "skip"),
        "parser_calls": of(lambda _, do: do == "parse"),
        "metadata_only": of(lambda _, do: do == "metadata"),
        "reasons": {why: of(lambda w, _, why=why: w == why) for why in sorted({w for w, _ in tally})},
    }


def format_totals(listing: DataFrame) -> DataFrame:
    """Files and bytes by extension."""
    return listing.groupBy("extension").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
