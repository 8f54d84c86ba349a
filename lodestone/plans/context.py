"""Context bundles: selected documents with their best passages, as nested rows, Markdown or JSON within a byte limit."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.snippet import snippets
from lodestone.functions.text import document_reference, parse_reference, query_terms, terminal_text, trim
from lodestone.operators.passages import DEFAULT_PASSAGES, MOST_PASSAGES, all_terms_passages, phrase_passages
from lodestone.operators.search import WINDOW_ROWS, Scope, reason, search
from lodestone.plans.index import Index
from lodestone.plans.session import SearchSession

#: The version of the bundle's layout, selected documents and bytes at most.
SCHEMA_VERSION, MOST_SELECTED, MOST_BYTES = 4, 20, 256 * 1024


class ContextError(ValueError):
    """code: CONTEXT_..."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def best_passages(documents: DataFrame, blocks: DataFrame, raw_query: str, passages: int, all_terms: bool) -> DataFrame:
    """(document_id, passage_no, rank, ordinal, heading, content, location_kind, location_value) of the documents' best blocks."""
    if not all_terms:
        return phrase_passages(blocks, raw_query, passages).drop("norm_heading", "norm_content")
    chosen = all_terms_passages(documents, blocks, raw_query, passages).select("document_id", "passage_no", "ordinal", "rank")
    return chosen.join(blocks.drop("norm_heading", "norm_content"), ["document_id", "ordinal"])


def bundle(documents: DataFrame, blocks: DataFrame, raw_query: str, *, limit: int = MOST_SELECTED, passages: int = DEFAULT_PASSAGES, scope: Scope = Scope(), all_terms: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """One row for each of the first hits: reference, path, rank, reason and passages (array of ordinal, heading, content, location), best first. ``candidates`` as in search().

    Hits are chosen first; passages are looked for in their blocks only. At most ``passages`` blocks of a document are gathered.
    """
    if not 1 <= limit <= MOST_SELECTED or not 1 <= passages <= MOST_PASSAGES:
        raise ValueError(f"1 to {MOST_SELECTED} documents with 1 to {MOST_PASSAGES} passages")
    hits = search(documents, blocks, raw_query, scope=scope, limit=limit, all_terms=all_terms, candidates=candidates)
    chosen = blocks.join(F.broadcast(hits.select(F.col("id").alias("document_id"))), "document_id", "left_semi")  # ``limit`` rows
    best = best_passages(documents, chosen, raw_query, passages, all_terms)
    found = best.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("passage_no", "ordinal", "heading", "content", "location_kind", "location_value"))).alias("passages"))
    out = hits.join(found, hits["id"] == found["document_id"], "left")
    empty = F.array().cast(found.schema["passages"].dataType)
    return out.select(document_reference(F.col("id"), F.col("path")).alias("reference"), "path", "filename", "rank", reason(F.col("rank"), all_terms).alias("reason"), F.coalesce("passages", empty).alias("passages"))


def changed_results(before: DataFrame, now: DataFrame, key: str = "reference") -> DataFrame:
    """(key) of earlier results that aren't the same now: gone, or different in any column that both have. Nulls equal nulls."""
    columns = [c for c in before.columns if c != key and c in now.columns]
    later = now.select(key, F.struct(*columns).alias("_now"), F.lit(True).alias("_there"))
    same = F.struct(*columns).eqNullSafe(F.col("_now")) & F.col("_there")
    return before.join(later, key, "left").where(~F.coalesce(same, F.lit(False))).select(key)


def with_reports(documents: DataFrame, reports: dict[str, dict]) -> DataFrame:
    """documents with the last successful synchronisation of their root, in ms, and whether the last one was complete."""
    rows = [(root, r.get("successful_at_ms"), r.get("complete")) for root, r in reports.items()]
    frame = documents.sparkSession.createDataFrame(rows, "root_path string, last_successful_sync long, last_sync_complete boolean")
    return documents.join(F.broadcast(frame), "root_path", "left")  # one row for each root


def prepare(index: Index, selections: list[tuple[str, str]], *, passages: int = DEFAULT_PASSAGES, all_terms: bool = False, scope: Scope = Scope(), seen: DataFrame | None = None) -> list[dict]:
    """The selected documents (query, reference), checked again against index and files, with their passages.

    Each has to be among the first WINDOW_ROWS hits of its query still, its file mustn't have changed since, and if ``seen`` (reference, ...) has the results from which it was
    selected, these must be the same as now. Documents found by their filename only have one passage: their name.
    """
    references = [r for _, r in selections]
    if not 1 <= len(selections) <= MOST_SELECTED or len(set(references)) < len(references):
        raise ContextError("CONTEXT_SELECTION_INVALID", f"1 to {MOST_SELECTED} different documents")
    if not 1 <= passages <= MOST_PASSAGES:
        raise ContextError("CONTEXT_OPTIONS_INVALID", f"1 to {MOST_PASSAGES} passages")
    by_query: dict[str, list[str]] = {}
    for query, reference in selections:
        try:
            parse_reference(reference)
        except ValueError:
            raise ContextError("CONTEXT_SELECTION_INVALID", f"not a reference: {reference}") from None
        if not trim(query):
            raise ContextError("CONTEXT_SELECTION_INVALID", "a blank query")
        by_query.setdefault(trim(query), []).append(reference)
    if index.store.current() != index.number:
        raise ContextError("CONTEXT_INDEX_CHANGED", "the index has changed; search again")
    documents, blocks = with_reports(index.documents, index.meta["roots"]), index.blocks
    out: dict[str, dict] = {}
    for query, wanted in by_query.items():  # at most MOST_SELECTED queries
        hits = search(documents, blocks, query, all_terms=all_terms, scope=scope, limit=WINDOW_ROWS, candidates=index.candidates(query, all_terms))
        hits = hits.withColumn("reference", document_reference(F.col("id"), F.col("path"))).where(F.col("reference").isin(*wanted))
        rows = {r["reference"]: r for r in hits.collect()}  # the selected ones
        if missing := [r for r in wanted if r not in rows]:
            raise ContextError("CONTEXT_REFERENCE_MISSING", f"not among the results any more: {missing[0]}")
        if seen is not None and not changed_results(seen.where(F.col("reference").isin(*wanted)), hits).isEmpty():
            raise ContextError("CONTEXT_INDEX_CHANGED", "a result has changed; search again")
        ids = [r["id"] for r in rows.values()]
        terms = query_terms(query, all_terms)[1]
        best = best_passages(documents.where(F.col("id").isin(*ids)), blocks.where(F.col("document_id").isin(*ids)), query, passages, all_terms)
        source = F.when(F.col("rank") == 2, F.col("heading")).otherwise(F.col("content"))
        found: dict[int, list] = {}
        for p in best.withColumn("snippet", snippets(source, terms)).orderBy("document_id", "passage_no").collect():  # ``passages`` of each selected one
            found.setdefault(p["document_id"], []).append({"query": query, "ordinal": p["ordinal"], "heading": p["heading"], "location": p["location_value"], "content": p["snippet"]["text"], "truncated": p["snippet"]["truncated"]})
        for reference in wanted:
            row = rows[reference]
            if index.changed_since(row["path"]) is not False:
                raise ContextError("CONTEXT_SOURCE_CHANGED", f"{row['path']} has changed; index it again")
            named = [{"query": query, "ordinal": None, "heading": None, "location": None, "content": row["filename"], "truncated": False}]
            out[reference] = {k: row[k] for k in ("reference", "path", "filename", "root_path", "status", "rank", "last_successful_sync", "last_sync_complete")} | {
                "query": query, "filename_only": row["source_kind"] == "filename", "passages": found.get(row["id"]) or named,
            }
    return [out[r] for r in references]


class Selection:
    """References chosen for a bundle, in order; toggling is all or nothing."""

    def __init__(self) -> None:
        self.references: list[str] = []
        self.queries: list[str] = []

    def toggle(self, references: list[str], query: str) -> None:
        """Drops those that are selected and adds the others; raises ValueError, and changes nothing, if that were too many."""
        wanted = list(dict.fromkeys(references))
        kept = [r for r in self.references if r not in wanted] + [r for r in wanted if r not in self.references]
        if len(kept) > MOST_SELECTED:
            raise ValueError(f"at most {MOST_SELECTED} documents")
        self.references = kept
        if query not in self.queries:
            self.queries.append(query)

    def toggle_page(self, session: SearchSession, number: int = 1, size: int = 20) -> None:
        """Toggles all results of a page of a session."""
        rows = session.page(number, size).rows.select("reference").collect()  # ``size`` rows at most
        self.toggle([r["reference"] for r in rows], session.layers[-1][0])

    def page(self, number: int, size: int = 10) -> list[str]:
        return self.references[(number - 1) * size : number * size]


def serialize(rows: list[dict], queries: list[str]) -> str:
    """JSON of a bundle; raises ValueError beyond MOST_BYTES."""
    text = json.dumps({"schemaVersion": SCHEMA_VERSION, "queries": list(dict.fromkeys(queries)), "documents": rows}, ensure_ascii=False)
    if len(text.encode()) > MOST_BYTES:
        raise ValueError(f"the bundle takes more than {MOST_BYTES} bytes")
    return text


def markdown(rows: list[dict], queries: list[str]) -> str:
    """The bundle for reading: a section for each document, a quotation for each passage."""
    out = [f"# {' / '.join(map(terminal_text, dict.fromkeys(queries)))}"]
    for row in rows:
        out.append(f"\n## {terminal_text(row['filename'])}\n\n`{terminal_text(row['path'])}` ({row['reference']})")
        for p in row["passages"]:
            out.append(f"\n**{terminal_text(p['heading'] or p.get('location_value') or p.get('location') or '')}**\n\n" + "\n".join(f"> {terminal_text(line)}" for line in (p["content"] or "").split("\n")))
    text = "\n".join(out) + "\n"
    if len(text.encode()) > MOST_BYTES:
        raise ValueError(f"the bundle takes more than {MOST_BYTES} bytes")
    return text


def write_new(path: str, text: str) -> None:
    """Writes a file that mustn't exist yet."""
    with open(path, "x", encoding="utf-8") as file:
        file.write(text)
    os.chmod(path, 0o600)
