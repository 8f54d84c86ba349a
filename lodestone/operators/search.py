"""Exact search: predicates, four-tier ranking, order, paging and refinement."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import below, utf16_order
from lodestone.functions.text import document_reference, iso_time, query_terms
from lodestone.sources.tables import stored

#: The labels of the four ranks, and what is added to those of a search for all terms.
RANK_LABELS = {4: "檔名完全符合", 3: "檔名包含", 2: "標題", 1: "內容"}
ALL_TERMS_SUFFIX = "（全部關鍵字）"
DEFAULT_LIMIT, PAGE_LIMIT, WINDOW_ROWS = 20, 50, 500


@dataclass(frozen=True)
class Scope:
    """What a search looks at. Folders compare by whole components."""

    types: tuple[str, ...] = ()
    root: str | None = None
    subtree: str | None = None

    def apply(self, documents: DataFrame) -> DataFrame:
        if self.types:
            documents = documents.where(F.col("extension").isin(*self.types))
        if self.root is not None:
            documents = documents.where(F.col("root_path") == self.root)
        if self.subtree is not None:
            documents = documents.where(below(F.col("path"), self.subtree))
        return documents


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def rank(documents: DataFrame, blocks: DataFrame, raw_query: str, *, all_terms: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """documents that match, with rank (4 to 1), source_kind (filename, heading, content) and ordinal of the representative block (null for filename hits).

    documents: DOCUMENTS with norm_filename; blocks: BLOCKS. A document whose filename matches is never joined to its blocks. Of the others only
    blocks that hold a term take part: they are filtered before the one shuffle, by document. ``candidates`` (document_id) may name
    a superset of the documents whose blocks match, to prune more.
    """
    query, terms = query_terms(raw_query, all_terms)
    name = F.col("norm_filename")
    exact, part = name == query, _all([F.contains(name, F.lit(t)) for t in terms])
    named = documents.where(exact | part).select("*", F.when(exact, 4).otherwise(3).alias("rank"), F.lit("filename").alias("source_kind"), F.lit(None).cast("int").alias("ordinal"))
    others = documents.where(~(exact | part) | name.isNull())
    heading, content = F.coalesce(F.col("norm_heading"), F.lit("")), F.coalesce(F.col("norm_content"), F.lit(""))
    in_heading, in_content = [F.contains(heading, F.lit(t)) for t in terms], [F.contains(content, F.lit(t)) for t in terms]
    if candidates is not None:
        blocks = blocks.join(candidates, "document_id", "left_semi")
    hits = blocks.where(_any(in_heading + in_content))
    found = [F.min(F.when(_all(in_heading), F.col("ordinal"))).alias("_head"), F.min(F.when(_all(in_content), F.col("ordinal"))).alias("_body")]
    if all_terms:
        heading_hit = _any(in_heading)
        cover = lambda flags: reduce(lambda a, b: a + b, [f.cast("int") for f in flags])
        covered = F.when(heading_hit, cover(in_heading)).otherwise(cover(in_content))
        best = F.max_by(F.struct("ordinal", heading_hit.alias("heading")), F.struct(covered, heading_hit, -F.col("ordinal")))
        found += [best.alias("_best"), *(F.max(h | c).alias(f"_seen{k}") for k, (h, c) in enumerate(zip(in_heading, in_content)))]
    grouped = hits.groupBy("document_id").agg(*found)
    joined = others.join(grouped, others["id"] == grouped["document_id"])
    if all_terms:
        joined = joined.where(_all([F.contains(F.coalesce(name, F.lit("")), F.lit(t)) | F.col(f"_seen{k}") for k, t in enumerate(terms)]))
        place = F.coalesce("_head", "_body", F.col("_best.ordinal"))
        kind = F.when(F.col("_head").isNotNull(), "heading").when(F.col("_body").isNotNull(), "content").otherwise(F.when(F.col("_best.heading"), "heading").otherwise("content"))
    else:
        joined = joined.where("_head is not null or _body is not null")
        place = F.coalesce("_head", "_body")
        kind = F.when(F.col("_head").isNotNull(), "heading").otherwise("content")
    level = F.when(F.col("_head").isNotNull(), 2).otherwise(1)
    return named.unionByName(joined.select(*documents.columns, level.alias("rank"), kind.alias("source_kind"), place.cast("int").alias("ordinal")))


def representatives(blocks: DataFrame, raw_query: str) -> DataFrame:
    """(document_id, ordinal, content) of each document's first block whose content holds the phrase."""
    phrase = query_terms(raw_query)[0]
    hits = blocks.where(F.contains(F.col("norm_content"), F.lit(phrase)))
    return hits.groupBy("document_id").agg(F.min("ordinal").alias("ordinal"), F.min_by("content", "ordinal").alias("content"))


def by_place(documents: DataFrame, *, paths: tuple[str, ...] = (), ids: tuple[int, ...] = ()) -> DataFrame:
    """The documents with these paths or ids."""
    return documents.where(F.col("path").isin(*paths) | F.col("id").isin(*ids))


def reason(rank_column: Column, all_terms: bool = False) -> Column:
    suffix = ALL_TERMS_SUFFIX if all_terms else ""
    label = F.lit(None)
    for level, text in RANK_LABELS.items():
        label = F.when(rank_column == level, text + (suffix if level < 4 else "")).otherwise(label)
    return label


def result_order() -> list[Column]:
    """Better ranks first, then later changes, then the path by UTF-16 code units."""
    return [F.desc("rank"), F.desc("modified_at_ms"), utf16_order(F.col("path")).asc()]


def search(documents: DataFrame, blocks: DataFrame, raw_query: str, *, all_terms: bool = False, scope: Scope = Scope(), limit: int | None = DEFAULT_LIMIT, candidates: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` hits in result order (all of them, unordered, for None). The scope is applied before anything else, the limit last."""
    found = rank(scope.apply(documents), blocks, raw_query, all_terms=all_terms, candidates=candidates)
    return found if limit is None else found.orderBy(*result_order()).limit(limit)


def numbered(hits: DataFrame) -> DataFrame:
    """hits with position (from 1) in result order.

    Positions need one total order. Hits are dealt into ranges by rank and by approximate percentiles of the time of change (a few numbers on
    the driver); each range is numbered on its own and shifted by the counts of those before it, so no task holds more than a range. They read a stored table, which discard() deletes
    once they have been written.
    """
    hits = stored(hits, "hits")  # ids, paths and times: looked at three times
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = hits.agg(F.percentile_approx("modified_at_ms", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("q")).first()["q"]
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts or [])))).cast("array<double>")
    newer = parts - F.size(F.filter(bounds, lambda c: c <= F.col("modified_at_ms")))
    ranged = hits.withColumn("_range", (4 - F.col("rank")) * (parts + 1) + newer)
    rows = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*result_order())))
    sizes = ranged.groupBy("_range").count()  # one row for each range
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    out = rows.join(F.broadcast(before), "_range").withColumn("position", (F.col("_row") + F.col("_before")).cast("long")).drop("_range", "_row", "_before")
    out._lodestone_path = hits._lodestone_path
    return out


@dataclass(frozen=True)
class Page:
    page: int
    page_size: int
    total: int
    page_count: int
    start: int
    end: int
    rows: DataFrame


def page_of(ranked: DataFrame, page: int, page_size: int, position: str = "position") -> Page:
    """A page of numbered hits. Beyond the last page of a non-empty result is an error; an empty result has one empty page."""
    if page < 1 or page_size < 1:
        raise ValueError("pages and page sizes begin at 1")
    total = ranked.count()
    count = max(1, -(-total // page_size))
    if total and page > count:
        raise ValueError(f"there are {count} pages")
    offset = (page - 1) * page_size
    end = min(offset + page_size, total)
    rows = ranked.where((F.col(position) > offset) & (F.col(position) <= offset + page_size)).orderBy(position)
    return Page(page, page_size, total, count, offset + 1 if end > offset else 0, max(end, 0) if end > offset else 0, rows)


def windowed(hits: DataFrame, rows: int = WINDOW_ROWS) -> DataFrame:
    """The accessible window of a result, with total_hits and truncated. Counts the hits at once."""
    total = hits.count()
    return hits.orderBy(*result_order()).limit(rows).withColumns({"total_hits": F.lit(total).cast("long"), "truncated": F.lit(total > rows)})


def refine(previous: DataFrame, documents: DataFrame, blocks: DataFrame, raw_query: str, *, all_terms: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """A further layer: hits of the query among those of ``previous`` (id, position), in the order of the first layer; rank, kind and block are the new query's. ``candidates`` as in rank()."""
    among = documents.join(previous.select("id"), "id", "left_semi")
    found = rank(among, blocks.join(previous.select(F.col("id").alias("document_id")), "document_id", "left_semi"), raw_query, all_terms=all_terms, candidates=candidates)
    return found.join(previous.select("id", "position"), "id")


def search_page(documents: DataFrame, blocks: DataFrame, raw_query: str, page: int, page_size: int, *, all_terms: bool = False, scope: Scope = Scope(), candidates: DataFrame | None = None) -> DataFrame:
    """A page of the accessible window: position, reference, path, reason, modified_at, total_hits, truncated. Beyond the window's last page there are no rows."""
    if page < 1 or not 1 <= page_size <= PAGE_LIMIT:
        raise ValueError(f"pages begin at 1 and have 1 to {PAGE_LIMIT} rows")
    hits = windowed(stored(rank(scope.apply(documents), blocks, raw_query, all_terms=all_terms, candidates=candidates), "hits"))
    placed = hits.withColumn("position", F.row_number().over(Window.orderBy(*result_order())).cast("long"))  # at most WINDOW_ROWS rows
    rows = placed.where((F.col("position") > (page - 1) * page_size) & (F.col("position") <= page * page_size))
    return rows.select("position", document_reference(F.col("id"), F.col("path")).alias("reference"), "path", reason(F.col("rank"), all_terms).alias("reason"), iso_time(F.col("modified_at_ms")).alias("modified_at"), "total_hits", "truncated").orderBy("position")
