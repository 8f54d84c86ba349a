"""Search sessions: layers of refinement over one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.snippet import snippets
from lodestone.functions.text import document_reference, query_terms
from lodestone.operators.search import Page, Scope, numbered, page_of, rank, reason, refine
from lodestone.plans.index import Index
from lodestone.sources.store import SnapshotChanged
from lodestone.sources.tables import discard, stored


class SearchSession:
    """A first query in a scope, and further ones that each look only at what the one before found, in the first one's order.

    A layer is a table in the shared folder, sorted by position: a page reads the row groups of its range, whatever executors are lost and whatever is committed meanwhile. Only new layers need the
    snapshot to be the current one.
    """

    def __init__(self, index: Index, raw_query: str, *, all_terms: bool = False, scope: Scope = Scope()):
        self.store, self.number, self.all_terms = index.store, index.number, all_terms
        self.index = Index(index.store)
        self.index.number = index.number
        self.documents, self.blocks = self.index.documents, self.index.blocks  # of this snapshot
        found = numbered(rank(scope.apply(self.documents), self.blocks, raw_query, all_terms=all_terms, candidates=self.index.candidates(raw_query, all_terms)))
        self.layers: list[tuple[str, DataFrame]] = [(raw_query, _layer(found.withColumn("first", F.col("position"))))]
        discard(self.store.spark, found)

    def _check(self) -> None:
        if self.store.current() != self.number:
            raise SnapshotChanged("the index has changed; begin a new session")

    def append(self, raw_query: str) -> None:
        self._check()
        before = self.layers[-1][1].select("id", F.col("first").alias("position"))
        found = refine(before, self.documents, self.blocks, raw_query, all_terms=self.all_terms, candidates=self.index.candidates(raw_query, self.all_terms))
        found = stored(found.withColumnRenamed("position", "first"), "refined")  # looked at twice
        parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.layers.append((raw_query, _layer(found.join(_dense(found.select("id", "first"), parts).withColumnRenamed("dense", "position"), "id"))))
        discard(self.store.spark, found)

    def back(self) -> None:
        """Takes the last layer off; the first one stays."""
        self._check()
        if len(self.layers) > 1:
            discard(self.store.spark, self.layers.pop()[1])

    def reset(self) -> None:
        self._check()
        while len(self.layers) > 1:
            discard(self.store.spark, self.layers.pop()[1])

    def page(self, number: int = 1, size: int = 20) -> Page:
        """A page of the last layer with reasons and snippets; positions are counted within the layer. Snippets are made for the page's rows only."""
        raw, hits = self.layers[-1]
        page = page_of(hits, number, size)
        rows = page.rows.join(self.blocks.select(F.col("document_id").alias("id"), "ordinal", "heading", "content"), ["id", "ordinal"], "left")
        source = F.when(F.col("source_kind") == "filename", F.col("filename")).when(F.col("source_kind") == "heading", F.col("heading")).otherwise(F.col("content"))
        rows = rows.withColumn("snippet", snippets(source, query_terms(raw, self.all_terms)[1])).withColumn("reason", reason(F.col("rank"), self.all_terms)).withColumn("reference", document_reference(F.col("id"), F.col("path")))
        return Page(page.page, page.page_size, page.total, page.page_count, page.start, page.end, rows.select("position", "reference", "id", "path", "rank", "reason", "source_kind", "ordinal", "snippet").orderBy("position"))


def _layer(hits: DataFrame) -> DataFrame:
    return stored(hits.repartitionByRange("position").sortWithinPartitions("position"), "layer")


def _dense(places: DataFrame, parts: int) -> DataFrame:
    """(id, dense): positions without gaps, in the order of the first layer's."""
    from pyspark.sql import Window

    top = places.agg(F.max("first")).first()[0] or 1
    dealt = places.withColumn("_part", F.floor((F.col("first") - 1) * parts / top))
    sizes = dealt.groupBy("_part").count()  # one row for each part
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy("first"))
    return dealt.withColumn("_row", row).join(F.broadcast(before), "_part").select("id", (F.col("_row") + F.col("_before")).alias("dense"))
