"""Changes to an index as DataFrames: merge, touch, remove, move between roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import ancestors, below, key_ancestors, parts, path_key
from lodestone.sources.tables import stored


def covered_by(rows: DataFrame, scopes: DataFrame, how: str, path: str = "path") -> DataFrame:
    """rows that lie (left_semi) or don't lie (left_anti) in or below a scope (path). An equality join on the rows' ancestors, so it scales with their depth."""
    named = scopes.select(F.regexp_replace("path", "(?<=.)/+$", "").alias("_scope")).distinct()
    steps = rows.withColumn("_scope", F.explode(ancestors(F.col(path))))
    inside = steps.join(named, "_scope", "left_semi").select(path).distinct()
    return rows.join(inside, path, how)


def covering_roots(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root): the most specific root (root) that covers each document; those that none covers are left out. An equality join on ancestors."""
    steps = documents.select("id", F.explode(ancestors(F.col("path"))).alias("root"))
    return steps.join(roots, "root").groupBy("id").agg(F.max_by("root", F.size(parts(F.col("root")))).alias("root"))


def covering_keys(rows: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """rows with root: the most specific root (root) of any platform that covers their path, null if none does. An equality join on the keys of the folders above."""
    named = roots.select("root", path_key(F.col("root")).alias("_key")).dropDuplicates(["_key"])
    own = rows.withColumn("_own", path_key(F.col(path)))
    steps = own.select("_own", F.explode(key_ancestors(F.col("_own"))).alias("_key")).distinct()
    best = steps.join(named, "_key").groupBy("_own").agg(F.max_by("root", F.length("_key")).alias("root"))
    return own.join(best, "_own", "left").drop("_own")


def remove_missing(documents: DataFrame, listed: DataFrame, *, root: str, subtree: str | None = None, scopes: DataFrame | None = None, protected: DataFrame | None = None) -> DataFrame:
    """documents with outcome: kept, deleted (not listed any more) or protected (not listed, but in a scope that couldn't be read). Rows outside the root, the subtree
    and the scopes (path; in or below one of them), where these are given, are kept."""
    in_scope = F.col("root_path") == root
    if subtree is not None:
        in_scope = in_scope & below(F.col("path"), subtree)
    marked = documents.join(listed.select("path").distinct().withColumn("_listed", F.lit(True)), "path", "left")
    if scopes is not None:
        looked_at = covered_by(documents.where(in_scope).select("path"), scopes, "left_semi").select("path").distinct().withColumn("_scoped", F.lit(True))
        marked = marked.join(looked_at, "path", "left")
        in_scope = in_scope & F.coalesce(F.col("_scoped"), F.lit(False))
    gone = F.coalesce(in_scope, F.lit(False)) & F.col("_listed").isNull()
    if protected is None:
        return marked.withColumn("outcome", F.when(gone, "deleted").otherwise("kept")).drop("_listed").select(*documents.columns, "outcome")
    safe = covered_by(marked.where(gone).select("path"), protected, "left_semi").select("path").withColumn("_safe", F.lit(True))
    out = marked.join(safe, "path", "left")
    return out.withColumn("outcome", F.when(~gone, "kept").when(F.col("_safe"), "protected").otherwise("deleted")).select(*documents.columns, "outcome")


def next_ids(new: DataFrame, first: int, order: Column, ident: str = "id") -> DataFrame:
    """new rows with ids from ``first`` on, gapless and ascending in the given order: sorted in ranges, counted in each and shifted, so no task numbers all rows. They read a stored table, which
    discard() deletes once they have been written."""
    placed = new.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    placed = stored(placed, "numbered")  # ranges are drawn from a sample: they have to be the same for counts and rows
    sizes = placed.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row for each part
    row = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    out = placed.join(F.broadcast(before), "_part").withColumn(ident, (F.lit(first - 1) + F.col("_before") + row).cast("long")).drop("_part", "_before")
    out._lodestone_path = placed._lodestone_path
    return out


def upsert(documents: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of changed replace those with their path and keep their id; new paths get ids after the largest. Columns are those of documents."""
    old = changed.join(documents.select("path", "id"), "path", "left")
    top = documents.agg(F.max("id")).first()[0] or 0
    kept = documents.join(changed.select("path"), "path", "left_anti")
    same = old.where("id is not null")
    new = next_ids(old.where("id is null").drop("id"), top + 1, F.col("path"))
    return kept.unionByName(same.select(*documents.columns)).unionByName(new.select(*documents.columns))


def replace_blocks(blocks: DataFrame, changed_ids: DataFrame, new_blocks: DataFrame) -> DataFrame:
    """blocks of the changed documents (document_id) give way to the new ones."""
    return blocks.join(changed_ids, "document_id", "left_anti").unionByName(new_blocks)


def touch(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """documents with size, time of change and status of ``seen`` (path, size_bytes, modified_at_ms, status); blocks aren't touched."""
    new = seen.select("path", *(F.col(c).alias(f"_{c}") for c in ("size_bytes", "modified_at_ms", "status")), F.lit(True).alias("_seen"))
    out = documents.join(new, "path", "left")
    return out.select(*(F.when(F.col("_seen"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("size_bytes", "modified_at_ms", "status") else F.col(c) for c in documents.columns))


def remove_documents(documents: DataFrame, blocks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents named by gone (id)."""
    return documents.join(gone, "id", "left_anti"), blocks.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def merge_roots(documents: DataFrame, parent: str, former: list[str]) -> DataFrame:
    """documents of the former roots belong to the parent; ids stay."""
    return documents.withColumn("root_path", F.when(F.col("root_path").isin(*former), F.lit(parent)).otherwise(F.col("root_path")))


def merged_ignore_scopes(scopes: DataFrame, parent: str, former: list[str]) -> DataFrame:
    """(root_path, base_path): the parent's scopes, its former roots as new ones, and theirs, each once."""
    spark = scopes.sparkSession
    own = spark.createDataFrame([(parent, f) for f in former], "root_path string, base_path string") if former else scopes.limit(0)
    moved = scopes.withColumn("root_path", F.when(F.col("root_path").isin(*former), F.lit(parent)).otherwise(F.col("root_path")))
    return moved.unionByName(own).dropDuplicates(["root_path", "base_path"])


def root_history(edges: DataFrame) -> DataFrame:
    """(former_path, current_path, steps): follows former -> parent links to their ends. Links that run in a circle have no end and are left out.

    Path lengths double with each round, so rounds grow with the logarithm of the longest chain; the table holds one row per root.
    """
    longest = edges.count()
    step = edges.select("former_path", F.col("parent_path").alias("current_path"), F.lit(1).cast("long").alias("steps"))
    for _ in range(max(1, longest).bit_length() + 1):
        ahead = step.select(F.col("former_path").alias("current_path"), F.col("current_path").alias("_next"), F.col("steps").alias("_more"))
        grown = step.join(ahead, "current_path", "left")
        step = grown.select("former_path", F.coalesce("_next", "current_path").alias("current_path"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"))
    return step.where(F.col("steps") <= longest).join(edges.select(F.col("former_path").alias("current_path")), "current_path", "left_anti").select("former_path", "current_path", "steps")
