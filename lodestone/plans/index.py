"""Incremental indexing of folders into a store, and its state."""

from __future__ import annotations

import os
import stat
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.paths import covers
from lodestone.functions.text import document_reference, iso_time, norm, parse_reference
from lodestone.operators import classify, maintain, stats
from lodestone.operators.candidates import candidates
from lodestone.plans.roots import RootPlan, ownership_base, plan_root
from lodestone.sources.listing import scan_tree
from lodestone.sources.parsers import LARGEST_FILE, parse_column
from lodestone.sources.store import Store
from lodestone.sources.tables import discard, stored


#: Milliseconds in which a file mustn't change to be taken.
STABLE_MS = 100
#: Bytes of files that are handed on together.
READ_BYTES = 1 << 20


def read_files(files: DataFrame) -> DataFrame:
    """(document_id, filename, content) of (document_id, path, filename, size_bytes): read on the workers, one file after the other and handed on READ_BYTES at a time. Files over the limit come as an empty value of that size's class
    and those that can't be read as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary()))], names=["document_id", "filename", "content"])
        for batch in batches:
            for ident, path, name, size in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    content = b"" if size > LARGEST_FILE else open(path, "rb").read()
                except OSError:
                    content = None
                rows.append((ident, name, content))
                held += len(content or b"")
                if held >= READ_BYTES or len(rows) >= 1000:
                    yield table()
                    rows, held = [], 0
        if rows:
            yield table()

    return files.select("document_id", "path", "filename", "size_bytes").mapInArrow(run, "document_id long, filename string, content binary")


def stable(path: str) -> bool:
    """Whether a path is gone, a folder, or a file whose size and time of change stay as they are for STABLE_MS."""
    look = lambda: (lambda s: (s.st_size, s.st_mtime_ns))(os.stat(path, follow_symlinks=False))
    try:
        if not os.path.isfile(path):
            return True
        before = look()
        time.sleep(STABLE_MS / 1000)
        return look() == before
    except FileNotFoundError:
        return True


class SourceError(ValueError):
    """code: ACTION_..."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Index:
    """Documents and blocks of a store, pinned to the snapshot that was current when it was opened."""

    def __init__(self, store: Store):
        self.store, self.number = store, store.current()

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        return cls(Store(spark, folder))

    @property
    def documents(self) -> DataFrame:
        return self.store.table("documents", self.number).withColumn("norm_filename", norm(F.col("filename")))

    @property
    def blocks(self) -> DataFrame:
        return self.store.table("blocks", self.number)

    @property
    def meta(self) -> dict:
        return self.store.meta(self.number)

    @property
    def postings(self) -> DataFrame:
        return self.store.table("postings", self.number)

    def candidates(self, raw_query: str, all_terms: bool = False) -> DataFrame | None:
        """document_id of a superset of the documents whose blocks match; None if the query is too short to prune. Documents in parts without postings may all match."""
        found = candidates(self.postings, raw_query, self.documents if all_terms else None)
        left = self.store.unposted(self.number)
        if found is None or not left:
            return found
        unknown = self.documents.where(self.store.part_of(F.col("id"), self.number).isin(*left))
        return found.union(unknown.select(F.col("id").alias("document_id"))).distinct()

    def sync(self, folder: str, *, rebuild: bool = False, wait: bool = False, progress: Callable[[str, dict], None] | None = None) -> dict:
        """Brings the index up to date with a folder and returns the report. Only files that need it are read; a snapshot is committed at the end, or
        nothing is. Below folders that can't be read nothing is deleted. If nothing has changed, only the report is written, and the tables stay. A folder that isn't there is refused.
        ``progress(phase, numbers)`` is told of each phase."""
        if not os.path.isdir(folder):
            raise NotADirectoryError(f"not a folder: {folder}")
        with self.store.writing(wait):
            meta = self.store.meta(self.store.current())
            plan = plan_root(list(meta["roots"]), os.path.realpath(folder))
            return self._bring_up(plan, [plan.subtree or plan.root], rebuild, progress or (lambda *_: None))

    def apply(self, root: str, paths: list[str] | None, *, wait: bool = True) -> dict:
        """Brings the given paths of an indexed root up to date: files that are there are indexed, what is gone is removed with all below it, folders are
        looked through. None: the whole root. Files that are still being written (size or time change within STABLE_MS) are left for the next time, listed as ``unstable``."""
        with self.store.writing(wait):
            meta = self.store.meta(self.store.current())
            if root not in meta["roots"]:
                raise LookupError(f"{root} isn't indexed")
            plan = RootPlan("existing", root)
            if not os.path.isdir(root):  # offline: whatever is missing may come back
                return {"found": 0, "removed": 0, "offline": True, "complete": False, "unstable": sorted(paths or ())}
            if paths is None:
                return self._bring_up(plan, [root], False, lambda *_: None)
            steady = [p for p in paths if stable(p)]
            report = self._bring_up(plan, steady, False, lambda *_: None) if steady else {"found": 0, "removed": 0}
            return report | {"unstable": sorted(set(paths) - set(steady))}

    def _bring_up(self, plan: RootPlan, scopes: list[str], rebuild: bool, progress: Callable[[str, dict], None]) -> dict:
        """Compares what lies in and below the scopes with the index and commits the difference."""
        began = time.time()
        spark = self.store.spark
        number = self.store.current()
        meta = self.store.meta(number)
        documents = self.store.table("documents", number)
        moved = [tuple(x) for x in meta["ignore_scopes"]]
        if plan.kind == "merge":
            documents = maintain.merge_roots(documents, plan.root, list(plan.children))
            moved = list(dict.fromkeys([(plan.root if r in plan.children else r, b) for r, b in moved] + [(plan.root, c) for c in plan.children]))
            meta["history"] = [*meta["history"], *([c, plan.root] for c in plan.children)]
            meta["roots"] = {r: v for r, v in meta["roots"].items() if r not in plan.children}
        found = scan_tree(spark, plan.root, scopes, extra_bases=[b for r, b in moved if r == plan.root], artifacts=self.store.artifacts())
        progress("listed", {"files": found.counts.get("file", 0)})
        listed = found.files
        inside = spark.createDataFrame([(p,) for p in scopes], "path string")
        known = documents.where(F.col("root_path") == plan.root)
        if scopes != [plan.root]:
            known = maintain.covered_by(known, inside, "left_semi")
        compared = classify.compare(listed, known, rebuild)
        lost = known.join(listed, "path", "left_anti").select(F.lit("missing").alias("reason"), F.lit("missing").alias("action"))
        tally = {(r["reason"], r["action"]): r["count"] for r in compared.select("reason", "action").unionByName(lost).groupBy("reason", "action").count().collect()}
        missing = tally.pop(("missing", "missing"), 0)
        totals = classify.totals_of(tally)
        progress("compared", totals)
        complete = not found.counts.get("error")
        if not missing and totals["unchanged"] == totals["found"] and plan.kind in ("existing", "subtree") and number:
            report = totals | {"committed": {}, "removed": 0, "protected": 0, "skipped": found.skipped, "complete": complete, "elapsed_ms": int((time.time() - began) * 1000)}
            self._note(plan, scopes, meta, report, int(began * 1000))
            self.number = self.store.record(number, meta)
            discard(spark, found.folder)
            progress("committed", {"snapshot": self.number})
            return report
        now = int(began * 1000)
        todo = compared.where("action <> 'skip'").join(documents.select("path", "id"), "path", "left")
        if totals["added"]:
            top = documents.agg(F.max("id")).first()[0] or 0
            fresh = maintain.next_ids(todo.where("id is null").drop("id"), top + 1, F.col("path"))
            todo = todo.where("id is not null").unionByName(fresh)
        todo = stored(todo, "todo")
        if totals["added"]:
            discard(spark, fresh)
        files = todo.where("action = 'parse'").select(F.col("id").alias("document_id"), "path", "filename", "size_bytes")
        tasks = max(1, min(totals["parser_calls"], 4 * spark.sparkContext.defaultParallelism, 1 + totals["parser_calls"] // 20)) if totals["parser_calls"] < 100_000 else None
        # files may change meanwhile: they are read once. Few files are still dealt to all cores
        parsed = stored(parse_column(read_files(files.repartition(tasks, "document_id") if tasks else files.repartition("document_id"))), "parsed")
        outcome = parsed.groupBy("document_id").agg(F.first("status").alias("status"), F.first("error_code").alias("error_code"), F.first("error_message").alias("error_message"))
        changed = todo.join(outcome, todo["id"] == outcome["document_id"], "left")
        large = F.col("size_bytes") > LARGEST_FILE
        version = F.when(F.col("extension").isin(*S.TEXT_EXTENSIONS), S.TEXT_PARSE_VERSION).cast("int")
        changed = changed.select(
            "id", F.lit(plan.root).alias("root_path"), "path", "filename", "extension", "size_bytes", "modified_at_ms", F.lit(now).cast("long").alias("indexed_at_ms"),
            F.when(large & (F.col("action") == "parse"), "too_large").otherwise(F.coalesce("status", F.lit("unsupported"))).alias("status"),
            F.when(large & (F.col("action") == "parse"), "FILE_TOO_LARGE").otherwise(F.col("error_code")).alias("error_code"), "error_message", version.alias("parse_version"), "reason",
        )
        noted = changed.groupBy("reason", F.col("status") == "error", self.store.part_of(F.col("id"), number)).count().toDF("reason", "failed", "part", "n").collect()  # by part, so bounded
        committed = Counter()
        for r in noted:
            committed[r["reason"]] += 0 if r["failed"] else r["n"]
        totals["committed"] = {k: n for k, n in committed.items() if n}
        merged = documents.join(changed.select("path"), "path", "left_anti").unionByName(changed.select(*documents.columns))
        protected = None if complete else found.protected
        none = merged.limit(0).withColumn("outcome", F.lit("kept"))
        judged = maintain.remove_missing(merged, listed, root=plan.root, scopes=None if scopes == [plan.root] else inside, protected=protected) if missing else none
        lost = stored(judged.where("outcome <> 'kept'").select("id", "path", "outcome"), "lost") if missing else none.select("id", "path", "outcome")
        outcomes = {r["outcome"]: r["count"] for r in lost.groupBy("outcome").count().collect()} if missing else {}
        gone = lost.where("outcome = 'deleted'").select(F.col("id").alias("document_id"))
        kept = merged.join(gone.select(F.col("document_id").alias("id")), "id", "left_anti") if missing else merged
        stale = todo.where("action = 'parse'").select(F.col("id").alias("document_id")).union(gone)
        touched = None
        if plan.kind != "merge":  # at most one row for each part
            touched = sorted({r["part"] for r in noted} | ({r[0] for r in gone.select(self.store.part_of(F.col("document_id"), number)).distinct().collect()} if missing else set()))
        progress("parsed", {"parts": len(touched) if touched is not None else None})
        new = parsed.where("ordinal is not null").select("document_id", "ordinal", "heading", "content", "location_kind", "location_value").withColumns({"norm_heading": norm(F.col("heading")), "norm_content": norm(F.col("content"))})
        blocks = self.store.table("blocks", number, touched)
        new_blocks = maintain.replace_blocks(blocks, stale, new.select(*blocks.columns)) if number else new.select(*blocks.columns)  # what is gone wasn't parsed
        report = totals | {"removed": outcomes.get("deleted", 0), "protected": outcomes.get("protected", 0), "skipped": found.skipped, "complete": complete, "elapsed_ms": int((time.time() - began) * 1000)}
        self._note(plan, scopes, meta, report, now)
        meta["ignore_scopes"] = [list(x) for x in moved]
        self.number = self.store.commit(kept, new_blocks, meta, touched, base=number)
        discard(spark, found.folder, todo, parsed, *([lost] if missing else []))
        progress("committed", {"snapshot": self.number})
        return report

    @staticmethod
    def _note(plan: RootPlan, scopes: list[str], meta: dict, report: dict, now: int) -> None:
        """Keeps the report of a whole root in the meta."""
        if scopes == [plan.root]:
            before = meta["roots"].get(plan.root) or {}
            report["successful_at_ms"] = now if report["complete"] else before.get("successful_at_ms")
            meta["roots"][plan.root] = report

    def clear(self) -> int:
        """Drops all documents; roots stay known. Returns how many documents went."""
        with self.store.writing():
            number = self.store.current()
            documents, blocks = self.store.table("documents", number), self.store.table("blocks", number)
            n = documents.count()
            self.number = self.store.commit(documents.limit(0), blocks.limit(0), self.store.meta(number))
        return n

    def remove_root(self, root: str) -> int:
        """Drops a root with its documents and blocks; returns how many documents went."""
        with self.store.writing():
            number = self.store.current()
            meta = self.store.meta(number)
            documents, blocks = self.store.table("documents", number), self.store.table("blocks", number)
            gone = documents.where(F.col("root_path") == root).select("id")
            n = gone.count()
            kept, left = maintain.remove_documents(documents, blocks, gone)
            meta["roots"].pop(root, None)
            meta["ignore_scopes"] = [x for x in meta["ignore_scopes"] if x[0] != root]
            self.number = self.store.commit(kept, left, meta)
        return n

    def status(self) -> dict[str, DataFrame]:
        """Tables on the state of the index."""
        documents = self.store.table("documents", self.number)
        return {
            "statuses": stats.status_counts(documents),
            "extensions": stats.extension_stats(documents),
            "roots": stats.documents_by_root(documents),
            "pending": stats.text_upgrade_pending(documents),
            "issues": stats.issues(documents),
            "content": stats.content_stats(documents, self.blocks),
            "last": documents.agg(iso_time(F.max("indexed_at_ms")).alias("indexed_at")),
        }

    def resolve(self, reference: str) -> dict:
        """path, and whether it differs from its indexed state, of a reference to a document whose file is there, below its root and through no link. Raises SourceError."""
        try:
            ident, _ = parse_reference(reference)
        except ValueError:
            raise SourceError("ACTION_REFERENCE_INVALID", f"not a reference: {reference}") from None
        named = self.store.table("documents", self.number).where(F.col("id") == ident)
        row = named.select("path", "root_path", "size_bytes", "modified_at_ms", document_reference(F.col("id"), F.col("path")).alias("reference")).first()
        if row is None or row["reference"] != reference:
            raise SourceError("ACTION_REFERENCE_STALE", "the reference is out of date; search again")
        base = ownership_base(row["root_path"], [b for r, b in self.meta["ignore_scopes"] if r == row["root_path"]], row["path"])
        if not covers(base, row["path"], strictly=True):
            raise SourceError("ACTION_PATH_REJECTED", "the document isn't below its root")
        at = os.path.realpath(base)
        try:
            for step in os.path.relpath(row["path"], base).split(os.sep):
                at = os.path.join(at, step)
                if os.path.islink(at):
                    raise SourceError("ACTION_LINK_REJECTED", "the path leads through a link now; index it again")
            now = os.stat(at, follow_symlinks=False)
            if not stat.S_ISREG(now.st_mode):
                raise SourceError("ACTION_NOT_FILE", "it isn't a regular file any more")
            if not os.access(at, os.R_OK):
                raise PermissionError(at)
        except OSError:
            raise SourceError("ACTION_SOURCE_UNAVAILABLE", "the file isn't there or can't be read; index it again") from None
        return {"path": row["path"], "changed": (row["size_bytes"], row["modified_at_ms"]) != (now.st_size, now.st_mtime_ns / 1e6)}

    def changed_since(self, path: str) -> bool | None:
        """Whether a file differs from its indexed state; None if it isn't indexed or is gone."""
        row = self.store.table("documents", self.number).where(F.col("path") == path).select("size_bytes", "modified_at_ms").first()
        try:
            now = os.stat(path, follow_symlinks=False)
        except OSError:
            return None
        return None if row is None else (row["size_bytes"], row["modified_at_ms"]) != (now.st_size, now.st_mtime_ns / 1e6)
