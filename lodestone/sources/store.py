"""Versioned snapshots of an index: Parquet tables in parts by document, and manifests that come into being at once.

A commit writes only the parts whose documents changed; the manifest of a snapshot says for each part in which commit it was written. A snapshot is the one after
that it was made from, and its manifest can be created once, so of two writers that began with the same snapshot one fails. Parts double in number when the largest has grown too large.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import socket
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schema as S
from lodestone.operators.candidates import document_postings

#: The version of the layout, and seconds between tries for the writer's lock.
FORMAT_VERSION = 3
LOCK_BACKOFF = (1, 2, 5, 10, 30)
KEPT_SNAPSHOTS = 4
#: Parts of a new index, and bytes of a part's blocks from which the next commit doubles the number of parts.
PARTS, PART_BYTES = 8, 256 << 20
#: Bytes of written blocks whose postings a task makes.
POSTED_BYTES = 16 << 20
#: Seconds after which a lock of another host counts as given up. Its holder renews it as long as it lives.
LEASE_SECONDS = 600

POSTINGS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("document_id", T.LongType())])
TABLES = {"documents": S.DOCUMENTS, "blocks": S.BLOCKS, "postings": POSTINGS}
#: By table: the column that names the document, and the order within a part.
_KEYS = {"documents": ("id", ["id"]), "blocks": ("document_id", ["document_id", "ordinal"])}


class LockedError(RuntimeError):
    """Another process is writing."""


class SnapshotChanged(RuntimeError):
    """The index has changed since a result was made."""


class FormatError(RuntimeError):
    """The index was written by a later version."""


class Store:
    """An index folder: tables/<table>/<commit>/part=<k>, snapshots/<number>.json and writer.lock. Readers stay on the snapshot that they began with."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS, part_bytes: int = PART_BYTES):
        self.spark, self.folder, self._parts, self.part_bytes = spark, os.path.abspath(folder), parts, part_bytes
        os.makedirs(os.path.join(self.folder, "snapshots"), exist_ok=True)

    def current(self) -> int:
        """The number of the current snapshot, 0 if there is none."""
        return max(self._numbers(), default=0)

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in os.listdir(os.path.join(self.folder, "snapshots")) if re.fullmatch(r"\d{8}\.json", n))

    def _manifest_path(self, number: int) -> str:
        return os.path.join(self.folder, "snapshots", f"{number:08d}.json")

    def manifest(self, number: int) -> dict:
        """{meta, parts, tables: {table: {part: commit}}} of a snapshot. Layouts of a later version are refused, those of earlier ones brought up to date as they are read."""
        if not number:
            return {"meta": {"format": FORMAT_VERSION, "roots": {}, "ignore_scopes": [], "history": []}, "parts": self._parts, "tables": {name: {} for name in TABLES}, "posted": []}
        with open(self._manifest_path(number), encoding="utf-8") as file:
            found = json.load(file)
        if found["meta"]["format"] > FORMAT_VERSION:
            raise FormatError(f"layout {found['meta']['format']} is later than {FORMAT_VERSION}")
        return upgraded(found)

    def meta(self, number: int | None = None) -> dict:
        return self.manifest(self.current() if number is None else number)["meta"]

    def record(self, base: int, meta: dict) -> int:
        """The snapshot after ``base`` with another meta and the same tables: a manifest and nothing else is written."""
        found = self.manifest(base)
        return self._publish(base, found | {"meta": meta | {"format": found["meta"]["format"]}})

    def _write(self, manifest: dict, path: str, place: Callable[[str, str], None]) -> None:
        draft = f"{path}.{socket.gethostname()}.{os.getpid()}"
        with open(draft, "w", encoding="utf-8") as file:
            json.dump(manifest, file, ensure_ascii=False)
            file.flush()
            os.fsync(file.fileno())
        try:
            place(draft, path)
        finally:
            if os.path.lexists(draft):
                os.unlink(draft)

    def unposted(self, number: int) -> list[int]:
        """Parts of a snapshot that have documents but no postings yet: those that an earlier layout has written."""
        found = self.manifest(number)
        return sorted(int(p) for p in set(found["tables"]["documents"]) - set(found["posted"]))

    def format_status(self) -> dict:
        """The layout of the current snapshot, the one that is written now, and how many parts an upgrade still has to write."""
        number = self.current()
        if not number:
            return {"format": None, "current": FORMAT_VERSION, "pending": [], "pending_parts": 0, "parts": 0}
        found, left = self.manifest(number), self.unposted(number)
        return {"format": found["meta"]["format"], "current": FORMAT_VERSION, "pending": ["postings"] if left else [], "pending_parts": len(left), "parts": len(found["tables"]["documents"])}

    def table(self, name: str, number: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """A table of a snapshot, or the given parts of it."""
        manifest = self.manifest(self.current() if number is None else number)
        at = manifest["tables"][name]
        paths = [self._part_path(name, commit, int(part)) for part, commit in sorted(at.items()) if parts is None or int(part) in parts]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _part_path(self, name: str, commit: int | str, part: int) -> str:
        return os.path.join(self.folder, "tables", name, _commit_name(commit), f"part={part}")

    def part_of(self, ident: Column, number: int | None = None) -> Column:
        """The part in which a document lies."""
        return F.pmod(F.xxhash64(ident.cast("long")), F.lit(self.manifest(self.current() if number is None else number)["parts"])).cast("int")

    @contextmanager
    def writing(self, wait: bool = False) -> Iterator[None]:
        """Holds the writer's lock. Without ``wait`` a held lock is an error at once; locks of processes that are gone, or of other hosts and not renewed for LEASE_SECONDS, are taken over.

        The lock spares writers work that would be in vain; should it fail, the manifest that can be created only once still keeps commits apart.
        """
        path = os.path.join(self.folder, "writer.lock")
        pauses = list(LOCK_BACKOFF if wait else ())
        while not self._take(path):
            if self._abandoned(path):
                continue
            if not pauses:
                raise LockedError(f"{path} is held")
            time.sleep(pauses.pop(0))
        over = threading.Event()
        renewal = threading.Thread(target=self._renew, args=(path, over), daemon=True)
        renewal.start()
        try:
            yield
        finally:
            over.set()
            renewal.join()
            with suppress(FileNotFoundError):
                os.unlink(path)

    @staticmethod
    def _renew(path: str, over: threading.Event) -> None:
        while not over.wait(LEASE_SECONDS / 5):
            with suppress(OSError):
                os.utime(path)

    @staticmethod
    def _take(path: str) -> bool:
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        os.write(handle, json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "at": time.time()}).encode())
        os.close(handle)
        return True

    @classmethod
    def _abandoned(cls, path: str) -> bool:
        """Removes the lock if its owner is gone. Only one process at a time may judge, so none removes a lock that another has just taken."""
        judge = path + ".judge"
        if not cls._take(judge):
            with suppress(OSError):  # one that was killed while it judged
                if time.time() - os.stat(judge).st_mtime > 60:
                    os.unlink(judge)
            return False
        try:
            with open(path, encoding="utf-8") as file:
                owner = json.loads(file.read() or "0")
            owner = owner if isinstance(owner, dict) else {"host": socket.gethostname(), "pid": int(owner), "at": time.time()}
            if owner["host"] == socket.gethostname():
                gone = False
                try:
                    os.kill(owner["pid"], 0) if owner["pid"] else None
                except ProcessLookupError:
                    gone = True
                except PermissionError:
                    pass
            else:
                gone = time.time() - os.stat(path).st_mtime > LEASE_SECONDS
            if gone:
                os.unlink(path)
            return gone
        except FileNotFoundError:
            return True
        except (OSError, ValueError, KeyError):
            return False
        finally:
            os.unlink(judge)

    def commit(self, documents: DataFrame, blocks: DataFrame, meta: dict, parts: list[int] | None = None, *, base: int | None = None) -> int:
        """Writes the snapshot after ``base`` (the current one) and makes it current, or raises SnapshotChanged if another writer was first. ``parts``: those in which something has
        changed (None: all); of the others the files of the snapshot before stay.

        Blocks lie sorted by document; postings are worked out from the blocks as written and lie sorted by gram in each file. If a part has grown beyond ``part_bytes``, all are written anew, twice as many.
        """
        base = self.current() if base is None else base
        before = self.manifest(base)
        count = before["parts"]
        if self.largest_part(base) > self.part_bytes:  # the cost of doubling is spread over the commits that led to it
            count, parts, touched_before = 2 * count, None, parts
            others = sorted({int(p) for p in before["tables"]["blocks"]} - set(touched_before)) if touched_before is not None else []
            blocks = blocks.unionByName(self.table("blocks", base, others)) if others else blocks
        attempt = os.urandom(4).hex()
        touched = set(range(count)) if parts is None else set(parts)
        tables = {name: {p: c for p, c in before["tables"].get(name, {}).items() if int(p) not in touched} for name in TABLES}
        some = None if parts is None else sorted(touched)
        with ThreadPoolExecutor(2) as both:  # two jobs that don't wait for each other
            jobs = {name: both.submit(self._write_parts, name, df, f"{base + 1:08d}-{attempt}", count, some) for name, df in (("documents", documents.select(*S.DOCUMENTS.names)), ("blocks", blocks.select(*S.BLOCKS.names)))}
        for name, job in jobs.items():
            tables[name] |= job.result()
        tables["postings"] |= self._write_postings(tables["blocks"], f"{base + 1:08d}-{attempt}", count)
        posted = sorted((set(before["posted"]) - {str(p) for p in touched}) | {p for p in tables["documents"] if int(p) in touched})
        left = set(tables["documents"]) - set(posted)
        return self._publish(base, {"meta": meta | {"format": before["meta"]["format"] if left else FORMAT_VERSION}, "parts": count, "tables": tables, "posted": posted})

    def _write_parts(self, name: str, df: DataFrame, commit: str, count: int, parts: list[int] | None) -> dict[str, str]:
        ident, order = _KEYS[name]
        path = os.path.join(self.folder, "tables", name, commit)
        placed = df.withColumn("part", F.pmod(F.xxhash64(F.col(ident)), F.lit(count)).cast("int"))
        if parts is not None:
            placed = placed.where(F.col("part").isin(*parts) if parts else F.lit(False))
        # parts are dealt to as many tasks as their size asks for, so a part may come in several files
        placed.hint("rebalance", F.col("part")).sortWithinPartitions("part", *order).write.partitionBy("part").parquet(path)
        return {n[5:]: commit for n in os.listdir(path) if n.startswith("part=")}

    def _write_postings(self, blocks: dict[str, str], commit: str, count: int) -> dict[str, str]:
        return self._post([self._part_path("blocks", c, int(p)) for p, c in blocks.items() if c == commit], commit, count)

    def _post(self, written: list[str], commit: str, count: int) -> dict[str, str]:
        """Writes postings of parts of blocks. Texts are dealt by document to a few tasks for each part, where their postings are made, sorted and written: only texts are shuffled."""
        if not written:
            return {}
        size = max(sum(e.stat().st_size for e in os.scandir(p)) for p in written)
        tasks = count * max(1, -(-size // POSTED_BYTES))  # a multiple, so that each task has documents of one part
        number = lambda n: F.pmod(F.xxhash64("document_id"), F.lit(n)).cast("int")
        texts = self.spark.read.schema(S.BLOCKS).parquet(*written).select("document_id", "norm_heading", "norm_content")
        posted = document_postings(texts.repartitionById(tasks, number(tasks))).withColumn("part", number(count))
        path = os.path.join(self.folder, "tables", "postings", commit)
        posted.sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(path)
        return {n[5:]: commit for n in os.listdir(path) if n.startswith("part=")}

    def upgrade(self, batch: int = 4, most: int | None = None) -> int:
        """Writes postings for parts of an earlier layout, ``batch`` parts to a commit, and returns how many are left. Each commit is kept, so an upgrade that ends half-way goes on where it was.
        ``most``: commits at most."""
        done = 0
        while True:
            with self.writing(wait=True):
                base = self.current()
                left = self.unposted(base) if base else []
                if not left or (most is not None and done >= most):
                    return len(left)
                found, some, commit = self.manifest(base), left[:batch], f"{base + 1:08d}-{os.urandom(4).hex()}"
                paths = [self._part_path("blocks", c, int(p)) for p, c in found["tables"]["blocks"].items() if int(p) in some]
                made = self._post(paths, commit, found["parts"])
                posted = sorted({*found["posted"], *map(str, some)})
                meta = found["meta"] | {"format": found["meta"]["format"] if len(left) > len(some) else FORMAT_VERSION}
                self._publish(base, {"meta": meta, "parts": found["parts"], "tables": found["tables"] | {"postings": found["tables"]["postings"] | made}, "posted": posted})
                done += 1

    def largest_part(self, number: int) -> int:
        """Bytes of the largest part of a snapshot's blocks."""
        at = self.manifest(number)["tables"]["blocks"]
        sizes = [sum(e.stat().st_size for e in os.scandir(self._part_path("blocks", commit, int(part)))) for part, commit in at.items()]
        return max(sizes, default=0)

    def _publish(self, base: int, manifest: dict) -> int:
        """Creates the manifest after ``base``; a link to a finished file is there as a whole or not at all, and only once."""
        try:
            self._write(manifest, self._manifest_path(base + 1), os.link)
        except FileExistsError:
            raise SnapshotChanged("another commit came first") from None
        self._clean()
        return base + 1

    def _clean(self) -> None:
        """Drops the oldest snapshots and the parts that only they name, and parts of commits that failed; the last KEPT_SNAPSHOTS stay for their readers."""
        numbers = self._numbers()
        for number in numbers[:-KEPT_SNAPSHOTS]:
            os.unlink(self._manifest_path(number))
        used = set()
        for number in numbers[-KEPT_SNAPSHOTS:]:
            with open(self._manifest_path(number), encoding="utf-8") as file:
                used |= {(table, _commit_name(commit), int(part)) for table, at in json.load(file)["tables"].items() for part, commit in at.items()}
        for table in TABLES:
            top = os.path.join(self.folder, "tables", table)
            for commit in os.listdir(top) if os.path.isdir(top) else []:
                if int(commit[:8]) > numbers[-1]:
                    continue  # of a writer that is still at work
                inside = os.path.join(top, commit)
                left = [n for n in os.listdir(inside) if n.startswith("part=")]
                for n in left:
                    if (table, commit, int(n[5:])) not in used:
                        shutil.rmtree(os.path.join(inside, n), ignore_errors=True)
                if not any((table, commit, int(n[5:])) in used for n in left):
                    shutil.rmtree(inside, ignore_errors=True)

    def artifacts(self) -> list[str]:
        """Paths that a listing leaves out."""
        return [self.folder]


def _commit_name(commit: int | str) -> str:
    """The folder of a commit; earlier layouts had numbers."""
    return f"{commit:08d}" if isinstance(commit, int) else commit


def upgraded(manifest: dict) -> dict:
    """A manifest of an earlier layout as one of this. Layout 2 had no postings, and its meta may lack keys; which parts have theirs wasn't said before layout 4, so those count that have files."""
    meta = {"roots": {}, "ignore_scopes": [], "history": []} | manifest["meta"]
    tables = {name: manifest["tables"].get(name, {}) for name in TABLES}
    return manifest | {"meta": meta, "tables": tables, "posted": manifest.get("posted", sorted(tables["postings"]))}
