"""Listing a folder tree: what an index of it looks at, and what it leaves out and why.

A large tree is listed on the executors, in rounds: each task walks its folders until it has found as many entries as a round allows, and hands what is still
open to the next round, which deals these folders to all tasks anew. A round allows twice as many as the one before, so rounds grow with the logarithm of the tree. Entries go to a table;
the driver sees counts only.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import BUILTIN_NAMES, BUILTIN_PREFIX, VOLUME_NAMES, IgnoreRule, ignore_rules
from lodestone.schema import LISTING
from lodestone.sources.parsers import extension_of
from lodestone.sources.tables import shared_dir
from lodestone.streaming.live import IGNORE_FILE

#: Classes of entries that are left out.
SKIPPED = ("builtin", "ignored", "link", "other")
#: Entries that a task of the first round lists before it hands on what is still open.
ROUND_ENTRIES = 20_000
_ENTRY = "kind string, path string, filename string, extension string, size_bytes long, modified_at_ms double, note string"


@dataclass
class Listing:
    """files: (path, filename, extension, size, time of change in fractional ms), by path. skipped: entries left out, by class."""

    files: list[tuple] = field(default_factory=list)
    diagnostics: list[tuple] = field(default_factory=list)
    protected: list[str] = field(default_factory=list)
    skipped: Counter = field(default_factory=Counter)


def read_rules(folder: str, ignore_file: str = IGNORE_FILE) -> list[IgnoreRule]:
    """Rules of a folder's ignore file; none if there isn't one. Raises OSError if it can't be read."""
    path = os.path.join(folder, ignore_file)
    if not os.path.lexists(path):
        return []
    with open(path, encoding="utf-8-sig") as file:
        return ignore_rules(file.read())


@dataclass(frozen=True)
class Walker:
    """What holds for all folders of a root: rules by base, own artifacts, and whether it is a Windows volume. It is sent to the tasks."""

    root: str
    rules: tuple[tuple[str, tuple[IgnoreRule, ...]], ...]
    own: frozenset[str]
    windows_volume: bool = False

    @classmethod
    def of(cls, root: str, extra_bases: list[str] = (), artifacts: list[str] = (), windows_volume: bool = False, ignore_file: str = IGNORE_FILE) -> Walker:
        rules = tuple((base, tuple(read_rules(base, ignore_file))) for base in dict.fromkeys([root, *extra_bases]))
        return cls(root, rules, frozenset(os.path.realpath(a) for a in artifacts), windows_volume)

    def left_out(self, path: str, name: str, folder: bool, top: bool) -> str | None:
        if name in BUILTIN_NAMES or name.lower() in BUILTIN_NAMES or name.startswith(BUILTIN_PREFIX) or (self.windows_volume and top and name.lower() in VOLUME_NAMES) or path in self.own:
            return "builtin"
        for base, some in self.rules:
            if some and path.startswith(base.rstrip("/") + "/"):
                relative = os.path.relpath(path, base)
                if any(r.matches(relative, folder) for r in some):
                    return "ignored"
        return None

    def begin(self, start: str) -> Iterator[tuple]:
        """The entries that a scope stands for: itself, if it is a folder, as an open one; nothing if it is gone for certain; an error if that can't be told."""
        if start != self.root and not start.startswith(self.root.rstrip("/") + "/"):
            return
        steps = [p for p in os.path.relpath(start, self.root).split(os.sep) if p != "."]
        for k in range(len(steps)):  # below an excluded folder there is nothing
            path = os.path.join(self.root, *steps[: k + 1])
            if why := self.left_out(path, steps[k], k + 1 < len(steps) or os.path.isdir(start), k == 0):
                yield _entry(why, path)
                return
        if os.path.isdir(start) and not os.path.islink(start):
            yield _entry("open", start)
        elif os.path.lexists(start):
            with os.scandir(os.path.dirname(start)) as found:
                for e in found:
                    if e.name == os.path.basename(start):
                        yield from self.looked_at(e, os.path.dirname(start))
        elif not os.path.isdir(self.root):
            yield _entry("error", start, "the root can't be reached")
        else:  # gone, if the folder that it was in can be read, or is gone from one that can
            above = os.path.dirname(start)
            while above != self.root and not os.path.lexists(above):
                above = os.path.dirname(above)
            try:
                os.scandir(above).close()
            except OSError as error:
                yield _entry("error", start, error.strerror or "OSError")

    def looked_at(self, e: os.DirEntry, folder: str) -> Iterator[tuple]:
        is_folder = e.is_dir(follow_symlinks=False)
        if why := self.left_out(e.path, e.name, is_folder, folder == self.root):
            yield _entry(why, e.path)
        elif e.is_symlink():
            yield _entry("link", e.path)
        elif is_folder:
            yield _entry("open", e.path)
        elif not e.is_file(follow_symlinks=False):
            yield _entry("other", e.path)
        else:
            try:
                stat = e.stat(follow_symlinks=False)
                yield "file", e.path, e.name, extension_of(e.name), stat.st_size, stat.st_mtime_ns / 1e6, None
            except OSError as error:
                yield _entry("error", e.path, error.strerror or "OSError")

    def walk(self, scopes: list[tuple[str, bool]], most: int | None = None) -> Iterator[tuple]:
        """Entries in and below the scopes (path, whether it comes from an earlier round). After ``most`` entries, folders that are left come as open ones."""
        todo: list[str] = []
        found = 0

        def keep(rows: Iterator[tuple]) -> Iterator[tuple]:
            nonlocal found
            for row in rows:
                if row[0] == "open":
                    todo.append(row[1])
                else:
                    found += 1
                    yield row

        for path, known in scopes:
            if known:
                todo.append(path)
            else:
                yield from keep(self.begin(path))
        while todo:
            if most is not None and found >= most:
                yield from (_entry("open", path) for path in todo)
                return
            folder = todo.pop()
            try:
                with os.scandir(folder) as listed:
                    entries = sorted(listed, key=lambda e: e.name)
            except OSError as error:
                yield _entry("error", folder, error.strerror or "OSError")
                continue
            for e in entries:
                yield from keep(self.looked_at(e, folder))


def _entry(kind: str, path: str, note: str | None = None) -> tuple:
    return kind, path, None, None, None, None, note


def scan(root: str, *, start: str | None = None, extra_bases: list[str] = (), artifacts: list[str] = (), windows_volume: bool = False, ignore_file: str = IGNORE_FILE) -> Listing:
    """Regular files below ``start`` (the root if not given), listed by this process. Links aren't followed. Folders that can't be read become protected scopes.

    Rules of the root's ignore file and of further folders (roots that were merged into this one) hold for what lies below each. An entry that is
    left out counts once, in the first class that applies: builtin, ignored, link, other.
    """
    root = os.path.realpath(root)
    walker = Walker.of(root, extra_bases, artifacts, windows_volume, ignore_file)
    out = Listing()
    for kind, path, *rest, note in walker.walk([(os.path.realpath(start) if start else root, False)]):
        if kind == "file":
            out.files.append((path, *rest))
        elif kind == "error":
            out.protected.append(path)
            out.diagnostics.append(("scan", path, note, note))
        else:
            out.skipped[kind] += 1
    out.files.sort(key=lambda f: f[0].encode("utf-16-be", "surrogatepass"))
    return out


@dataclass
class Scan:
    """What the executors found, as a table; counts by kind are all that the driver has."""

    entries: DataFrame
    counts: dict[str, int]
    folder: str

    @property
    def files(self) -> DataFrame:
        return self.entries.where("kind = 'file'").select(*LISTING.names)

    @property
    def protected(self) -> DataFrame:
        return self.entries.where("kind = 'error'").select("path")

    @property
    def diagnostics(self) -> DataFrame:
        return self.entries.where("kind = 'error'").select(F.lit("scan").alias("stage"), "path", F.col("note").alias("code"), F.col("note").alias("message"))

    @property
    def skipped(self) -> dict[str, int]:
        return {k: self.counts[k] for k in SKIPPED if self.counts.get(k)}


def scan_tree(spark: SparkSession, root: str, scopes: list[str] | None = None, *, extra_bases: list[str] = (), artifacts: list[str] = (), windows_volume: bool | None = None, most: int = ROUND_ENTRIES) -> Scan:
    """As scan(), of a tree that all executors can reach, listed by them. ``scopes``: files and folders of the root to look at (None: the root); those that are gone give nothing, or an error
    (a protected scope) where the root or the folder that they were in can't be read. Whether the root is a Windows volume shows in its names, if it isn't said."""
    if windows_volume is None:
        windows_volume = os.path.isdir(os.path.join(root, "System Volume Information"))
    walker = Walker.of(root, extra_bases, artifacts, windows_volume)
    names = [x.split()[0] for x in _ENTRY.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        starts = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        rows: list[tuple] = []
        for row in walker.walk(starts, most):
            rows.append(row)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    folder = f"{shared_dir(spark)}/lodestone/listing-{os.urandom(8).hex()}"
    open_ = spark.createDataFrame([(p, False) for p in (scopes or [root])], "path string, known boolean").coalesce(1 if not scopes or len(scopes) < 100 else 16)
    counts: Counter = Counter()
    number = 0
    while True:
        seen = Observation()
        count = [F.count_if(F.col("kind") == k).alias(k) for k in ("file", "error", "open", *SKIPPED)]
        open_.mapInArrow(partial(run, most=most << number), _ENTRY).observe(seen, *count).write.parquet(f"{folder}/round={number}")
        found = Counter(seen.get)
        counts += Counter({k: n for k, n in found.items() if k != "open"})
        if not found["open"]:
            break
        left = spark.read.schema(_ENTRY).parquet(f"{folder}/round={number}").where("kind = 'open'")
        open_ = left.select("path", F.lit(True).alias("known")).repartition(max(1, min(found["open"], 4 * spark.sparkContext.defaultParallelism)), "path")
        number += 1
    return Scan(spark.read.schema(_ENTRY).parquet(*(f"{folder}/round={k}" for k in range(number + 1))).where("kind <> 'open'"), dict(counts), folder)
