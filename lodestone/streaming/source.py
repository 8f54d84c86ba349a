"""File events from listings: a streaming source whose offsets are listings and whose rows are their differences.

Each bucket of a root's top folders is listed by a task of its own, which keeps the listing under the offset's number and gives what differs from the one before. A task that is run
again finds its listing there and gives the same rows.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import time
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.schema import EVENTS


class FolderEvents(DataSource):
    """format("folder_events"): options roots (JSON list), state (shared folder for listings), buckets (16), interval_ms (1000). The first listing gives no events."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> StructType:
        return EVENTS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderReader(self.options)


class Bucket(InputPartition):
    def __init__(self, root: str, number: int, start: int, end: int):
        self.root, self.number, self.start, self.end = root, number, start, end


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options["roots"])
        self.state, self.buckets, self.interval = options["state"], int(options.get("buckets", 16)), int(options.get("interval_ms", 1000)) / 1000
        self.last, self.at = None, 0.0

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The next listing's number, once the interval has passed."""
        os.makedirs(self.state, exist_ok=True)
        if self.last is None:  # goes on from the last listing that was begun
            self.last = max((int(n) for n in os.listdir(self.state) if n.isdigit()), default=0)
        if time.monotonic() - self.at >= self.interval:
            self.last, self.at = self.last + 1, time.monotonic()
            os.makedirs(os.path.join(self.state, str(self.last)), exist_ok=True)
        return {"listing": self.last}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        return [Bucket(root, k, start["listing"], end["listing"]) for root in self.roots for k in range(self.buckets)]

    def _path(self, bucket: Bucket, number: int) -> str:
        return os.path.join(self.state, str(number), f"{zlib.crc32(bucket.root.encode()):08x}-{bucket.number}.json")

    def _listing(self, bucket: Bucket, number: int) -> dict[str, list]:
        """{path: [size, time of change]} as it was listed for this number, or is now if it hasn't been."""
        path = self._path(bucket, number)
        with contextlib.suppress(FileNotFoundError), open(path, encoding="utf-8") as file:
            return json.load(file)
        found, todo = {}, []
        with os.scandir(bucket.root) as entries:
            top = [e for e in entries if zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % self.buckets == bucket.number]
        while top or todo:
            if not top:
                try:
                    with os.scandir(todo.pop()) as entries:
                        top = list(entries)
                except OSError:
                    continue
            for e in top:
                with contextlib.suppress(OSError):  # gone meanwhile
                    if e.is_dir(follow_symlinks=False):
                        todo.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        stat = e.stat(follow_symlinks=False)
                        found[e.path] = [stat.st_size, stat.st_mtime_ns]
            top = []
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{os.urandom(4).hex()}"
        with open(draft, "w", encoding="utf-8") as file:
            json.dump(found, file)
        with contextlib.suppress(FileExistsError):  # another attempt was first: its listing counts
            os.link(draft, path)
        os.unlink(draft)
        with open(path, encoding="utf-8") as file:
            return json.load(file)

    def read(self, partition: Bucket) -> Iterator[tuple]:
        if not os.path.isdir(partition.root):  # offline: nothing can be said
            return
        before = None
        if os.path.exists(self._path(partition, partition.start)):
            before = self._listing(partition, partition.start)
        now = self._listing(partition, partition.end)
        if before is None:
            return
        stamp = dt.datetime.fromtimestamp(os.stat(self._path(partition, partition.end)).st_mtime)
        for path in sorted(before.keys() | now.keys()):
            if before.get(path) != now.get(path):
                yield stamp, partition.root, path, "change" if path in now and path in before else "rename"

    def commit(self, end: dict) -> None:
        """Listings before the committed one aren't needed any more."""
        for name in os.listdir(self.state):
            if name.isdigit() and int(name) < end["listing"]:
                for file in os.listdir(os.path.join(self.state, name)):
                    with contextlib.suppress(OSError):
                        os.unlink(os.path.join(self.state, name, file))
                with contextlib.suppress(OSError):
                    os.rmdir(os.path.join(self.state, name))


def folder_events(spark, roots: list[str], state: str, **options):
    """A stream of file events (EVENTS) of folders that the driver and all executors can reach."""
    spark.dataSource.register(FolderEvents)
    reader = spark.readStream.format("folder_events").option("roots", json.dumps(roots)).option("state", state)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()
