"""A folder as a stream: a row for every file that is added, changed or deleted.

The offset of the stream is a listing, the time and size of every file, so a batch is the difference of two
listings, can be planned again after a failure, and a restarted stream goes on from the listing it had seen. A file
takes part once it has settled: its time and size have stood still for `settle` seconds. Only names travel here;
files are read by whoever follows the stream."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship

FORMAT = "folder_events"
EVENTS = "name string, event string, modified long, size long"
#: Events of one task.
CHUNK = 1000


def listing(path: str) -> dict[str, str]:
    """`time:size` of every file of a folder, by name; a folder that is not there is empty."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = where.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return {f.base_name: f"{f.mtime_ns}:{f.size}" for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name[0] not in "._"}


def difference(start: dict[str, str], end: dict[str, str]) -> list[tuple[str, str, int, int]]:
    """The events between two listings, by name. An empty stamp stands for a file that has not settled."""
    out = []
    for name in sorted(start.keys() | end.keys()):
        old, new = start.get(name), end.get(name)
        if new is None:
            out.append((name, "deleted", None, None))
        elif new and new != old:
            at, size = map(int, new.split(":"))
            out.append((name, "added" if old is None else "changed", at // 1000, size))
    return out


class Changes(InputPartition):
    def __init__(self, events: list[tuple]):
        super().__init__(events)


class FolderReader(DataSourceStreamReader):
    """Options: path; settle, in seconds; most, the events of one batch."""

    def __init__(self, options: dict[str, str]):
        self.path, self.settle, self.most = options["path"], float(options.get("settle", "2")), int(options.get("most", "10000"))
        self.before: dict[str, str] | None = None  # what the offset was, if this reader has been told
        self.watched: dict[str, tuple[str, float]] = {}

    def initialOffset(self) -> dict:
        self.before = {}
        return {}

    def latestOffset(self) -> dict:
        found, now = listing(self.path), time.monotonic()
        self.watched = {n: self.watched[n] if n in self.watched and self.watched[n][0] == s else (s, now) for n, s in found.items()}
        known, out, changes = self.before, {}, 0
        for name, stamp in found.items():
            age = max(time.time() - int(stamp.split(":")[0]) / 1e9, now - self.watched[name][1])
            if known is not None and known.get(name) == stamp:
                out[name] = stamp
            elif age >= self.settle and changes < self.most:
                out[name] = stamp
                changes += 1
            elif known is None:
                out[name] = ""  # it is there, and its next stamp counts as a change
            elif name in known:
                out[name] = known[name]
        for name in (known or {}).keys() - found.keys():
            if changes >= self.most:
                out[name] = known[name]
            changes += 1
        self.before = out
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.before is None:
            self.before = dict(end)
        events = difference(start, end)
        return [Changes(events[i : i + CHUNK]) for i in range(0, len(events), CHUNK)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.value


class FolderEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(self.options)


def folder_events(spark: SparkSession, folder: str, settle: float = 2.0, most: int = 10_000):
    """The stream of a folder's events: name, event (added, changed or deleted), modified (microseconds), size."""
    ship(spark)
    spark.dataSource.register(FolderEvents)
    return spark.readStream.format(FORMAT).option("settle", str(settle)).option("most", str(most)).load(folder)
