"""Networks that follow a folder of files: new and changed files replace their network, deleted ones drop it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog
from ..sources.readers import file_names
from .folder_events import folder_events
from .suppression import without_own


#: The state is one row for each file that we have written of late.
STATE_PARTITIONS = 4


def listed(catalog: Catalog, folder: str) -> DataFrame:
    """source of the files in a folder."""
    names = [(n,) for n in file_names(catalog.spark, folder) if n.endswith(".csv")]
    return catalog.spark.createDataFrame(names, "source string")


def kind_of(name: str) -> str | None:
    """What a file of the folder is: a network, attributes, taxonomy, or nothing of ours."""
    low = name.lower()
    return "network" if low.endswith(".csv") and "taxonom" not in low else "attributes" if low.endswith(".nodes.attr") else "taxonomy" if "taxonom" in low else None


class Folder:
    """What the events of a folder do: added and changed network files replace their network, deleted and emptied
    ones drop it, any event of an attribute file reads all of them anew, and `changed(kind, name)` is told of
    everything, so that caches can go. What cannot be stored is reported and stops nothing else."""

    def __init__(self, catalog: Catalog, folder: str, changed: Callable[[str, str], None] = lambda kind, name: None):
        self.catalog, self.folder, self.changed = catalog, folder, changed

    def start(self) -> None:
        """Drop the networks whose file went while nobody looked."""
        for r in self.catalog.orphans(listed(self.catalog, self.folder)).toLocalIterator():
            self.catalog.drop(r["source"])

    def _store(self, names: list[str]) -> None:
        """Replace the networks of these files in one commit; if one of them is refused, each by itself."""
        try:
            self.catalog.ingest_files([f"{self.folder}/{n}" for n in names])
        except Exception as e:
            if len(names) == 1:
                print(f"{names[0]} was not stored: {e}")
            for n in names if len(names) > 1 else ():
                self._store([n])

    def apply(self, events: dict[str, str]) -> None:
        """Do what a batch of events, by file name, asks for."""
        of = {kind: sorted(n for n in events if kind_of(n) == kind) for kind in ("network", "attributes", "taxonomy")}
        there = set(file_names(self.catalog.spark, self.folder))  # a file may have gone since
        stored = [n for n in of["network"] if events[n] != "deleted" and n in there]
        if stored:
            self._store(stored)
        gone = [n for n in of["network"] if n not in there]
        if gone:
            self.catalog.drop(*gone)
        if of["attributes"]:
            files = sorted(n for n in there if kind_of(n) == "attributes")
            try:
                if files:
                    self.catalog.ingest_attributes([f"{self.folder}/{n}" for n in files])
            except Exception as e:
                print(f"the attributes were not stored: {e}")
        for kind, names in of.items():
            for n in names:
                self.changed(kind, n)


def follow(
    catalog: Catalog, folder: str, checkpoint: str, once: bool = False, every: str = "1 second", settle: float = 2.0, own_seconds: float = 300, own_events: int = 3,
    changed: Callable[[str, str], None] = lambda kind, name: None, most: int = 10_000,
) -> StreamingQuery:
    """Start following. Micro-batches are serial; one that is repeated replaces the same networks again. A batch has
    at most `most` events of each stream, and what the driver sees of them is their names."""
    state = Folder(catalog, folder, changed)
    state.start()
    events = folder_events(catalog.spark, folder, settle, most)
    notes = folder_events(catalog.spark, catalog.notes_folder(), 0, most).filter("event = 'added'").select(F.substring_index("name", "~", -1).alias("name"), "modified")

    def store(batch: DataFrame, number: int) -> None:
        state.apply({r["name"]: r["event"] for r in batch.select("name", "event").collect()})

    writer = without_own(events, notes, own_seconds, own_events).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    conf, partitions = catalog.spark.conf, "spark.sql.shuffle.partitions"
    usual = conf.get(partitions)
    conf.set(partitions, str(STATE_PARTITIONS))  # of the state, which the query keeps; networks are stored with the usual number
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
    finally:
        conf.set(partitions, usual)


def latest_by_key(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Per key and day, the latest event: an aggregation with a watermark, for streams and tables alike."""
    x = events.withWatermark(at, late) if events.isStreaming else events
    return x.groupBy(key, F.window(at, "1 day").alias("day")).agg(F.max(at).alias("latest"), F.count(F.lit(1)).alias("events"))
