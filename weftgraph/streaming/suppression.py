"""Events of files that we wrote ourselves are left out: for a time, and for a number of events.

Whoever writes a file leaves a note first, which is a file of its own in a folder of notes. Notes and events are
one stream, keyed by file name; the notes in force are state with a time to live, so they survive a restart."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .folder_events import EVENTS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OwnWrites(StatefulProcessor):
    """Per file name: until when, and how many more events are our own."""

    def __init__(self, seconds: float, events: int):
        self.seconds, self.events = seconds, events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "until double, left int", int(self.seconds * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))  # a batch holds one event of a file and its few notes
        held = self.held.get() if self.held.exists() else None
        until, left = (held[0], held[1]) if held else (0.0, 0)
        notes = got[got["event"] == "note"]
        if len(notes):
            written = float(notes["modified"].max()) / 1e6 + self.seconds
            until, left = max(until, written), self.events
        kept = []
        for row in got[got["event"] != "note"].itertuples(index=False):
            if left > 0 and time.time() < until:
                left -= 1
            else:
                kept.append(row)
        if left > 0 and time.time() < until:
            self.held.update((until, left))
        elif held:
            self.held.clear()
        yield pd.DataFrame(kept, columns=got.columns).astype({"modified": "Int64", "size": "Int64"})

    def close(self) -> None:
        pass


def without_own(events: DataFrame, notes: DataFrame, seconds: float = 300, number: int = 3) -> DataFrame:
    """The events of files, less those that a note of the same name accounts for. notes: name, modified."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    said = notes.select("name", F.lit("note").alias("event"), "modified", F.lit(None).cast("long").alias("size"))
    both = events.select("name", "event", "modified", "size").union(said)
    return both.groupBy("name").transformWithStateInPandas(OwnWrites(seconds, number), EVENTS, "append", "ProcessingTime")
