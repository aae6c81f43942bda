"""Mapping jobs of a remote service as a stream: submit, poll and page, with the job of every chunk as keyed state.

A chunk of ids is submitted once; a timer polls its job until it is finished, failed, or was asked too often; its pages
are then read and answered id by id. The state holds the job's name and the ids, so a restarted stream goes on polling
the jobs it had and submits none again; only the calls of a batch that was broken off are made once more. The service
is an object of the caller's; none is built in."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..shared import numbered
from .suppression import ROCKSDB

CHUNKS = "chunk long, ids array<string>"
ANSWERS = "chunk long, id string, mapped string, status string"


class Service(Protocol):
    """What the caller provides; it must be picklable, and may raise for a call that can be made again."""

    def submit(self, ids: list[str]) -> str: ...

    def poll(self, job: str) -> str:
        """running, finished or failed."""

    def page(self, job: str, cursor: str | None, size: int) -> tuple[list[tuple[str, str]], str | None]:
        """Pairs of id and mapped id, and the cursor of the next page."""


def job_chunks(ids: DataFrame, size: int = 5000) -> DataFrame:
    """chunk, ids: the distinct ids of a table (`id`), in order, `size` of them a row."""
    rows = numbered(ids.select("id").filter("id IS NOT NULL").distinct(), "id")
    return rows.groupBy(F.floor((F.col("line") - 1) / size).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


class Jobs(StatefulProcessor):
    def __init__(self, service: Service, every: float, polls: int, page: int):
        self.service, self.every, self.polls, self.page = service, every, polls, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "name string, polls int, ids array<string>")

    def _later(self, now: float) -> None:
        self.handle.registerTimer(int((now + self.every) * 1000))

    def _answers(self, chunk: int, found: dict[str, list[str]], ids: list[str], otherwise: str) -> pd.DataFrame:
        rows = [(chunk, i, m, "ok") for i in ids for m in found.get(i, ())] + [(chunk, i, None, otherwise) for i in ids if i not in found]
        return pd.DataFrame(rows, columns=["chunk", "id", "mapped", "status"], dtype=object).astype({"chunk": "int64"})

    def _ask(self, chunk: int) -> Iterator[pd.DataFrame]:
        name, polls, ids = self.job.get()
        ids = list(ids)
        try:
            name = name or self.service.submit(ids)
            state = self.service.poll(name) if polls else "running"  # the first look is one interval after submitting
            found: dict[str, list[str]] = {}
            cursor, more = None, state == "finished"
            while more:
                rows, cursor = self.service.page(name, cursor, self.page)
                for i, m in rows:
                    found.setdefault(i, []).append(m)
                more = cursor is not None
        except Exception:
            state = "running"  # the call is made again, and counts
        if state == "running" and polls < self.polls:
            self.job.update((name, polls + 1, ids))
            self._later(time.time())
            return
        self.job.clear()
        yield self._answers(chunk, found if state == "finished" else {}, ids, "not_found" if state == "finished" else "error")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids = sorted({i for p in rows for own in p["ids"] for i in own})
        if not self.job.exists() and ids:
            self.job.update((None, 0, ids))
            yield from self._ask(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            yield from self._ask(key[0])

    def close(self) -> None:
        pass


def mapping_jobs(chunks: DataFrame, service: Service, every: float = 5.0, polls: int = 120, page: int = 500) -> DataFrame:
    """chunk, id, mapped, status (ok, not_found, error) of a stream of chunks. A job is polled every `every` seconds, at
    most `polls` times, and its answer read in pages of `page`."""
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship(chunks.sparkSession)
    return chunks.select("chunk", "ids").groupBy("chunk").transformWithStateInPandas(Jobs(service, every, polls, page), ANSWERS, "append", "ProcessingTime")
