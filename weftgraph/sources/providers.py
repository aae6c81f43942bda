"""Remote services behind callables: identifier mapping and annotation in batches, with a bounded cache.

A provider is any callable from a list of ids to a dict of results; none is built in, since the library opens
no network connection of its own.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NOT_FOUND, ERROR = "NOT_FOUND", "ERROR"


class Refused(Exception):
    """A batch the service will not take as it is; it is halved and tried again."""


def map_ids(ids: list[str], provider: Callable[[list[str]], dict], batch: int = 100) -> dict[str, str]:
    """Results for all ids: batches that are refused are split down to single ids; what is missing is
    NOT_FOUND, what fails alone is ERROR."""
    out: dict[str, str] = {}
    todo = [ids[i : i + batch] for i in range(0, len(ids), batch)][::-1]
    while todo:
        own = todo.pop()
        try:
            got = provider(own)
            out |= {i: got.get(i) or NOT_FOUND for i in own}
        except Refused:
            if len(own) == 1:
                out[own[0]] = ERROR
            else:
                todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return out


def map_table(ids: DataFrame, provider: Callable[[list[str]], dict], batch: int = 100, key: str = "id") -> DataFrame:
    """id, value of a table's ids, a partition at a time on the executors."""
    import pandas as pd

    from ..session import ship

    def run(batches):
        for b in batches:
            got = map_ids(b[key].tolist(), provider, batch)
            yield pd.DataFrame({key: b[key], "value": [got[i] for i in b[key]]})

    ship(ids.sparkSession)
    return ids.select(key).distinct().mapInPandas(run, f"{key} string, value string")


class Cache:
    """Results by id, for a time and up to a number; the least used go first."""

    def __init__(self, provider: Callable[[list[str]], dict], seconds: float = 3600, most: int = 10_000, clock=time.monotonic):
        self.provider, self.seconds, self.most, self.clock, self.held = provider, seconds, most, clock, OrderedDict()

    def get(self, ids: list[str]) -> dict:
        now = self.clock()
        fresh = {i: self.held[i][1] for i in ids if i in self.held and self.held[i][0] > now}
        want = [i for i in dict.fromkeys(ids) if i not in fresh]
        if want:
            got = self.provider(want)
            for i in want:
                if i in got:
                    self.held[i] = (now + self.seconds, got[i])
            fresh |= got
        for i in fresh:
            if i in self.held:
                self.held.move_to_end(i)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return fresh


def static_provider(spark: SparkSession, table: DataFrame, key: str, value: str, most: int = 1_000_000) -> Callable[[list[str]], dict]:
    """A provider over a small table; a larger one is joined instead."""
    rows = table.select(key, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("join a table of this size instead")
    held = {r[0]: r[1] for r in rows}
    return lambda ids: {i: held[i] for i in ids if i in held}
