"""What waits for silence: items of a key are handed on together once no more have come for a while.

A watched folder is scanned when its files have settled, and a model is trained again when enough new votes are there
and nobody is voting.  Both are keyed state with an event-time timer: rows of a key move its timer, and the timer's end,
when the watermark passes it, gives the batch once.  State lives in the state store (RocksDB, on each executor, with a
changelog in the checkpoint folder), so a lost executor or a restart neither loses a batch nor gives it twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.sources.tables import workers_import

BATCH = "key string, item string, items long, last timestamp"


class Silence(StatefulProcessor):
    """Holds each item of a key once until ``quiet_ms`` have passed without rows, and at least ``least`` are there."""

    def __init__(self, quiet_ms: int, least: int):
        self.quiet_ms, self.least = quiet_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", "at timestamp")
        self.last = handle.getValueState("last", "last timestamp, timer long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, timer, n = self.last.get() if self.last.exists() else (None, None, 0)
        if timer is not None and timer <= timerValues.getCurrentWatermarkInMs() and n >= self.least:
            yield from self._batch(key, last, n)  # its silence was over before these rows came
            self.handle.deleteTimer(timer)
            last, timer, n = None, None, 0
        for pdf in rows:
            for item, at in zip(pdf["item"], pdf["at"], strict=True):
                at = pd.Timestamp(at).to_pydatetime()
                n += not self.items.containsKey((item,))
                self.items.updateValue((item,), (at,))
                last = at if last is None or at > last else last
        due = int(pd.Timestamp(last).timestamp() * 1000) + self.quiet_ms
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.last.update((last, due, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, n = self.last.get()
        if n < self.least:  # too few: they stay, and the next row sets the timer again
            self.last.update((last, None, n))
            return
        yield from self._batch(key, last, n)

    def _batch(self, key, last, n: int) -> Iterator[pd.DataFrame]:
        found = sorted(k[0] for k in self.items.keys())
        self.items.clear()
        self.last.clear()
        for at in range(0, len(found), 10_000):
            part = found[at : at + 10_000]
            yield pd.DataFrame({"key": [key[0]] * len(part), "item": part, "items": [n] * len(part), "last": [last] * len(part)})

    def close(self) -> None:
        pass


def settled(events: DataFrame, key: str, item: str, ts: str, quiet: float, least: int = 1, lateness: str = "0 seconds") -> DataFrame:
    """Rows (key, item, items: how many together, last: time of the newest) of every batch, after ``quiet`` seconds of
    silence by event time, if at least ``least`` items are there.

    Keys are watched folders or scopes of votes; a null key is the empty one.  For append mode; the session's state store
    must be RocksDB (``use_timers``)."""
    workers_import(events.sparkSession)
    rows = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(item).cast("string").alias("item"), F.col(ts).alias("at")).where("item is not null and at is not null")
    return rows.withWatermark("at", lateness).groupBy("key").transformWithStateInPandas(Silence(int(quiet * 1000), least), outputStructType=BATCH, outputMode="append", timeMode="eventTime")


def use_timers(spark) -> None:
    """State stores with timers, for queries that start from here on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
