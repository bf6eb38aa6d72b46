"""One output for a burst of changes: a key is flushed when nothing has come for it for a while.

Each change moves the key's timer; when it ends, one row tells of the burst, and the key's state goes. State
and timers are in the checkpoint, so a burst that was open when the stream stopped is flushed after the
restart. A change marked urgent flushes at once, as does a burst of `most` changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestone.streaming.enrich import ROCKSDB

OUT = "key string, changes long, first_id string, last_id string, reason string"


class Debouncer(StatefulProcessor):
    def __init__(self, delay_ms: int, most: int | None):
        self.delay, self.most = delay_ms, most

    def init(self, handle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "changes long, first_id string, last_id string, due long")

    def _flushed(self, key, changes: int, first: str, last: str, reason: str) -> Row:
        self.burst.clear()
        return Row(key=key[0], changes=changes, first_id=first, last_id=last, reason=reason)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = sorted((r["id"], bool(r["urgent"])) for r in rows)
        held = self.burst.get() if self.burst.exists() else None
        changes, first = len(seen), seen[0][0]
        if held:
            changes, first = changes + held[0], min(first, held[1])
            self.handle.deleteTimer(held[3])
        last = max(seen[-1][0], held[2]) if held else seen[-1][0]
        if any(u for _, u in seen):
            return iter([self._flushed(key, changes, first, last, "urgent")])
        if self.most and changes >= self.most:
            return iter([self._flushed(key, changes, first, last, "full")])
        due = timerValues.getCurrentProcessingTimeInMs() + self.delay
        self.handle.registerTimer(due)
        self.burst.update((changes, first, last, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.burst.exists():
            return iter(())
        changes, first, last, due = self.burst.get()
        if due > expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        return iter([self._flushed(key, changes, first, last, "quiet")])

    def close(self) -> None:
        pass


def flushes(stream: DataFrame, delay_ms: int = 15_000, most: int | None = None) -> DataFrame:
    """`stream` has key, id (a string; the least and the largest of a burst are told) and urgent. Null
    keys are a key. Needs the RocksDB state store and a trigger that goes on without data."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select(F.col("key").cast("string").alias("key"), F.col("id").cast("string").alias("id"), F.coalesce("urgent", F.lit(False)).alias("urgent"))
    return rows.groupBy("key").transformWithState(statefulProcessor=Debouncer(delay_ms, most), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
