"""A feed put together from numbered events that arrive late, twice, or out of order, caught up over restarts.

State by key is kept by Spark (RocksDB) and changed in place: the cursor (all numbers up to it are delivered), the events that wait
behind an open gap, and for `remember_ms` the digests of what was delivered, so that a replay with other content is told. So it is bounded by
the open gaps and by what arrives within that time, not by the length of the feed; older replays are told as replays, unseen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, number bigint, content string, outcome string"
_COLUMNS = ["key", "number", "content", "outcome"]
#: What a merge needs of the session: keyed map state, and an end of a run although timers are open.
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _digest(content: str) -> str:
    return hashlib.blake2b(content.encode(), digest_size=16).hexdigest()


class _Merge(StatefulProcessor):
    def __init__(self, remember_ms: int, patience_ms: int):
        self.remember_ms, self.patience_ms = remember_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "n bigint")
        self.waiting = handle.getMapState("waiting", "n bigint", "content string")
        self.recent = handle.getMapState("recent", "n bigint", "digest string", ttlDurationMs=self.remember_ms)

    def _at(self) -> int:
        return self.cursor.get()[0] if self.cursor.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cursor = began = self._at()
        behind = False
        for frame in rows:
            out = []
            frame = frame.sort_values(["number", "content"])
            for n, content in zip(frame["number"].tolist(), frame["content"].tolist()):
                if n <= cursor:
                    known = self.recent.getValue((n,)) if self.recent.containsKey((n,)) else None
                    out.append((key[0], n, content, "conflict" if known and known[0] != _digest(content) else "replay"))
                elif self.waiting.containsKey((n,)):
                    out.append((key[0], n, content, "replay" if self.waiting.getValue((n,))[0] == content else "conflict"))
                elif n > cursor + 1:
                    self.waiting.updateValue((n,), (content,))
                    behind = True
                else:
                    cursor = n
                    self.recent.updateValue((n,), (_digest(content),))
                    out.append((key[0], n, content, "delivered"))
                    while self.waiting.containsKey((cursor + 1,)):  # all that waited for it
                        cursor += 1
                        content = self.waiting.getValue((cursor,))[0]
                        self.waiting.removeKey((cursor,))
                        self.recent.updateValue((cursor,), (_digest(content),))
                        out.append((key[0], cursor, content, "delivered"))
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)
        if cursor != began:
            self.cursor.update((cursor,))
        if behind and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if next(iter(self.waiting.keys()), None) is not None:  # the gap is still open: told again after each patience
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
            yield pd.DataFrame([(key[0], self._at() + 1, None, "gap")], columns=_COLUMNS)


def merge(events: DataFrame, key: str, number: str, content: str, remember_ms: int = 86_400_000, patience_ms: int = 600_000) -> DataFrame:
    """(key, number, content, outcome) of a stream of events numbered from 1 by key: delivered, each number once; replay; conflict (a number that
    waits, or was delivered within remember_ms, came with other content; what came first stays); gap (the first missing number, when it has been
    missing for patience_ms). Rows without key or number are left out, a null content is empty. The session needs CONF."""
    e = events.select(F.col(key).cast("string").alias("key"), F.col(number).cast("bigint").alias("number"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"))
    e = e.where("key is not null and number >= 1")
    return e.groupBy("key").transformWithStateInPandas(_Merge(remember_ms, patience_ms), OUT, "Append", "ProcessingTime")


def catch_up(events: DataFrame, place: str, **columns) -> DataFrame:
    """Merges what has arrived since the last call for this place (checkpoint and feed lie there) and returns the whole feed so far."""
    spark = events.sparkSession
    before = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        q = merge(events, **columns).writeStream.outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
        q.format("parquet").option("path", f"{place}/rows").start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUT).parquet(f"{place}/rows")
