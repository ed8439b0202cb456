"""Idle chunks of a stream by a stateful processor with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class IdleChunks(StatefulProcessor):
    """Keeps a key's commands until the watermark shows that their chunk can no longer grow."""

    def __init__(self, keys: list[str], idle: int):
        self.keys, self.idle = keys, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "timestamp long, id long, command string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r["timestamp"], r["id"], r["command"]) for r in rows]
        self.waiting.appendList(fresh)
        ends = {1000 * (t + self.idle) for t, _, _ in fresh}
        for at in ends - set(self.handle.listTimers()):
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What ended ``idle`` seconds before the watermark is whole: rows that come later are newer than that."""
        until = timerValues.getCurrentWatermarkInMs() // 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        chunk, kept, out = [], [], []
        for row in rows:
            if chunk and row[0] - chunk[-1][0] >= self.idle:
                out.append(chunk)
                chunk = []
            chunk.append(row)
        if chunk:
            out.append(chunk)
        for chunk in out:
            if chunk[-1][0] + self.idle <= until:
                yield Row(**dict(zip(self.keys, key)), start_time=chunk[0][0], end_time=chunk[-1][0], n_commands=len(chunk), commands=[c for _, _, c in chunk])
            else:
                kept += chunk
        if len(kept) < len(rows):
            self.waiting.clear()
            if kept:
                self.waiting.appendList(kept)

    def close(self) -> None:
        pass


def stream_chunks(commands: DataFrame, keys: list[str], idle: int = 1800, late: str = "1 hour") -> DataFrame:
    """(keys, start_time, end_time, n_commands, commands) of each chunk, once, when it can no longer grow.

    commands: keys, timestamp (seconds), id, command, and ts, the event time. A
    pause of ``idle`` seconds or more ends a chunk. Commands may come in any
    order as long as they are at most ``late`` behind the newest; the engine drops
    (and counts, as rows dropped by watermark) what comes later still, so such
    rows belong into ``consolidate_stream``, which keeps them aside. Null ids and
    commands are not allowed. Needs the RocksDB state store.
    """
    kind = [*[commands.schema[k] for k in keys], T.StructField("start_time", T.LongType()), T.StructField("end_time", T.LongType()), T.StructField("n_commands", T.LongType()), T.StructField("commands", T.ArrayType(T.StringType()))]
    rows = commands.withWatermark("ts", late).select(*keys, "timestamp", "id", "command", "ts")
    return rows.groupBy(*keys).transformWithState(IdleChunks(keys, idle), outputStructType=T.StructType(kind), outputMode="Append", timeMode="EventTime")
