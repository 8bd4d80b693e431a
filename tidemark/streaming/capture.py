"""Count-or-idle message capture, on a stream and on a finished table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.scan import gap_runs

# Flush after this many messages or this many idle seconds.
MAX_ROWS = 15
IDLE_SECONDS = 300

_COLUMNS = ["key", "first_us", "last_us", "n", "reason", "messages"]
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Buffer(StatefulProcessor):
    """Open run of one key: first and last event time and the messages, fewer than ``max_rows``.

    A row that comes late but within the watermark joins the open run unless it lies an idle time or
    more before it; then it is a run of its own, flushed at once. Flushed runs are never reopened.
    """

    def __init__(self, max_rows: int, idle_ms: int) -> None:
        self.max_rows, self.idle_ms = max_rows, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_us bigint, last_us bigint, us array<bigint>, body array<string>")

    def _row(self, key, held: list[tuple[int, str | None]], reason: str) -> dict:
        held = sorted(held, key=lambda m: (m[0], m[1] or ""))
        return {"key": key[0], "first_us": held[0][0], "last_us": held[-1][0], "n": len(held), "reason": reason,
                "messages": [body for _, body in held]}

    def _held(self) -> list[tuple[int, str | None]]:
        if not self.open.exists():
            return []
        _, _, us, body = self.open.get()
        return list(zip(us, body, strict=True))

    def _disarm(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(((int(us), body) for frame in rows for us, body in zip(frame["us"], frame["body"], strict=True)),
                     key=lambda m: (m[0], m[1] or ""))
        held, out, idle = self._held(), [], self.idle_ms * 1000
        first, last = (min(us for us, _ in held), max(us for us, _ in held)) if held else (0, 0)
        for at, body in new:
            if held and first - at >= idle:
                out.append(self._row(key, [(at, body)], "idle"))
                continue
            if held and at - last >= idle:
                out.append(self._row(key, held, "idle"))
                held = []
            first, last = (min(first, at), max(last, at)) if held else (at, at)
            held.append((at, body))
            if len(held) == self.max_rows:
                out.append(self._row(key, held, "count"))
                held = []
        self._disarm()
        if held:
            self.open.update((first, last, [us for us, _ in held], [body for _, body in held]))
            self.handle.registerTimer(last // 1000 + self.idle_ms)
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        held = self._held()
        if held and max(us for us, _ in held) // 1000 + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._row(key, held, "idle"))
            self.open.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def capture(stream: DataFrame, key: str, ts: str, max_rows: int = MAX_ROWS, idle_seconds: int = IDLE_SECONDS,
            watermark: str = "10 minutes", message: str | None = None) -> DataFrame:
    """Flush rows ``(key, first_ts, last_ts, n, reason, messages)`` of a message stream, in event time.

    ``messages`` hands on the flushed values of the column ``message`` (nulls without one), by time.
    State per key is the open run, fewer than ``max_rows`` messages. The key keeps its own type. Rows
    later than the watermark are dropped by Spark and counted in ``numRowsDroppedByWatermark``.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    # The handler works on epoch microseconds, so the session time zone plays no part.
    at = F.col(ts).cast("timestamp")
    body = F.col(message).cast("string") if message else F.lit(None).cast("string")
    rows = stream.select(F.col(key).alias("key"), at.alias("ts"), F.unix_micros(at).alias("us"), body.alias("body"))
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()), T.StructField("n", T.LongType()), T.StructField("reason", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StringType()))])
    flushes = rows.withWatermark("ts", watermark).groupBy("key").transformWithStateInPandas(
        _Buffer(max_rows, idle_seconds * 1000), schema, "Append", "EventTime")
    return flushes.select("key", F.timestamp_micros("first_us").alias("first_ts"),
                          F.timestamp_micros("last_us").alias("last_ts"), "n", "reason", "messages")


def capture_batch(messages: DataFrame, key: str, ts: str, tie: str, max_rows: int = MAX_ROWS,
                  idle_seconds: int = IDLE_SECONDS, bucket: str = "day") -> DataFrame:
    """The same flushes over a finished table, with the still open rest as ``open``.

    Runs are numbered bucket by bucket, so one busy key does not end in one task.
    """
    runs = gap_runs(messages, [key], ts, tie, idle_seconds, F.date_trunc(bucket, F.col(ts)))
    part = F.floor((F.col("run_pos") - 1) / max_rows)
    flushes = runs.groupBy(F.col(key).alias("key"), "run_start", part.alias("part")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    end = messages.groupBy(F.col(key).alias("key")).agg(F.max(ts).alias("_end"))
    return flushes.join(end, "key").select(
        "key", "first_ts", "last_ts", "n",
        F.when(F.col("n") == max_rows, "count").when(F.col("last_ts") == F.col("_end"), "open").otherwise("idle")
        .alias("reason"))


def idle_sessions(messages: DataFrame, key: str, ts: str, idle: str = "5 minutes") -> DataFrame:
    """Idle-only flushes by ``session_window``; works on tables and on watermarked streams."""
    return messages.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), idle).alias("_w")).agg(
        F.count("*").alias("n")).select(key, F.col("_w.start").alias("first_ts"), F.col("_w.end").alias("end_ts"), "n")
