"""Workers and their progress with keyed state and timers in event time.

A worker is a chunk of a run. While it sends signs of life its state is one row; a timer says when it has been silent
too long, another when it is forgotten. Chunks that are done are bits of a map for each few thousand chunks of a run, so
a repeated event counts once and a run with very many chunks is spread over tasks; maps are forgotten likewise.

State is kept by Spark's RocksDB provider, which streams have to name (``use_timers``); tables need nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SIGNS = ("worker_heartbeat", "stage_heartbeat", "stage_started", "chunk_started")
ENDS = ("chunk_completed", "chunk_failed")
#: What processors return; times are in microseconds, so that no session's time zone meddles with them.
ALERT = "run_id string, chunk_id long, alert string, at long, last long"
MARK = "run_id string, block long, done long, added long, at long"
#: Chunks in one map.
BLOCK = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """Has streams of this session keep their state where timers are possible."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _keyed(rows: DataFrame, late: str, keys: tuple[str, ...], processor: StatefulProcessor, schema: str) -> DataFrame:
    """The processor over streams or tables with ``ts``."""
    # The session's manager of streams also answers for the state of a query over tables; naming it starts it.
    rows.sparkSession.streams  # noqa: B018
    timed = rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    out = timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "last") if c in out.columns})


class Watcher(StatefulProcessor):
    """Alerts of one worker. State: when it was last heard of, whether it is silent, when it ended (0: not yet)."""

    def __init__(self, gap_s: int, forget_s: int):
        self.gap, self.forget = gap_s * 1_000_000, forget_s * 1_000_000

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.state = handle.getValueState("worker", "last long, silent boolean, ended long")

    def _timer(self, at: int) -> None:
        """The worker's only timer, at a time in microseconds; timers fire in milliseconds, never early."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        signs, ended = [], 0
        for frame in rows:
            at, end = frame["us"].to_numpy(np.int64), frame["ended"].to_numpy(bool)
            signs.append(at[~end])
            ended = max(ended, int(at[end].max(initial=0)))
        known = self.state.get() if self.state.exists() else None
        last, silent, before = known if known is not None else (0, False, 0)
        ended = max(ended, before)
        # A sign of an ended worker tells nothing new; one that comes late fills no silence that was told.
        came = np.unique(np.concatenate(signs)) if signs else np.zeros(0, np.int64)
        alerts: list[tuple[str, int, int]] = []
        for at in came[came > last].tolist():
            if not before and last and at - last > self.gap:
                if not silent:
                    alerts.append(("silent", last + self.gap, last))
                alerts.append(("returned", at, last))
            last, silent = at, False
        if ended and not before and last and not silent and ended - last > self.gap:
            alerts.append(("silent", last + self.gap, last))
        self.state.update((last, silent, ended))
        self._timer(ended + self.forget if ended else last + self.gap if not silent else last + self.forget)
        if alerts:
            kinds, at, since = zip(*alerts, strict=True)
            yield pd.DataFrame({"run_id": key[0], "chunk_id": key[1], "alert": kinds, "at": at, "last": since})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, silent, ended = self.state.get()
        if ended or silent:
            self.state.clear()
            return
        self.state.update((last, True, 0))
        self._timer(last + max(self.forget, self.gap + 1000))
        yield pd.DataFrame({"run_id": [key[0]], "chunk_id": [key[1]], "alert": ["silent"], "at": [last + self.gap], "last": [last]})

    def close(self) -> None:
        pass


class Counter(StatefulProcessor):
    """Chunks of one block that are done, one bit each."""

    def __init__(self, forget_s: int):
        self.forget = forget_s * 1_000_000

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.bits = handle.getValueState("bits", "bits binary, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.bits.get() if self.bits.exists() else None
        bits = np.unpackbits(np.frombuffer(known[0] if known is not None else bytes(BLOCK // 8), np.uint8))
        last, before = known[1] if known is not None else 0, int(bits.sum())
        for frame in rows:
            bits[frame["chunk_id"].to_numpy(np.int64) % BLOCK] = 1
            last = max(last, int(frame["us"].to_numpy(np.int64).max()))
        done = int(bits.sum())
        self.bits.update((bytearray(np.packbits(bits).tobytes()), last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-(last + self.forget) // 1000))
        if done > before:
            yield pd.DataFrame({"run_id": [key[0]], "block": [key[1]], "done": [done], "added": [done - before], "at": [last]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.bits.clear()
        return
        yield

    def close(self) -> None:
        pass


def worker_alerts(events: DataFrame, gap_s: int, late: str = "10 minutes", forget_s: int = 86_400) -> DataFrame:
    """run_id, chunk_id, alert, at and last: ``silent`` once nothing was heard of a worker for ``gap_s`` seconds, when
    event time passes that moment and while it is still silent; ``returned`` at its next sign of life. ``last`` is the
    sign before the silence.

    ``events``: run_id, chunk_id, event_type, ts. Signs of life are heartbeats and starts; an end stops the watch. Repeated
    events change nothing; events later than ``late`` are left out by the watermark, and earlier ones that come after later
    ones fill no silence that was told. A worker is forgotten ``forget_s`` seconds after its end or its last sign. Rows
    without a run, a chunk or a time are left out. Over a table no time passes after the last event, so silences that
    ended are told; for those that last there is ``silent_now``.
    """
    rows = events.where(F.col("event_type").isin(*SIGNS, *ENDS) & F.col("ts").isNotNull() & F.col("run_id").isNotNull() & F.col("chunk_id").isNotNull())
    rows = rows.select("run_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin(*ENDS).alias("ended"))
    return _keyed(rows, late, ("run_id", "chunk_id"), Watcher(gap_s, forget_s), ALERT)


def chunk_marks(events: DataFrame, late: str = "1 hour", forget_s: int = 7 * 86_400) -> DataFrame:
    """run_id, block, done, added and at whenever chunks of a block of a run are done that were not: ``added`` of them, and
    ``done`` of the block so far. ``events``: run_id, chunk_id (from 0), event_type, ts; ``chunk_completed`` counts, once for
    each chunk. A block is forgotten ``forget_s`` seconds after the last of its chunks."""
    rows = events.where((F.col("event_type") == "chunk_completed") & F.col("ts").isNotNull() & F.col("run_id").isNotNull() & (F.col("chunk_id") >= 0))
    rows = rows.select("run_id", F.floor(F.col("chunk_id") / BLOCK).alias("block"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _keyed(rows, late, ("run_id", "block"), Counter(forget_s), MARK)


def progress(marks: DataFrame) -> DataFrame:
    """Chunks done of each run, from marks that were written."""
    return marks.groupBy("run_id").agg(F.sum("added").alias("chunks_done"), F.max("at").alias("last"))
