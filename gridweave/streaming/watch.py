"""Watching runs as streams: new errors once each, counts of progress, silent workers, windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.scalars import error_signature
from gridweave.sources.run_store import EVENT


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a folder of JSON lines, as they come; malformed lines have no type and are left out."""
    rows = spark.readStream.schema(EVENT).json(folder)
    return rows.where(F.col("event_type").isNotNull()).withColumn("ts", F.col("timestamp").try_cast("timestamp"))


def new_errors(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each error the first time it is seen; what is remembered goes once it is older than ``late``."""
    errors = events.where(F.col("severity") == "error").withColumn("sig", error_signature(F.col("chunk_id"), F.col("stage"), F.col("row_id"), F.coalesce("error", "message")))
    return errors.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sig"])


def progress(events: DataFrame) -> DataFrame:
    """Chunks finished in each run so far (for update or complete mode). Its state has a row for each chunk and never ends;
    for streams that run on there is :func:`gridweave.streaming.workers.chunk_marks`."""
    return events.where(F.col("event_type") == "chunk_completed").dropDuplicates(["run_id", "chunk_id"]).groupBy("run_id").agg(F.count("chunk_id").alias("chunks_done"))


def silent(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Times in which a worker (run, chunk) kept sending: a session that ends tells that nothing came for ``gap``. For alerts
    while a worker is silent and when it is back there is :func:`gridweave.streaming.workers.worker_alerts`."""
    beats = events.where(F.col("event_type").isin("worker_heartbeat", "stage_heartbeat"))
    return beats.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "run_id", "chunk_id").agg(F.count("*").alias("beats")).select("run_id", "chunk_id", F.col("w.start").alias("first"), F.col("w.end").alias("silent_from"), "beats")


def silent_now(events: DataFrame, now: Column, gap_seconds: int) -> DataFrame:
    """Workers (run, chunk) whose last sign of life is older than the gap at ``now`` and that did not finish, in a table of
    events as it is at the time: it tells of silence while it lasts, however few events come."""
    beats = F.max(F.when(F.col("event_type").isin("worker_heartbeat", "stage_heartbeat", "stage_started", "chunk_started"), F.col("ts")))
    ended = F.bool_or(F.col("event_type").isin("chunk_completed", "chunk_failed"))
    rows = events.groupBy("run_id", "chunk_id").agg(beats.alias("last"), ended.alias("_ended"))
    return rows.where(~F.col("_ended") & (F.unix_seconds(now) - F.unix_seconds("last") > gap_seconds)).drop("_ended")


def windowed_counts(events: DataFrame, at: str, width: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events in windows of event time; works on tables as on streams."""
    windows = F.window(at, width, slide) if slide else F.window(at, width)
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(windows.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def watch(errors: DataFrame, out: str, checkpoint: str):
    """The stream of new errors appended to a folder, from where it stopped before; ends when all there is is done."""
    return errors.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
