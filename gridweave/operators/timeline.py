"""What happened in runs, in order: one timeline of events, failed attempts, jobs and ends of runs, each failure with the
last signs of life before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.scalars import offset
from gridweave.operators.diagnostics import LABELS, classify_failure
from gridweave.operators.ordinals import in_ranges

#: Types of events that a timeline tells of.
TOLD = ("run_started", "run_completed", "run_failed", "chunk_started", "chunk_completed", "chunk_failed", "chunk_crashed", "stage_started", "stage_completed", "stage_cancelled", "stage_failed", "stage_retried", "retry_exhausted", "stage_heartbeat", "worker_heartbeat", "user_log")
LINE = ("run_id", "at", "offset_s", "offset", "event", "chunk_id", "stage", "class", "severity", "source")


def event_label(columns: list[str]) -> Column:
    """One line about an event (event_type, chunk_id, stage, error, message, attempt, summary; what is not among ``columns``
    is null). The texts are those that users know, so they are fixed values."""
    text = lambda c: F.col(c).cast("string") if c in columns else F.lit(None).cast("string")
    short = lambda c: F.substring(F.coalesce(text(c), F.lit("")), 1, 60)
    kind, chunk, some = F.col("event_type"), F.coalesce(text("chunk_id"), F.lit("?")), F.coalesce(text("summary"), F.lit("")) != ""
    stage = F.concat(F.when(text("chunk_id").isNotNull(), F.concat(F.lit("chunk "), text("chunk_id"), F.lit(" "))).otherwise(""), F.lit("stage '"), F.coalesce(text("stage"), F.lit("?")), F.lit("'"))
    worker = F.coalesce(F.concat(F.lit("chunk "), text("chunk_id")), F.lit("worker"))
    said = {
        "run_started": ("[START] Pipeline started",), "run_completed": ("[DONE] ", F.when(some, text("summary")).otherwise("Pipeline completed")), "run_failed": ("[FAIL] ", F.when(some, text("summary")).otherwise("Pipeline failed")),
        "chunk_started": ("[CHUNK] chunk ", chunk, " started"), "chunk_completed": ("[CHUNK] chunk ", chunk, " completed"), "chunk_failed": ("[FAIL] chunk ", chunk, " failed: ", short("error")), "chunk_crashed": ("[CRASH] chunk ", chunk, " crashed"),
        "stage_started": ("[STAGE] ", stage, " started"), "stage_completed": ("[STAGE] ", stage, " completed"), "stage_cancelled": ("[CANCEL] ", stage, ": ", short("message")), "stage_failed": ("[FAIL] ", stage, ": ", short("error")),
        "stage_retried": ("[RETRY] ", stage, " attempt ", F.coalesce(text("attempt"), F.lit("?"))), "retry_exhausted": ("[EXHAUSTED] ", stage, " retries exhausted"),
        "stage_heartbeat": ("[HEARTBEAT] ", stage, ": ", short("message")), "worker_heartbeat": ("[HEARTBEAT] ", worker, ": ", short("message")), "user_log": ("[LOG] ", F.coalesce(text("message"), F.lit(""))),
    }
    out = F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    for name, parts in said.items():
        out = F.when(kind == name, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise(out)
    return out


def as_of(left: DataFrame, right: DataFrame, at: str, by: tuple[str, ...], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``left`` with ``name``: ``value`` of the last row of ``right`` at its time or before, of the same ``by``; null if none.
    Of several at one time the largest value counts; nulls of ``by`` are a group, rows of ``right`` without a value or a
    time do not count, rows of ``left`` without a time get none.

    Both are dealt to ranges of time with about equal numbers of rows (four for each shuffle partition unless ``parts`` is
    given); what is last in a range is carried to the ranges behind it through one row for each group and range. So a
    group with most of the rows is spread over all ranges.
    """
    parts = parts or 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{k}" for k in range(len(by))]
    key = lambda df: [df[c].alias(k) for c, k in zip(by, keys, strict=True)]
    micros = lambda df: F.unix_micros(df[at].cast("timestamp")).alias("_us")
    asked = left.select(*key(left), micros(left), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    told = right.select(*key(right), micros(right), right[value].alias("_v"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")).where(F.col("_v").isNotNull() & F.col("_us").isNotNull())
    rows = in_ranges(asked.unionByName(told), "_us", parts)
    # At one time what is told comes before what is asked, the largest last.
    here = Window.partitionBy(*keys, "_block").orderBy(F.col("_us").asc_nulls_last(), F.col("_row").isNotNull(), "_v")
    local = F.last("_v", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where(F.col("_v").isNotNull()).groupBy(*keys, "_block").agg(F.max_by("_v", F.struct("_us", "_v")).alias("_end"))
    # Every range that a group has rows in, so that a value is carried over ranges that tell nothing.
    blocks = rows.groupBy(*keys, "_block").agg(F.lit(1).alias("_one")).drop("_one").alias("b")
    same = F.lit(True)
    for k in (*keys, "_block"):
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}"))
    placed = blocks.join(ends.alias("e"), same, "left").select("b.*", "e._end")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end").alias("c")
    same = F.lit(True)
    for k in (*keys, "_block"):
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    found = rows.withColumn("_local", local).where(F.col("_row").isNotNull()).alias("r").join(carried, same)
    timed = F.when(F.col("r._us").isNotNull(), F.coalesce("r._local", "c._carried"))
    return found.select("r._row.*", timed.alias(name))


def run_timeline(events: DataFrame, attempts: DataFrame, jobs: DataFrame, runs: DataFrame, parts: int | None = None) -> DataFrame:
    """The lines of all runs: run_id, at, offset_s and offset from the run's start, event, chunk_id, stage, class, severity,
    source, and for failures ``last_heartbeat`` (a time) and ``last_log`` (a message) of their chunk before them.

    ``events``: run_id, ts, event_type, chunk_id, stage, message, error, attempt, severity. ``attempts``: run_id, chunk_id, stage, ok,
    skipped, status, ended_at, error_class, error_message; those that failed are told. ``jobs``: run_id, chunk_id, state, signal,
    elapsed_s; those that failed, were cancelled or ran out of time are told at the run's start and that much. ``runs``: run_id,
    submitted_at, finished_at, n_chunks, n_failed; those that finished have a last line. Lines of runs that are not in
    ``runs`` have no offset. Order lines by run_id and at.
    """
    none = lambda kind: F.lit(None).cast(kind)
    time = lambda c: F.col(c).cast("timestamp")
    chunk = F.coalesce(F.col("chunk_id").cast("string"), F.lit("?"))
    first = events.where(F.col("event_type").isin(*TOLD)).select("run_id", time("ts").alias("at"), event_label(events.columns).alias("event"), F.col("chunk_id").cast("long").alias("chunk_id"), "stage", none("string").alias("class"), F.coalesce("severity", F.lit("info")).alias("severity"), F.lit("events").alias("source"))
    own = classify_failure(none("string"), none("int"), F.col("error_class"), F.col("status"))
    said = F.concat(F.lit("[FAIL] chunk "), chunk, F.lit(", stage '"), F.col("stage"), F.lit("': "), F.substring(F.coalesce("error_message", F.lit("unknown")), 1, 60))
    second = attempts.where(~F.col("ok") & ~F.col("skipped") & F.col("ended_at").isNotNull()).select("run_id", time("ended_at").alias("at"), said.alias("event"), F.col("chunk_id").cast("long").alias("chunk_id"), "stage", own.alias("class"), F.lit("error").alias("severity"), F.lit("attempts").alias("source"))
    kind = classify_failure(F.col("state"), F.col("signal"), none("string"), none("string"))
    label = kind
    for name, text in LABELS.items():
        label = F.when(kind == name, text).otherwise(label)
    ended = jobs.where(F.col("state").isin("FAILED", "CANCELLED", "TIMEOUT") & F.col("elapsed_s").isNotNull()).join(runs.select("run_id", time("submitted_at").alias("_s")), "run_id")
    third = ended.select("run_id", F.timestamp_micros(F.unix_micros("_s") + (F.col("elapsed_s") * 1_000_000).cast("long")).alias("at"), F.concat(F.lit("["), label, F.lit("] chunk "), chunk, F.lit(": job "), F.col("state")).alias("event"), F.col("chunk_id").cast("long").alias("chunk_id"), none("string").alias("stage"), kind.alias("class"), F.lit("error").alias("severity"), F.lit("jobs").alias("source"))
    count = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    done = F.concat(F.lit("[DONE] "), count(F.col("n_chunks") - F.col("n_failed")), F.lit("/"), count(F.col("n_chunks")), F.lit(" ok, "), count(F.col("n_failed")), F.lit(" failed"))
    fourth = runs.where(F.col("finished_at").isNotNull()).select("run_id", time("finished_at").alias("at"), done.alias("event"), none("long").alias("chunk_id"), none("string").alias("stage"), none("string").alias("class"), F.lit("info").alias("severity"), F.lit("runs").alias("source"))

    lines = first.unionByName(second).unionByName(third).unionByName(fourth)
    # As many rows as there are runs.
    lines = lines.join(runs.select("run_id", time("submitted_at").alias("_s")), "run_id", "left")
    seconds = (F.unix_micros("at") - F.unix_micros("_s")) / 1_000_000
    lines = lines.withColumns({"offset_s": seconds, "offset": offset(seconds)}).select(*LINE)
    failed = F.col("severity") == "error"
    signs = events.where(F.col("event_type").isin("worker_heartbeat", "stage_heartbeat")).select("run_id", F.col("chunk_id").cast("long").alias("chunk_id"), time("ts").alias("at"), time("ts").alias("_beat"))
    logs = events.where(F.col("event_type") == "user_log").select("run_id", F.col("chunk_id").cast("long").alias("chunk_id"), time("ts").alias("at"), F.coalesce("message", F.lit("")).alias("_said"))
    bad = as_of(lines.where(failed), signs, "at", ("run_id", "chunk_id"), "_beat", "last_heartbeat", parts)
    bad = as_of(bad, logs, "at", ("run_id", "chunk_id"), "_said", "last_log", parts)
    return lines.where(~failed).withColumns({"last_heartbeat": none("timestamp"), "last_log": none("string")}).unionByName(bad)
