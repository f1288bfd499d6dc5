"""What a flow's records say: attempts, summaries, failures and how they change from run to run."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.scalars import attempt_id, format_bytes, hms, message_fingerprint, parse_memory


def diagnostics(out: DataFrame, stage: str | None = None) -> DataFrame:
    """A row for each row and stage."""
    rows = out.select("row_id", F.inline("`.diag`"))
    return rows if stage is None else rows.where(F.col("stage") == stage)


def failed(out: DataFrame, stage: str | None = None) -> DataFrame:
    """Rows that failed, or whose named stage neither succeeded nor was skipped."""
    if stage is None:
        return out.where(~F.col("`.ok`"))
    return out.where(F.exists("`.diag`", lambda d: (d["stage"] == stage) & ~d["ok"] & ~d["skipped"]))


def attempts(out: DataFrame, run_id: str) -> DataFrame:
    """The attempts table: diagnostics with run, row and a stable id."""
    return diagnostics(out).withColumns({"run_id": F.lit(run_id), "attempt_id": attempt_id(F.lit(run_id), F.col("row_id"), F.col("stage"))})


def stage_summary(attempts: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """Total, completed, failed, cancelled and skipped attempts and the median duration of each stage; stages (a table
    with ``stage``) without attempts have zeros."""
    count = lambda status: F.count_if(F.col("status") == status)
    rows = attempts.groupBy("stage").agg(F.count("*").alias("total"), *[count(s).alias(s) for s in ("completed", "failed", "cancelled", "skipped")], F.median("duration_ms").alias("median_ms"))
    if stages is None:
        return rows
    counted = ["total", "completed", "failed", "cancelled", "skipped"]
    return stages.select("stage").join(rows, "stage", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counted})


def run_summary(out: DataFrame, run_id: str) -> DataFrame:
    """One row: rows, rows that failed, whether all are ok."""
    return out.agg(F.lit(run_id).alias("run_id"), F.count("*").alias("rows"), F.count_if(~F.col("`.ok`")).alias("failed_rows"), F.coalesce(F.bool_and("`.ok`"), F.lit(True)).alias("ok"))


def classify_failure(state: Column, signal: Column, error_class: Column, status: Column) -> Column:
    """The class of a failure; the first that fits: oom, timeout, infrastructure, dependency, validation, error, crash,
    unknown."""
    return (
        F.when(state.contains("OUT_OF_MEMORY") | (signal == 9), "oom")
        .when(state.contains("TIMEOUT"), "timeout")
        .when((state.contains("CANCELLED") & ~state.rlike(r"CANCELLED\+")) | state.contains("NODE_FAIL"), "slurm_infra")
        .when(status == "cancelled", "dependency")
        .when(error_class.rlike("^(contract|validation)"), "validation")
        .when(error_class.isNotNull() | (status == "failed"), "r_error")
        .when(state.isin("FAILED", "CANCELLED", "TIMEOUT"), "r_crash")
        .otherwise("unknown")
    )


def suggested_memory(requested_bytes: Column) -> Column:
    """Half as much again as was asked for, in whole GiB."""
    return F.ceil(requested_bytes * 1.5 / F.lit(1024.0**3))


def suggested_hours(elapsed_seconds: Column) -> Column:
    """Twice the time it took, in whole hours."""
    return F.ceil(elapsed_seconds * 2 / 3600)


# Labels of failure classes.
LABELS = {"oom": "OOM", "timeout": "TIMEOUT", "dependency": "DEP", "validation": "VALIDATION", "r_error": "ERROR", "r_crash": "CRASH", "unknown": "UNKNOWN"}


def failure_details(failures: DataFrame) -> DataFrame:
    """Failures (state, signal, error_class, error_message, status, max_rss in bytes, requested_memory as text,
    elapsed_seconds) with class, label, detail and suggestion, which is null where there is nothing to suggest."""
    rows = failures.withColumn("class", classify_failure(F.col("state"), F.col("signal"), F.col("error_class"), F.col("status")))
    kind, rss, asked, took = F.col("class"), F.col("max_rss"), F.col("requested_memory"), F.col("elapsed_seconds")
    gone, down = F.col("state").contains("NODE_FAIL"), F.col("state") == "COMPLETED"
    label = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), kind)
    message = F.coalesce("error_message", F.lit(""))
    against = F.when(asked.isNotNull(), F.concat(F.lit(" against "), asked)).otherwise("")
    detail = (
        F.when(kind == "oom", F.concat(F.lit("killed for memory"), F.when(rss.isNotNull(), F.concat(F.lit(" at "), format_bytes(rss), against)).otherwise("")))
        .when(kind == "timeout", F.concat(F.lit("out of time"), F.when(took.isNotNull(), F.concat(F.lit(" after "), hms(took))).otherwise("")))
        .when(kind == "slurm_infra", F.when(gone, "a node failed").otherwise("the job was cancelled"))
        .when(kind.isin("dependency", "validation", "r_error"), message)
        .when(kind == "r_crash", F.when(down, "completed without a result").otherwise(F.concat(F.lit("no result after "), F.lower("state"))))
        .otherwise("the cause is not known")
    )
    more = F.concat(F.lit("ask for "), suggested_memory(parse_memory(asked)).cast("string"), F.lit("G of memory"))
    longer = F.concat(F.lit("ask for "), suggested_hours(took).cast("string"), F.lit(":00:00 of time"))
    suggestion = (
        F.when(kind == "oom", F.coalesce(more, F.lit("ask for more memory")))
        .when(kind == "timeout", F.coalesce(longer, F.lit("ask for more time")))
        .when((kind == "slurm_infra") & gone, "run it again")
        .when(kind == "dependency", "see to the stage before it")
        .when(kind == "validation", "see to schema and contract")
        .when(kind == "r_crash", "look into the log for the end of the process")
        .when(kind == "unknown", "look into logs and results")
    )
    return rows.withColumns({"label": F.coalesce(label, F.when(gone, "NODE_FAIL").otherwise("CANCELLED")), "detail": detail, "suggestion": suggestion})


def failure_suggestions(details: DataFrame) -> DataFrame:
    """For each class of failures with something to suggest: how many there are and the least of their suggestions."""
    return details.where(F.col("suggestion").isNotNull()).groupBy("class", "label").agg(F.count("*").alias("n"), F.min("suggestion").alias("suggestion"))


def run_errors(results: DataFrame, jobs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """All errors of a run as one table: chunk_id, row_id, stage, error_msg, source, context and class.

    ``results`` (chunk_id, row_id, .diag) are what chunks left; every stage that neither succeeded nor was skipped is an
    error of source "index". ``jobs`` (chunk_id, state) in a final state of which there is no result are errors of source
    "missing"; others only lend their states to the classes. ``labels`` (chunk_id, label) give the context."""
    own = results.select("chunk_id", "row_id", F.inline("`.diag`")).where(~F.col("ok") & ~F.col("skipped"))
    index = own.select("chunk_id", "row_id", "stage", F.coalesce("error_message", F.lit("unknown error")).alias("error_msg"), F.lit("index").alias("source"), "status", "error_class")
    lost = missing_results(jobs, results, "chunk_id")
    text = F.when(F.col("state") == "COMPLETED", "completed without a result").otherwise(F.concat(F.lower("state"), F.lit(" without a result")))
    none = F.lit(None).cast("string")
    crashed = lost.select("chunk_id", none.alias("row_id"), none.alias("stage"), text.alias("error_msg"), F.lit("missing").alias("source"), none.alias("status"), none.alias("error_class"))
    rows = index.unionByName(crashed).join(jobs.select("chunk_id", "state", *[c for c in ("signal",) if c in jobs.columns]), "chunk_id", "left")
    signal = F.col("signal") if "signal" in jobs.columns else F.lit(None).cast("int")
    missing = F.col("source") == "missing"
    # A chunk without a result that is said to be completed died before it could leave one.
    state = F.when(missing & (F.col("state") == "COMPLETED"), "FAILED").otherwise(F.col("state"))
    rows = rows.withColumn("class", classify_failure(state, signal, F.col("error_class"), F.col("status")))
    rows = rows.join(labels.select("chunk_id", F.col("label").alias("context")), "chunk_id", "left") if labels is not None else rows.withColumn("context", none)
    return rows.select("chunk_id", "row_id", "stage", "error_msg", "source", "context", "class")


def with_attempts(errors: DataFrame, attempts: DataFrame) -> DataFrame:
    """Errors (row_id, stage, any other columns) with what their attempts tell, where there is one."""
    told = attempts.select("row_id", "stage", "attempt_id", "attempt", "retry_count", "host", "started_at", "duration_ms")
    return errors.join(told, ["row_id", "stage"], "left")


def write_summary(out: DataFrame, run_id: str, path: str) -> None:
    """A run's summary and that of its stages as one small file, HTML if the name ends so and else JSON. It holds a row for
    each stage, no rows of the result."""
    total = run_summary(out, run_id).first().asDict()
    stages = [r.asDict() for r in stage_summary(attempts(out, run_id)).orderBy("stage").collect()]
    if path.endswith((".html", ".htm")):
        cell = lambda tag, v: f"<{tag}>{html.escape(str(v))}</{tag}>"
        names = list(stages[0]) if stages else []
        rows = "".join("<tr>" + "".join(cell("td", s[n]) for n in names) + "</tr>" for s in stages)
        head = "".join(f"<li>{html.escape(k)}: {html.escape(str(v))}</li>" for k, v in total.items())
        text = f"<html><body><ul>{head}</ul><table><tr>{''.join(cell('th', n) for n in names)}</tr>{rows}</table></body></html>"
    else:
        text = json.dumps(total | {"stages": stages}, default=str)
    with open(path, "w") as f:
        f.write(text)


def incomplete_jobs(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks that are to be submitted again: their state is not COMPLETED or they left no result."""
    done = jobs.where("state = 'COMPLETED'").join(results.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id")
    return jobs.join(done, "chunk_id", "left_anti")


#: States in the order in which a report has them.
STATE_ORDER = ("FAILED", "TIMEOUT", "CANCELLED", "RUNNING", "PENDING", "COMPLETED")


def by_state(jobs: DataFrame, *then: str) -> DataFrame:
    """Jobs in the order of their states, unknown ones last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATE_ORDER)), F.col("state")), F.lit(0)), F.lit(len(STATE_ORDER) + 1))
    return jobs.orderBy(place, *then)


def failure_report(errors: DataFrame) -> DataFrame:
    """Errors of each class."""
    return errors.groupBy("class").agg(F.count("*").alias("n"))


def failure_patterns(errors: DataFrame, run: str = "run_idx", message: str = "message", n_runs: int | Column | None = None) -> DataFrame:
    """Each message's fingerprint, with its class where ``errors`` have one, and the runs it was seen in: persistent (all),
    new (the last only), resolved (not the last) or flaky. ``run`` numbers the runs from 1. ``n_runs`` is how many there
    are; without it a run with no errors after all others is not seen, since the last is the largest number there is."""
    kind = F.col("class") if "class" in errors.columns else F.lit("unknown")
    seen = errors.select(message_fingerprint(F.col(message)).alias("fingerprint"), F.col(message).alias("message"), kind.alias("class"), F.col(run).alias("run"))
    first = F.min(F.struct("run", "message", "class"))
    rows = seen.groupBy("fingerprint").agg(F.min("message").alias("message"), first.alias("_first"), F.min("run").alias("first_seen"), F.max("run").alias("last_seen"), F.count_distinct("run").alias("n_runs"))
    rows = rows.withColumn("class", F.col("_first.class")).drop("_first")
    last = rows.crossJoin(F.broadcast(errors.agg(F.max(run).alias("_last")))) if n_runs is None else rows.withColumn("_last", n_runs if isinstance(n_runs, Column) else F.lit(n_runs))
    pattern = F.when(F.col("n_runs") == F.col("_last"), "persistent").when(F.col("first_seen") == F.col("_last"), "new").when(F.col("last_seen") < F.col("_last"), "resolved").otherwise("flaky")
    return last.withColumn("pattern", pattern).drop("_last")


def failure_timeline(events: DataFrame, run: str, at: str) -> DataFrame:
    """Events with whole seconds since their run's first one. The first times are one row for each run, combined before
    they are shuffled, so a run with very many events is no burden to one task."""
    starts = events.groupBy(run).agg(F.min(at).alias("_start"))
    return events.join(starts, events[run].eqNullSafe(starts[run])).drop(starts[run]).withColumn("offset_s", F.timestamp_diff("SECOND", F.col("_start"), F.col(at))).drop("_start")


def missing_results(jobs: DataFrame, results: DataFrame, key: str, states: tuple[str, ...] = ("FAILED", "TIMEOUT", "CANCELLED", "COMPLETED")) -> DataFrame:
    """Jobs in a final state that left no result."""
    return jobs.where(F.col("state").isin(*states)).join(results.select(key).distinct(), key, "left_anti")


def run_diagnosis(expected: Column, submitted: Column, finished: Column, failed_jobs: Column, state: Column, reason: Column) -> Column:
    """One line about a run; the first that fits."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return (
        F.when(state == "failed", F.concat(F.lit("submission_failed after "), text(submitted), F.lit("/"), text(expected), F.lit(" jobs: "), F.coalesce(reason, F.lit("submission failed"))))
        .when(submitted < expected, F.format_string("submission incomplete; %d submitted, %d unsubmitted", submitted, expected - submitted))
        .when(failed_jobs > 0, F.format_string("%d/%d submitted jobs failed", failed_jobs, F.coalesce(submitted, expected, failed_jobs)))
        .when((finished >= submitted) & (submitted > 0), F.format_string("all %d submitted jobs finished", submitted))
        .otherwise("run recorded")
    )


def packed_errors(elements: DataFrame, chunk: str = "chunk_id", index: str = "index", bad: str = "is_error", block: int = 4096) -> DataFrame:
    """Elements, errors and the indices of errors of each chunk. A chunk whose indices lie in several blocks of ``block``
    has a row for each, so no list is longer than that."""
    return elements.groupBy(chunk, F.floor(F.col(index) / block).alias("block")).agg(F.count("*").alias("n_elements"), F.count_if(F.col(bad)).alias("n_errors"), F.sort_array(F.collect_list(F.when(F.col(bad), F.col(index)))).alias("error_indices"))
