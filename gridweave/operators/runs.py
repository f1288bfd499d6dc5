"""Runs of flows that keep what they make: results are reused, runs are resumed, retries wait outside of tasks.

Under a store (a folder of any file system that Spark writes) a stage's attempts are a table for each fingerprint of the stage
and all it depends on: a row for each attempt of a grid row, with outputs and record. A run reads what succeeded there before, calls
functions for the remaining rows only (a join of grid rows with the table by row key), and appends what they make, so a run that was
cut off goes on where it was, and a changed stage runs with those that depend on it alone. Failures that are to be tried again
are a wave of their own once they are due; until then the driver waits and no task does. Stages of columns are evaluated in
place, unless they draw at random.

Files of sinks are written once all rows of a stage are done, through the format ``artifacts``.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.scalars import row_key
from gridweave.operators.flow import Flow, Stage, _deterministic, _staged, _visible, retry_delay
from gridweave.plans.flow_plan import stage_signature
from gridweave.schema import DIAG, FILE_REF, Flex
from gridweave.sources.artifacts import filesystem, use_artifacts
from gridweave.sources.catalog import Packing, packed_type
from gridweave.sources.shared import delete, exists

#: What is kept of a run: how many rows each stage was called for, read from the store, failed, and when.
RUN = "run_id string, run_key string, stage string, stage_order int, fingerprint string, executed long, reused long, failed long, attempts int, started_at timestamp, ended_at timestamp"


def depends_on(df: DataFrame, stage: Stage, grid: list[str], done: list[Stage]) -> list[Stage]:
    """The earlier stages that a stage needs or names outputs of."""
    visible = _visible(stage, grid, done)
    maker = {s.named(n): s for s in done for n, _ in s.schema.fields}
    if stage.is_columns:
        named: set[str] = set()
        for value in stage.does.values():
            named |= _references(df, F.expr(value) if isinstance(value, str) else value)
    else:
        wide = len(stage.arguments()) < len(inspect.signature(stage.does).parameters)
        named = {visible[n] for n in visible if wide or n in stage.arguments()}
    if isinstance(stage.skip_when, (str, Column)):
        named |= _references(df, F.expr(stage.skip_when) if isinstance(stage.skip_when, str) else stage.skip_when)
    elif stage.skip_when is not None:
        named |= set(visible.values())
    found = {maker[n].id for n in named if n in maker} | set(stage.needs)
    return [s for s in done if s.id in found]


def _references(df: DataFrame, value: Column) -> set[str]:
    found = df.select(value.alias("v"))._jdf.queryExecution().analyzed().references().toSeq()
    return {found.apply(k).name() for k in range(found.size())}


def deep_fingerprint(flow: Flow, stage: Stage, before: list[str]) -> str:
    """A hash of a stage, of how its rows are made and of the fingerprints of what it depends on. Values that a function
    takes from around it are not in it; what changes goes into ``constants``."""
    sink = stage.sink
    files = None if sink is None else [sink.fields, sink.base, sink.template, {f: sink.format_of(f).extension for f in sink.fields}, sink.overwrite, sink.autoload, sink.options]
    return hashlib.sha1(json.dumps([stage_signature(stage), stage.io_mode, flow.seed_col, flow.validate, files, before], default=str).encode()).hexdigest()


def run(flow: Flow, store: str, limit: int | None = None, ordinal: str = "ordinal", wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The flow's result as :meth:`Flow.collect` has it, from stages that ran or were read from ``store``.

    Rows of the grid that are equal are called once. Failed, skipped and cancelled rows are decided anew in every run;
    only successes are reused. ``wait`` passes the seconds before a wave of retries. With ``error="stop"`` the run ends
    behind the first stage with a failure, and what succeeded stays. What the run did is in :func:`runs_of`.
    """
    spark, run_id = flow.grid.sparkSession, flow.run_id or uuid.uuid4().hex
    flow = replace(flow, run_id=run_id)
    grid = flow.grid if limit is None else flow.grid.orderBy(ordinal).limit(limit)
    names = grid.columns
    df = grid.withColumns({"row_id": row_key(*names), ".diag": F.array().cast(T.ArrayType(DIAG))})
    done: list[Stage] = []
    prints: dict[str, str] = {}
    told = []
    n_rows = df.select("row_id").distinct().count()
    for order, stage in enumerate(flow.ordered()):
        prints[stage.id] = deep_fingerprint(flow, stage, [prints[s.id] for s in depends_on(df, stage, names, done)])
        if stage.is_columns and all(_deterministic(df, F.expr(v) if isinstance(v, str) else v) for v in stage.does.values()):
            df = _staged(df, flow, stage, names, done)
        else:
            df, counts = _kept_stage(df, flow, stage, names, done, f"{store}/attempts/{stage.id}/{prints[stage.id]}", n_rows, wait)
            told.append((run_id, _run_key(run_id, prints), stage.id, order, prints[stage.id], *counts))
        done.append(stage)
        if flow.error == "stop" and told and told[-1][2] == stage.id and told[-1][7]:
            break
    df = df.select(*[F.col(f"`{c}`") for c in [*names, "row_id", ".diag", *[s.named(n) for s in done for n, _ in s.schema.fields]]])
    spark.createDataFrame(told, RUN).coalesce(1).write.mode("append").parquet(f"{store}/runs")
    return flow.finished(df)


def runs_of(spark: SparkSession, store: str) -> DataFrame:
    """What runs did: a row for each run and stage that was not evaluated in place."""
    return spark.read.schema(RUN).parquet(f"{store}/runs")


def _run_key(run_id: str, prints: dict[str, str]) -> str:
    return hashlib.sha1(json.dumps([run_id, sorted(prints.items())]).encode()).hexdigest()


def _kept_stage(df: DataFrame, flow: Flow, stage: Stage, grid: list[str], done: list[Stage], path: str, n_rows: int, wait: Callable[[float], None]) -> tuple[DataFrame, tuple]:
    """Rows with a stage's outputs and records from its table, which gets what was not there; and what was done."""
    spark, began = df.sparkSession, datetime.now(UTC)
    most = stage.retries if stage.retries is not None else flow.retries
    fields = [(n, kind.stored if isinstance(kind, Flex) else kind) for n, kind in stage.schema.fields]
    kept = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("again", T.BooleanType()), T.StructField("_record", DIAG), *[T.StructField(f"_o_{n}", t) for n, t in fields]])
    table = lambda: spark.read.schema(kept).parquet(path)
    rows = df.dropDuplicates(["row_id"])
    todo, executed, failed, reused, wave = rows, 0, 0, 0, 0
    if exists(spark, path):
        todo = rows.join(table().where("_record.ok").select("row_id"), "row_id", "left_anti")
    while True:
        wave += 1
        made, scratch = _made(todo, flow, stage, grid, done, wave, path)
        seen = Observation()
        made = made.observe(seen, F.count("*").alias("n"), F.count_if(F.col("_record.status").isin("completed", "failed")).alias("called"), F.count_if(F.col("_record.status") == "failed").alias("failed"), F.count_if("again").alias("again"))
        made.write.mode("append").parquet(path)
        for folder in scratch:
            delete(spark, folder)
        counts = seen.get
        reused = n_rows - counts["n"] if wave == 1 else reused
        executed, failed = executed + (counts["called"] if wave == 1 else 0), counts["failed"] if wave == 1 else failed - counts["called"] + counts["failed"]
        if not counts["again"] or wave > most:
            break
        wait(retry_delay(wave, stage.backoff or flow.backoff, flow.base if stage.base is None else stage.base))
        due = table().where((F.col("run_id") == flow.run_id) & (F.col("attempt") == wave) & F.col("again"))
        todo = rows.join(due.select("row_id"), "row_id", "left_semi")
    # Of each row its success, or else this run's last attempt.
    own = table().where(F.col("_record.ok") | (F.col("run_id") == flow.run_id))
    last = own.groupBy("row_id").agg(F.max_by(F.struct("_record", *[f"_o_{n}" for n, _ in fields]), F.struct("_record.ok", "attempt", "run_id")).alias("_got"))
    outputs = {stage.named(n): F.col(f"_got._o_{n}") for n, _ in fields}
    df = df.join(last, "row_id").withColumns(outputs | {".diag": F.concat("`.diag`", F.array("_got._record"))}).drop("_got")
    return df, (executed, reused, failed, wave, began, datetime.now(UTC))


def _made(todo: DataFrame, flow: Flow, stage: Stage, grid: list[str], done: list[Stage], wave: int, path: str) -> tuple[DataFrame, list[str]]:
    """One attempt of a stage for some rows, as rows of its table, and folders to delete once they are there."""
    fields = [n for n, _ in stage.schema.fields]
    told = [F.lit(flow.run_id).alias("run_id"), F.lit(wave).alias("attempt")]
    if stage.sink is None:
        staged = _staged(todo, flow, stage, grid, done, wave)
        again = F.coalesce("_retry", F.lit(False)) if "_retry" in staged.columns else F.lit(False)
        return staged.select("row_id", *told, again.alias("again"), F.element_at("`.diag`", -1).alias("_record"), *[F.col(f"`{stage.named(n)}`").alias(f"_o_{n}") for n in fields]), []
    sink, kinds = stage.sink, dict(stage.schema.fields)
    values = {f: kinds[f] for f in sink.fields if f in kinds and sink.autoload and kinds[f] != FILE_REF and not isinstance(kinds[f], Flex)}
    packing = Packing(**{k: getattr(sink, k) for k in sink.__dataclass_fields__}, kinds=values)
    packed = tuple((n, packed_type(values.get(n, T.StringType())) if n in sink.fields else kind) for n, kind in stage.schema.fields)
    staged = _staged(todo, flow, replace(stage, sink=packing, schema=replace(stage.schema, fields=packed)), grid, done, wave)
    rows = staged.select("row_id", *told, F.coalesce("_retry", F.lit(False)).alias("again"), F.element_at("`.diag`", -1).alias("_record"), *[F.col(f"`{stage.named(n)}`").alias(f"_o_{n}") for n in fields])
    scratch = f"{path}-files-{uuid.uuid4().hex}"
    return _with_files(rows, stage, values, scratch), [scratch, f"{scratch}-refs"]


def _with_files(rows: DataFrame, stage: Stage, values: dict[str, T.DataType], scratch: str) -> DataFrame:
    """Rows whose packed fields have become files and references (or values), under the sink's policy."""
    spark, sink = rows.sparkSession, stage.sink
    use_artifacts(spark)
    rows.write.parquet(scratch)
    rows = spark.read.schema(rows.schema).parquet(scratch)
    own = [n for n, _ in stage.schema.fields if n in sink.fields]
    entry = lambda n: F.struct(F.lit(n).alias("field"), F.col(f"_o_{n}.path").alias("path"), F.col(f"_o_{n}.sha256").alias("sha256"), F.octet_length(f"_o_{n}.content").cast("long").alias("bytes"))
    entries = rows.where("_record.ok").select("row_id", F.inline(F.array(*map(entry, own)))).where(F.col("path").isNotNull())
    # Of fields that go to one place one is written: the first, or the last where files are overwritten.
    order = Window.partitionBy("path").orderBy(*[F.desc(c) if sink.overwrite == "overwrite" else F.asc(c) for c in ("row_id", "field")])
    entries = entries.withColumns({"_place": F.row_number().over(order), "_first": F.first_value("sha256").over(order), "_size": F.first_value("bytes").over(order)})
    before = spark.createDataFrame([], "path string, _sha string, _bytes long")
    if filesystem(sink.base)[0].get_file_info(filesystem(sink.base)[1]).type.name == "Directory":
        there = spark.read.format("artifacts").option("content", "false").load(sink.base)
        before = there.select("path", F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes"))
    known = entries.join(before, "path", "left")
    existed = F.col("_sha").isNotNull()
    write = (F.col("_place") == 1) & (~existed | F.lit(sink.overwrite == "overwrite"))
    held = F.coalesce(F.when(F.lit(sink.overwrite != "overwrite"), F.col("_sha")), F.col("_first"))
    # A file with other contents than the row's own; one with the same may be of a run that was cut off.
    clash = F.lit(sink.overwrite == "error") & (held != F.col("sha256"))
    size = F.when(existed & F.lit(sink.overwrite != "overwrite"), F.col("_bytes")).otherwise(F.col("_size"))
    ref = F.struct(F.col("path"), size.alias("bytes"), held.alias("sha256"), write.alias("written"), existed.alias("existed"))
    decided = known.select("row_id", "field", "path", clash.alias("clash"), write.alias("write"), ref.alias("ref"))
    found = decided.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "ref"))).alias("_refs"), F.max(F.when(F.col("clash"), F.col("path"))).alias("_clash"), F.collect_set(F.when(F.col("write"), F.col("field"))).alias("_write"))
    # Kept, so that what is there is looked at once, before files are written.
    found.write.parquet(f"{scratch}-refs")
    found = spark.read.schema(found.schema).parquet(f"{scratch}-refs")

    full = rows.join(found, "row_id", "left")
    packed = lambda n: F.struct(F.lit(n).alias("field"), F.col(f"_o_{n}.path").alias("path"), F.col(f"_o_{n}.content").alias("content"), F.col(f"_o_{n}.sidecar").alias("sidecar"))
    files = full.where(F.col("_clash").isNull() & (F.size("_write") > 0)).select("_write", F.inline(F.array(*map(packed, own)))).where(F.array_contains("_write", F.col("field")))
    files.select("path", "content", "sidecar").write.format("artifacts").mode("append").save(sink.base)

    bad = F.col("_clash").isNotNull()
    record = F.when(bad, F.col("_record").withField("ok", F.lit(False)).withField("status", F.lit("failed")).withField("error_class", F.lit("FileExistsError")).withField("error_message", F.col("_clash"))).otherwise(F.col("_record"))
    outputs = []
    for n, kind in stage.schema.fields:
        value = F.col(f"_o_{n}")
        if n in own:
            value = value["value"] if n in values else F.try_element_at("_refs", F.lit(n))
        outputs.append(F.when(~bad, value).alias(f"_o_{n}"))
    return full.select("row_id", "run_id", "attempt", F.when(bad, F.lit(False)).otherwise(F.col("again")).alias("again"), record.alias("_record"), *outputs)


def forget(spark: SparkSession, store: str, stage: str | None = None) -> bool:
    """Deletes what a store keeps of a stage, or all of it; whether there was anything."""
    return delete(spark, store if stage is None else f"{store}/attempts/{stage}")


#: What is kept of a result that was written.
RESULT = "run_id string, run_key string, path string, status string, n_rows long, ok long, failed long, failed_by_stage map<string,long>, started_at timestamp, ended_at timestamp, error string"


def write_result(flow: Flow, path: str, store: str, made: Callable[[Flow], DataFrame] = Flow.collect) -> dict:
    """Writes a flow's result as Parquet and adds a record of it to ``store``: rows, successes and failures, of each stage
    too, counted in the pass that writes; also of a run that is broken off, with its error. The record is returned.
    ``made`` gives the result, :meth:`Flow.collect` unless it is a kept run."""
    spark, began = flow.grid.sparkSession, datetime.now(UTC)
    flow = replace(flow, run_id=flow.run_id or uuid.uuid4().hex)
    key = _run_key(flow.run_id, {s.id: stage_signature(s) for s in flow.stages})
    record = {"run_id": flow.run_id, "run_key": key, "path": path, "status": "completed", "n_rows": 0, "ok": 0, "failed": 0, "failed_by_stage": {}, "started_at": began, "error": None}
    bad = lambda s: F.exists(F.col("`.diag`"), lambda d: (d["stage"] == s) & ~d["ok"] & ~d["skipped"])
    seen = Observation()
    try:
        out = made(flow)
        out = out.observe(seen, F.count("*").alias("n_rows"), F.count_if("`.ok`").alias("ok"), *[F.count_if(bad(s.id)).alias(f"s{k}") for k, s in enumerate(flow.stages)])
        out.write.mode("overwrite").parquet(path)
        counts = seen.get
        record |= {"n_rows": counts["n_rows"], "ok": counts["ok"], "failed": counts["n_rows"] - counts["ok"], "failed_by_stage": {s.id: counts[f"s{k}"] for k, s in enumerate(flow.stages)}}
    except Exception as e:
        record |= {"status": "failed", "error": str(e).splitlines()[0]}
        raise
    finally:
        record["ended_at"] = datetime.now(UTC)
        fields = T.StructType.fromDDL(RESULT)
        spark.createDataFrame([tuple(record[f.name] for f in fields)], fields).coalesce(1).write.mode("append").parquet(f"{store}/results")
    return record


def results_of(spark: SparkSession, store: str) -> DataFrame:
    """The records of results that were written."""
    return spark.read.schema(RESULT).parquet(f"{store}/results")
