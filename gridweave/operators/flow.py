"""Flows: a grid, named stages with declared results, one wide table with the outcome of every stage.

Stages are columns, which stay in Catalyst, or functions, which run in an Arrow UDF over the columns they name. All
else is the same for both and made of columns: cancellation, skips, inputs, lossless casts, contracts, records. The
result has the grid's columns, ``row_id``, a column ``id.field`` for each output, ``.diag`` (a record for each stage)
and ``.ok``. Filters on the result do not reach the grid: filter the grid first.
"""

from __future__ import annotations

import inspect
import json
import random
import socket
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from graphlib import TopologicalSorter
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions.scalars import row_key
from gridweave.schema import DIAG, FILE_REF, Flex, Returns, arrow_type, lossless, lossless_column, stored_value, validate_row
from gridweave.sources.events import sending

ERRORS = ("propagate", "keep", "omit", "stop")
CANCELS = ("deps", "all", "none")
#: Seconds that a retry waits at most, and that one may keep a task's core waiting.
LONGEST_WAIT, LONGEST_SLEEP = 86_400, 60


def retry_delay(retry: int, backoff: str, base: float) -> float:
    """Seconds before retry number ``retry`` (from 1)."""
    wait = {"none": 0.0, "fixed": base, "linear": base * retry, "exponential": base * 2 ** (retry - 1)}[backoff]
    return min(wait, LONGEST_WAIT)


def should_retry(error: Exception, kind: str, rule: tuple[str, ...] | Callable | None) -> bool:
    """Whether a rule takes an error: names of its class or of one that it derives from, or a function of the error; one that
    fails takes nothing. No rule takes all."""
    if rule is None:
        return True
    if callable(rule):
        try:
            return bool(rule(error))
        except Exception:
            return False
    return kind in rule or any(c.__name__ in rule for c in type(error).__mro__)


class StageError(Exception):
    """An error of a stage with a class of its own."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Stage:
    """``does`` is a dict of columns (or SQL text) by output, or a function of the values it names in its signature that
    returns a dict, or one value for a single output.

    A function sees the grid's columns, the outputs of earlier stages by their bare names, those of stages it needs also
    as ``stage_output``, and ``constants``. ``skip_when`` is a column, SQL text or function for either kind of stage. With
    ``io_mode`` "error" a null or missing one of ``inputs``, one of ``input_artifacts`` that is no file reference, and one of
    ``outputs`` (by default all declared) that is not returned are failures; with "warn" they are told in the record of
    a stage that goes on. ``hoist_struct`` makes a column ``id.output$field`` of each field of outputs that are records.
    Stages of columns have no sink and no retries: the same expression gives the same again.
    """

    id: str
    does: dict[str, Column | str] | Callable
    schema: Returns
    needs: tuple[str, ...] = ()
    prefix: bool = True
    skip_when: Column | str | Callable | None = None
    constants: dict[str, Any] = field(default_factory=dict)
    inputs: tuple[str, ...] = ()
    input_artifacts: tuple[str, ...] = ()
    outputs: tuple[str, ...] | None = None
    io_mode: str = "off"
    retries: int | None = None
    backoff: str | None = None
    base: float | None = None
    retry_on: tuple[str, ...] | Callable | None = None
    resources: dict[str, Any] = field(default_factory=dict)
    sink: Any = None
    hoist_struct: bool = False

    def __post_init__(self) -> None:
        if self.io_mode not in ("off", "warn", "error"):
            raise ValueError(f"stage {self.id}: unknown io_mode {self.io_mode}")
        refused = [n for n in ("sink", "retries", "backoff", "base", "retry_on") if getattr(self, n) is not None]
        if self.is_columns and refused:
            raise ValueError(f"stage {self.id}: a stage of columns takes no {', '.join(refused)}")
        if self.is_columns and any(isinstance(kind, Flex) and (kind.stored != T.VariantType() or kind.held_by(F.lit(None).cast(kind.stored)) is None) for _, kind in self.schema.fields):
            raise ValueError(f"stage {self.id}: a stage of columns has Spark's types only, and variants of them")
        for rule in self.schema.rules:
            if rule.name not in dict(self.schema.fields):
                raise ValueError(f"stage {self.id}: there is no output {rule.name} to have a rule")

    def named(self, output: str) -> str:
        return f"{self.id}.{output}" if self.prefix else output

    @property
    def is_columns(self) -> bool:
        return isinstance(self.does, dict)

    @property
    def expected(self) -> tuple[str, ...]:
        """The outputs that must be returned."""
        return tuple(name for name, _ in self.schema.fields) if self.outputs is None else self.outputs

    def arguments(self) -> list[str]:
        """What the function takes; all there is if it has a catch-all."""
        takes = inspect.signature(self.does).parameters.values()
        return [p.name for p in takes if p.kind is not inspect.Parameter.VAR_KEYWORD]


@dataclass(frozen=True)
class Flow:
    """``validate``: light or full, for types that are checked by predicates. ``events``: a folder that all executors share,
    to which :mod:`gridweave.sources.events` writes what functions tell of themselves."""

    grid: DataFrame
    stages: tuple[Stage, ...] = ()
    error: str = "propagate"
    cancel: str = "deps"
    retries: int = 0
    backoff: str = "none"
    base: float = 0.0
    retry_on: tuple[str, ...] | Callable | None = None
    seed_col: str | None = None
    resources: dict[str, Any] = field(default_factory=dict)
    validate: str = "light"
    run_id: str | None = None
    events: str | None = None

    def __post_init__(self) -> None:
        if self.error not in ERRORS or self.cancel not in CANCELS:
            raise ValueError("unknown error or cancel mode")

    def stage(self, id: str, does: Any, schema: Returns, **options: Any) -> Flow:
        """The flow with one more stage."""
        return self.add_stage(Stage(id, does, schema, **options))

    def add_stage(self, stage: Stage) -> Flow:
        if any(s.id == stage.id for s in self.stages):
            raise ValueError(f"there is a stage {stage.id} already")
        return replace(self, stages=(*self.stages, stage))

    def ordered(self) -> list[Stage]:
        """The stages by levels of what they need, those of a level as they were added."""
        by = {s.id: s for s in self.stages}
        for s in self.stages:
            if missing := [n for n in s.needs if n not in by]:
                raise ValueError(f"stage {s.id} needs {missing}")
        sorter, out = TopologicalSorter({s.id: s.needs for s in self.stages}), []
        sorter.prepare()
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=[s.id for s in self.stages].index)
            out += [by[r] for r in ready]
            sorter.done(*ready)
        return out

    def collect(self, limit: int | None = None, ordinal: str = "ordinal") -> DataFrame:
        """The result as a lazy DataFrame; ``limit`` takes the first rows of the grid's order."""
        grid = self.grid if limit is None else self.grid.orderBy(ordinal).limit(limit)
        names = grid.columns
        df = grid.withColumns({"row_id": row_key(*names), ".diag": F.array().cast(T.ArrayType(DIAG))})
        done: list[Stage] = []
        for stage in self.ordered():
            df = _staged(df, self, stage, names, done)
            done.append(stage)
        return self.finished(df)

    def finished(self, df: DataFrame) -> DataFrame:
        """Rows with the records of all stages under the flow's policy for errors, with ``.ok`` and hoisted records."""
        ok = F.forall(F.col("`.diag`"), lambda d: d["ok"] | d["skipped"])
        if self.error == "omit":
            df = df.where(ok)
        if self.error == "stop":
            # A filter, so that no choice of columns goes past it.
            first = F.element_at(F.filter(F.col("`.diag`"), lambda d: ~d["ok"] & ~d["skipped"]), 1)
            bad = F.raise_error(F.concat(F.lit("stage "), first["stage"], F.lit(": "), F.coalesce(first["error_message"], F.lit("failed"))))
            df = df.where(F.when(ok, F.lit(True)).otherwise(bad.cast("boolean")))
        df = df.withColumn(".ok", ok)
        hoisted = {s.named(n): [f.name for f in kind] for s in self.stages if s.hoist_struct for n, kind in s.schema.fields if isinstance(kind, T.StructType) and kind != FILE_REF}
        return df.select(*[c for name in df.columns for c in ([F.col(f"`{name}`.`{f}`").alias(f"{name}${f}") for f in hoisted[name]] if name in hoisted else [F.col(f"`{name}`")])])


def flow(grid: DataFrame, **options: Any) -> Flow:
    return Flow(grid, **options)


pipeline = flow


def _column(value: Column | str) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def _is_ok(stage: str) -> Column:
    """Whether a stage ran and succeeded; skipped ones did not."""
    return F.exists(F.col("`.diag`"), lambda d: (d["stage"] == stage) & d["ok"])


def _cancelled(flow: Flow, stage: Stage) -> Column:
    """Cancellation exists under propagate only."""
    if flow.error != "propagate" or flow.cancel == "none":
        return F.lit(False)
    out = F.lit(False)
    for n in stage.needs:
        out = out | ~_is_ok(n)
    if flow.cancel == "all":
        out = out | F.exists(F.col("`.diag`"), lambda d: ~d["ok"] & ~d["skipped"])
    return out


def raises(value: Column) -> Column:
    """Whether evaluating a column raises an error for a row. ``try_to_binary`` is null where what it is given raises; the
    JSON of a value is text whatever its type. A Python UDF inside is not guarded."""
    return F.try_to_binary(F.coalesce(F.to_json(F.struct(value.alias("v"))), F.lit("{}")), F.lit("utf-8")).isNull()


#: Formats in which JSON keeps times to the microsecond.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _deterministic(df: DataFrame, value: Column) -> bool:
    return bool(df.select(value.alias("v"))._jdf.queryExecution().analyzed().expressions().head().deterministic())


def _once(value: Column) -> Column:
    """A column that gives something else each time it is evaluated, as bytes that are made once for each row, as Spark
    copies no such expression; null where it raises an error."""
    return F.try_to_binary(F.to_json(F.struct(value.alias("v")), _TIMES), F.lit("utf-8"))


def _again(made: str, kind: T.DataType) -> Column:
    """The value from such bytes."""
    return F.from_json(F.decode(F.col(made), "utf-8"), T.StructType([T.StructField("v", kind)]), _TIMES)["v"]


def _visible(stage: Stage, grid: list[str], done: list[Stage]) -> dict[str, str]:
    """The names that functions of a stage see, and the columns that they are."""
    out = {name: s.named(name) for s in done for name, _ in s.schema.fields}
    out |= {name: name for name in grid}
    return out | {f"{s.id}_{name}": s.named(name) for s in done if s.id in stage.needs for name, _ in s.schema.fields}


def _packed(df: DataFrame, function: Callable, visible: dict[str, str], extra: list[str] = ()) -> tuple[Column, list[str], list[str]]:
    """A struct of the columns that a function names (all with a catch-all), the names of its fields, and which of them are
    variants, which go as JSON."""
    parameters = inspect.signature(function).parameters
    wide = any(p.kind is inspect.Parameter.VAR_KEYWORD for p in parameters.values())
    taken = [n for n in visible if wide or n in parameters or n in extra]
    own = {n: F.col(f"`{visible[n]}`") for n in taken}
    open_ = [n for n in taken if isinstance(df.schema[visible[n]].dataType, T.VariantType)]
    return F.struct(F.lit(0).alias("_"), *[(F.to_json(c) if n in open_ else c).alias(f"a{k}") for k, (n, c) in enumerate(own.items())]), taken, open_


def _rows(batch: pa.Array, names: list[str], variants: list[str]) -> list[dict[str, Any]]:
    """Packed columns as arguments; maps are dicts."""
    columns = [[dict(v) if v is not None else None for v in c.to_pylist()] if pa.types.is_map(c.type) else c.to_pylist() for c in (batch.field(k + 1) for k in range(len(names)))]
    columns = [[None if v is None else json.loads(v) for v in c] if n in variants else c for n, c in zip(names, columns, strict=True)]
    return [dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True)] if names else [{} for _ in range(len(batch))]


def _takes(function: Callable, arguments: dict[str, Any]) -> dict[str, Any]:
    parameters = inspect.signature(function).parameters
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in parameters.values()):
        return arguments
    return {k: v for k, v in arguments.items() if k in parameters}


def _skips(df: DataFrame, stage: Stage, visible: dict[str, str]) -> Column:
    """An error in the condition means that the stage is not skipped."""
    test = stage.skip_when
    if test is None:
        return F.lit(False)
    if not callable(test) or isinstance(test, Column):
        test = _column(test)
        return F.when(raises(test), F.lit(False)).otherwise(F.coalesce(test, F.lit(False)))
    packed, names, variants = _packed(df, test, visible)
    constants = stage.constants

    def one(arguments: dict[str, Any]) -> bool:
        try:
            return bool(test(**_takes(test, constants | arguments)))
        except Exception:
            return False

    @F.arrow_udf("boolean")
    def found(batch: pa.Array) -> pa.Array:
        return pa.array([one(row) for row in _rows(batch, names, variants)], pa.bool_())

    return found(packed)


def _lost_inputs(df: DataFrame, stage: Stage, visible: dict[str, str]) -> Column:
    """The inputs that are missing or no artifacts, as a message; null if none."""
    if stage.io_mode == "off":
        return F.lit(None).cast("string")

    def lost(name: str, artifact: bool) -> Column:
        if name in stage.constants and not artifact:
            return F.lit(stage.constants[name] is None)
        if name not in visible or (artifact and df.schema[visible[name]].dataType != FILE_REF):
            return F.lit(True)
        return F.col(f"`{visible[name]}`").isNull()

    def told(kind: str, names: tuple[str, ...], artifact: bool) -> Column:
        gone = F.array_compact(F.array(*[F.when(lost(n, artifact), F.lit(n)) for n in names], F.lit(None).cast("string")))
        return F.when(F.size(gone) > 0, F.concat(F.lit(f"{kind}: "), F.array_join(gone, ", ")))

    return F.coalesce(told("missing_input", stage.inputs, False), told("not_artifact_input", stage.input_artifacts, True))


def _staged(df: DataFrame, flow: Flow, stage: Stage, grid: list[str], done: list[Stage], wave: int | None = None) -> DataFrame:
    """A stage's outputs and its record. With ``wave`` a function is called once, as the attempt of that number, and a column
    ``_retry`` tells whether a failure is one to try again."""
    visible = _visible(stage, grid, done)
    none = F.lit(None).cast("string")
    df = df.withColumns({"_cancelled": _cancelled(flow, stage), "_lost": _lost_inputs(df, stage, visible), "_skip": _skips(df, stage, visible)})
    df = df.withColumns({"_skipped": F.col("_skip") & ~F.col("_cancelled")})
    idle = F.col("_cancelled") | F.col("_skipped")
    barred = F.col("_lost").isNotNull() & F.lit(stage.io_mode == "error")
    df = df.withColumn("_run", ~idle & ~barred)
    df = _columns_made(df, stage) if stage.is_columns else _function_made(df, flow, stage, visible, done, wave)

    # What went wrong, as "kind: message"; the first of a lost input, an error of the stage's own, a broken rule.
    broken = none
    for name, kind in stage.schema.fields:
        # A sink's fields were looked at before they became files.
        if (rule := stage.schema.rule(name)) is not None and (stage.sink is None or name not in stage.sink.fields):
            rest = rule.broken(F.col(f"_v_{name}"), kind.stored if isinstance(kind, Flex) else kind)
            broken = F.coalesce(broken, F.when(rest.isNotNull(), F.concat(F.lit(f"{name}: "), rest)))
    wrong = none
    if stage.is_columns:
        # Functions' values were looked at as they came.
        for name, kind in stage.schema.fields:
            if isinstance(kind, Flex):
                held = F.coalesce(kind.held_by(F.col(f"_v_{name}")), F.lit(False))
                wrong = F.coalesce(wrong, F.when(~held, F.lit(f"{name}: is not {kind.name}")))
    going = F.col("_run") & F.col("_error").isNull()
    df = df.withColumns({"_wrong": F.when(going, wrong), "_broken": F.when(going, broken)})
    lost = F.when(~idle & barred, F.split_part("_lost", F.lit(": "), F.lit(1)))
    # After a cancellation there is nothing else to tell; a warning is told beside what is well.
    kind_of = F.coalesce(F.when(F.col("_cancelled"), "cancelled"), lost, F.col("_kind"), F.when(F.col("_wrong").isNotNull(), "validation"), F.when(F.col("_broken").isNotNull(), "contract"))
    warned = F.concat_ws("; ", F.when(F.lit(stage.io_mode == "warn"), F.col("_lost")), F.col("_warning"))
    message = F.coalesce(F.when(F.col("_cancelled"), "a stage before it did not succeed"), F.when(lost.isNotNull(), F.col("_lost")), F.col("_error"), F.col("_wrong"), F.col("_broken"), F.when(~idle & (warned != ""), warned))
    df = df.withColumns({"_kind": kind_of, "_message": message})
    failed = ~idle & F.col("_kind").isNotNull()
    status = F.when(F.col("_cancelled"), "cancelled").when(F.col("_skipped"), "skipped").when(failed, "failed").otherwise("completed")
    outputs = {stage.named(name): F.when(F.col("_run") & ~failed, F.col(f"_v_{name}")) for name, _ in stage.schema.fields}
    # The partition is a nondeterministic expression: filters on what comes out are not pushed through stages, where each
    # would be written out once for every use of the one before it and grow without end.
    place = F.coalesce(F.col("_host"), F.concat(F.lit("partition "), F.spark_partition_id().cast("string")))
    record = F.struct(
        F.lit(stage.id).alias("stage"), (~idle & ~failed).alias("ok"), F.col("_skipped").alias("skipped"), status.alias("status"), F.col("_began").alias("started_at"), F.col("_ended").alias("ended_at"),
        F.coalesce((F.unix_micros("_ended") - F.unix_micros("_began")) / 1000, F.lit(0.0)).alias("duration_ms"), place.alias("host"), F.when(F.col("_run"), F.col("_attempt")).otherwise(0).alias("attempt"),
        F.when(F.col("_run"), F.col("_attempt") - 1).otherwise(0).alias("retry_count"), none.cast("double").alias("queue_ms"), F.col("_kind").alias("error_class"), F.col("_message").alias("error_message"),
    )
    df = df.withColumns(outputs | {".diag": F.concat("`.diag`", F.array(record.cast(DIAG)))})
    return df.drop("_cancelled", "_skip", "_skipped", "_lost", "_run", "_error", "_kind", "_warning", "_wrong", "_broken", "_message", "_began", "_ended", "_host", "_attempt", *[f"_v_{n}" for n, _ in stage.schema.fields])


def _columns_made(df: DataFrame, stage: Stage) -> DataFrame:
    """Expressions are evaluated where nothing keeps the stage from running; one that raises makes its row fail."""
    none = F.lit(None).cast("string")
    made = {name: _column(stage.does[name]) for name, _ in stage.schema.fields if name in stage.does}
    drawn = {name: f"_drawn_{name}" for name, value in made.items() if not _deterministic(df, value)}
    kinds = {name: df.select(made[name].alias("v")).schema["v"].dataType for name in drawn}
    df = df.withColumns({to: _once(F.when(F.col("_run"), made[name])) for name, to in drawn.items()})
    failing = {name: F.col(drawn[name]).isNull() if name in drawn else raises(F.when(F.col("_run"), value)) for name, value in made.items()}
    made |= {name: _again(to, kinds[name]) for name, to in drawn.items()}
    raised = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in failing.items()], none))
    now = F.current_timestamp()
    absent = [n for n in stage.expected if n not in stage.does]
    missing = F.lit(f"missing_output: {', '.join(absent)}") if absent else none
    df = df.withColumns({"_raised": raised, "_began": now, "_ended": now, "_host": none, "_attempt": F.lit(1), "_warning": missing if stage.io_mode == "warn" else none})
    error = F.when(F.size("_raised") > 0, F.concat(F.lit("raised an error: "), F.array_join("_raised", ", ")))
    kind = F.when(F.size("_raised") > 0, "expression")
    if absent and stage.io_mode == "error":
        error, kind = missing, F.lit("missing_output")
    df = df.withColumns({"_error": F.when(F.col("_run"), error), "_kind": F.when(F.col("_run"), kind)})
    values = {}
    for name, kind in stage.schema.fields:
        if name in made:
            own = df.select(made[name].alias("v")).schema["v"].dataType
            stored = kind.stored if isinstance(kind, Flex) else kind
            values[f"_v_{name}"] = F.when(F.col("_run") & F.col("_error").isNull(), lossless_column(made[name], own, stored))
        else:
            values[f"_v_{name}"] = F.lit(None).cast(kind.stored if isinstance(kind, Flex) else kind)
    return df.withColumns(values).drop("_raised", *drawn.values())


def _function_made(df: DataFrame, flow: Flow, stage: Stage, visible: dict[str, str], done: list[Stage], wave: int | None) -> DataFrame:
    """The function over the columns it names; rows where it is not to run are passed by."""
    # A sink names its files by the row's parameters, so it sees the grid.
    seed = [flow.seed_col] if flow.seed_col in visible else []
    packed, names, variants = _packed(df, stage.does, visible, [*seed, *(visible if stage.sink is not None else [])])
    fields = [(name, kind.stored if isinstance(kind, Flex) else kind) for name, kind in stage.schema.fields]
    told = [("_error", T.StringType()), ("_kind", T.StringType()), ("_warning", T.StringType()), ("_attempt", T.IntegerType()), ("_host", T.StringType()), ("_retry", T.BooleanType()), ("_from", T.LongType()), ("_to", T.LongType())]
    made_of = [(f"_v_{name}", T.StringType() if isinstance(kind, T.VariantType) else kind) for name, kind in fields]
    out = T.StructType([T.StructField(n, t) for n, t in [*told, *made_of]])
    shape = arrow_type(out)
    options = (flow.validate, flow.retries, flow.backoff, flow.base, flow.retry_on, flow.seed_col, flow.run_id, flow.events, wave)
    # References that a function is given as values.
    sources = {s.named(f): (s.sink, f) for s in done if s.sink is not None and s.sink.autoload for f in s.sink.fields}
    loads = {n: sources[visible[n]] for n in names if visible[n] in sources}

    # A condition that is a column stays here.
    bare = replace(stage, skip_when=None)

    def work(batch: pa.Array, run: pa.Array, row_id: pa.Array) -> pa.Array:
        rows = [_attempted(bare, a, options, i, loads) if r else None for a, r, i in zip(_rows(batch, names, variants), run.to_pylist(), row_id.to_pylist(), strict=True)]
        return pa.array(rows, shape)

    # Not deterministic, as retries and files are not to happen again for each column that is read.
    work.__annotations__ = {"batch": pa.Array, "run": pa.Array, "row_id": pa.Array, "return": pa.Array}
    made = F.arrow_udf(work, out).asNondeterministic()
    df = df.withColumn("_made", made(packed, F.col("_run"), F.col("row_id")))
    got = {n: F.col(f"_made.{n}") for n in out.names if n not in ("_from", "_to") and (n != "_retry" or wave is not None)}
    got |= {f"_v_{n}": F.parse_json(F.col(f"_made._v_{n}")) for n, kind in fields if isinstance(kind, T.VariantType)}
    return df.withColumns(got | {"_began": F.timestamp_micros("_made._from"), "_ended": F.timestamp_micros("_made._to")}).drop("_made")


def _attempted(stage: Stage, arguments: dict[str, Any], options: tuple, row_id: str, loads: dict[str, tuple]) -> dict[str, Any]:
    """One row: the call and its retries, or the one attempt of a wave."""
    validate, retries, backoff, base, retry_on, seed_col, run_id, events, wave = options
    most = stage.retries if stage.retries is not None else retries
    rule = retry_on if stage.retry_on is None else stage.retry_on
    if seed_col is not None and arguments.get(seed_col) is not None:
        _seed(f"{arguments[seed_col]}")
    began, attempt = time.time_ns(), 0 if wave is None else wave - 1
    with sending(events, {"run_id": run_id, "row_id": row_id, "stage": stage.id}) as context:
        while True:
            attempt += 1
            context["attempt"] = attempt
            try:
                given = arguments | {n: sink.value_of(f, arguments[n]) for n, (sink, f) in loads.items()}
                values, warning = _called(stage, stage.constants | given, validate)
                record = {f"_v_{k}": v for k, v in values.items()} | {"_warning": warning}
                break
            except Exception as e:  # a stage's own error, which the flow's policy decides on
                kind = e.kind if isinstance(e, StageError) else type(e).__name__
                again = attempt <= most and should_retry(e, kind, rule)
                record = {"_error": str(e), "_kind": kind, "_retry": again}
                if not again or wave is not None:
                    break
                time.sleep(min(LONGEST_SLEEP, retry_delay(attempt, stage.backoff or backoff, base if stage.base is None else stage.base)))
    return record | {"_attempt": attempt, "_host": socket.gethostname(), "_from": began // 1000, "_to": time.time_ns() // 1000}


def _seed(text: str) -> None:
    """Python's and numpy's own generators, so that a row draws the same in any task."""
    import numpy as np

    random.seed(text)
    np.random.seed(zlib.crc32(text.encode()))


def _called(stage: Stage, arguments: dict[str, Any], validate: str) -> tuple[dict[str, Any], str | None]:
    """The declared outputs of one call, cast without loss, and a warning; what does not fit is null, what breaks a rule
    an error."""
    made = stage.does(**_takes(stage.does, arguments))
    if not isinstance(made, dict):
        if len(stage.schema.fields) != 1:
            raise TypeError("several outputs are declared and one value is returned")
        made = {stage.schema.fields[0][0]: made}
    warning = None
    if stage.io_mode != "off" and (absent := [n for n in stage.expected if n not in made]):
        warning = f"missing_output: {', '.join(absent)}"
        if stage.io_mode == "error":
            raise StageError("missing_output", warning)
    if wrong := validate_row(made, stage.schema, validate):
        raise StageError("validation", "; ".join(wrong))
    out = {}
    for name, kind in stage.schema.fields:
        rule = stage.schema.rule(name)
        if rule is not None and (broken := rule.holds(made.get(name))):
            raise StageError("contract", f"{name}: {broken}")
        if stage.sink is not None and name in stage.sink.fields:
            out[name] = made.get(name)
        elif isinstance(kind, Flex):
            out[name] = stored_value(made.get(name), kind)
        else:
            try:
                out[name] = lossless(made.get(name), kind)
            except TypeError:
                out[name] = None
    if stage.sink is not None:
        values, out = out, stage.sink.written(stage.id, out, arguments)
        if stage.sink.autoload and not hasattr(stage.sink, "kinds"):
            out |= {n: lossless(values[n], kind) for n, kind in stage.schema.fields if n in stage.sink.fields and n in values and kind != FILE_REF and not isinstance(kind, Flex)}
    return out, warning


def _plain(value: Any) -> Any:
    """A value as a function sees it: no NaN for null, no numpy scalars."""
    if hasattr(value, "item") and not hasattr(value, "__len__"):
        value = value.item()
    return None if isinstance(value, float) and value != value or value.__class__.__name__ in ("NaTType", "NAType") else value


def map_rows(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """A function of the columns it names over every row, in Arrow batches; it returns a dict or a single value."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken = [c for c in df.columns if c in inspect.signature(function).parameters]

    def work(frames):
        import pandas as pd

        for frame in frames:
            made = [function(**{c: _plain(v) for c, v in zip(taken, row, strict=True)}) for row in frame[taken].itertuples(index=False, name=None)]
            rows = [m if isinstance(m, dict) else {out[0].name: m} for m in made]
            yield pd.DataFrame({f.name: pd.Series([r.get(f.name, frame[f.name].iloc[k] if f.name in frame else None) for k, r in enumerate(rows)], dtype=object) for f in out})

    return df.mapInPandas(work, out)
