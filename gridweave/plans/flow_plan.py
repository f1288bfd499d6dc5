"""What a flow would do: a row for each grid row and stage with its action and reason, fingerprints, resources."""

from __future__ import annotations

import hashlib
import inspect
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.scalars import hms, normal_time, parse_hms, parse_memory
from gridweave.operators.flow import Flow, Stage
from gridweave.schema import FILE_REF, Flex

# Reasons in the order in which they are looked for.
REASONS = ("missing_dependency", "missing_input", "missing_artifact", "warning_missing_input", "warning_missing_artifact", "no_sink", "artifact_conflict", "artifact_exists", "overwrite_policy", "artifact_missing")
ACTIONS = {"missing_dependency": "blocked", "missing_input": "blocked", "missing_artifact": "blocked", "artifact_conflict": "blocked", "artifact_exists": "reuse"}


def plan_decision(missing_deps: Column, missing_inputs: Column, missing_artifacts: Column, io_mode: Column, has_sink: Column, exists: Column, overwrite: Column) -> Column:
    """struct(action, reason_code) from what is known of a row and stage: flags and modes."""
    tests = (
        missing_deps,
        (io_mode == "error") & missing_inputs,
        (io_mode == "error") & missing_artifacts,
        (io_mode == "warn") & missing_inputs,
        (io_mode == "warn") & missing_artifacts,
        ~has_sink,
        exists & (overwrite == "error"),
        exists & (overwrite == "skip"),
        exists & (overwrite == "overwrite"),
    )
    out = F.struct(F.lit("execute").alias("action"), F.lit(REASONS[-1]).alias("reason_code"))
    for test, reason in zip(reversed(tests), reversed(REASONS[:-1]), strict=True):
        out = F.when(test, F.struct(F.lit(ACTIONS.get(reason, "execute")).alias("action"), F.lit(reason).alias("reason_code"))).otherwise(out)
    return out


def stage_signature(stage: Stage) -> str:
    """A hash of all that makes a stage what it is."""
    does = {k: str(v) for k, v in stage.does.items()} if stage.is_columns else inspect.getsource(stage.does)
    fields = [(n, t.name if isinstance(t, Flex) else t.simpleString()) for n, t in stage.schema.fields]
    rules = [str(r) for r in stage.schema.rules]
    return hashlib.sha1(json.dumps([stage.id, does, fields, rules, stage.needs, stage.prefix, str(stage.skip_when), stage.constants], sort_keys=True, default=str).encode()).hexdigest()


def flow_fingerprint(flow: Flow) -> DataFrame:
    """One row with a hash of the grid's rows (in any order), the stages and the options. Row hashes are summed, so the
    grid is not sorted and no task sees it whole."""
    row = F.sha1(F.to_json(F.struct(*flow.grid.columns), {"ignoreNullFields": "false"}))
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 10), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(2)]
    stages = json.dumps([stage_signature(s) for s in flow.ordered()] + [flow.error, flow.cancel, flow.retries, flow.backoff, flow.base])
    return flow.grid.agg(F.sha1(F.concat_ws("|", F.count("*").cast("string"), *[F.coalesce(p, F.lit("0")) for p in parts], F.lit(stages))).alias("fingerprint"))


def stage_resources(flow: Flow, defaults: dict[str, object], names: tuple[str, ...] = ("cpus", "memory", "time")) -> list[dict]:
    """Each stage's resources and where they come from: the stage, the flow, the defaults or nowhere."""
    out = []
    for s in flow.ordered():
        row: dict = {"stage": s.id}
        for n in names:
            layer = next((k for k, have in (("stage", s.resources), ("flow", flow.resources), ("profile", defaults)) if have.get(n) is not None), "none")
            row |= {n: {"stage": s.resources, "flow": flow.resources, "profile": defaults, "none": {}}[layer].get(n), f"{n}_source": layer}
        out.append(row)
    return out


def flow_plan(flow: Flow, files: DataFrame | None = None, path: dict[str, Column] | None = None) -> DataFrame:
    """Grid rows by stages with action and reason. ``path``: each sink stage's artifact path as a column of the grid;
    ``files`` (path): what exists. A stage that is blocked blocks what needs it, and its outputs are no inputs of others.
    The grid is read once: each row becomes a list of its stages, which is then taken apart."""
    path, stages = path or {}, flow.ordered()
    grid, none = flow.grid, F.lit(None).cast("string")
    if files is not None and path:
        # A row for each artifact that exists is joined to the few paths of a grid row.
        wanted = grid.withColumns({"_id": F.struct(*grid.columns), "_paths": F.array(*[path[s.id] for s in stages if s.id in path])})
        there = wanted.select("_id", F.explode("_paths").alias("path")).distinct().join(files.select("path").distinct(), "path", "left_semi").groupBy("_id").agg(F.collect_set("path").alias("_there"))
        key = F.sha1(F.to_json(F.col("_id"), {"ignoreNullFields": "false"}))
        rows = wanted.withColumn("_key", key).join(there.select(key.alias("_key"), "_there"), "_key", "left").drop("_key", "_paths", "_id")
    else:
        rows = grid.withColumn("_there", F.array().cast("array<string>"))
    blocked: dict[str, Column] = {}
    maker = {s.named(n): s for s in stages for n, _ in s.schema.fields}
    entries = []
    for position, s in enumerate(stages):
        lost = F.lit(False)
        for n in s.needs:
            lost = lost | blocked[n]

        def gone(names: tuple[str, ...], artifact: bool, needs: tuple[str, ...] = s.needs) -> Column:
            out = F.lit(False)
            for i in names:
                full = next((m for m in (i, *[f"{n}.{i}" for n in needs]) if m in maker or m in grid.columns), None)
                if full is None or artifact and not _is_artifact(maker.get(full), full, grid):
                    return F.lit(True)
                if full in maker:
                    # Not made yet, or by a stage that is blocked.
                    out = out | blocked.get(maker[full].id, F.lit(True))
            return out

        where = path.get(s.id, none)
        has_sink = s.id in path or s.sink is not None
        exists = F.coalesce(F.array_contains("_there", where), F.lit(False)) if s.id in path else F.lit(False)
        over = s.sink.overwrite if s.sink is not None else "skip"
        decision = plan_decision(lost, gone(s.inputs, False), gone(s.input_artifacts, True), F.lit(s.io_mode), F.lit(has_sink), exists, F.lit(over))
        blocked[s.id] = decision["action"] == "blocked"
        entries.append(F.struct(F.lit(s.id).alias("stage"), F.lit(position).alias("stage_order"), where.alias("artifact_path"), F.lit(stage_signature(s)).alias("fingerprint"), decision["action"].alias("action"), decision["reason_code"].alias("reason_code")))
    return rows.select(*[F.col(f"`{c}`") for c in grid.columns], F.inline(F.array(*entries)))


def _is_artifact(stage: Stage | None, name: str, grid: DataFrame) -> bool:
    """Whether a name is that of a sink's field or a file reference of the grid."""
    if stage is None:
        return grid.schema[name].dataType == FILE_REF
    field = next(n for n, _ in stage.schema.fields if stage.named(n) == name)
    return stage.sink is not None and field in stage.sink.fields or dict(stage.schema.fields)[field] == FILE_REF


def explain(flow: Flow, defaults: dict[str, object] | None = None) -> list[dict]:
    """What each stage is, in the order in which they run: needs, inputs, outputs, retries, resources."""
    resources = {r["stage"]: r for r in stage_resources(flow, defaults or {})}
    out = []
    for s in flow.ordered():
        inputs = s.inputs or (() if s.is_columns else tuple(s.arguments()))
        out.append({
            "stage": s.id, "needs": ",".join(s.needs), "inputs": ",".join(inputs), "io_mode": s.io_mode, "fields": ",".join(n for n, _ in s.schema.fields), "outputs": ",".join(s.expected),
            "retries": flow.retries if s.retries is None else s.retries, "backoff": s.backoff or flow.backoff, "kind": "columns" if s.is_columns else "function", **{k: v for k, v in resources[s.id].items() if k != "stage"},
        })
    return out


def larger_memory(one: Column, other: Column) -> Column:
    """The larger of two sizes such as 8G, as it was given; the first of equal ones."""
    return F.when(other.isNotNull() & (one.isNull() | (parse_memory(other) > parse_memory(one))), other).otherwise(one)


def resource_envelope(resources: DataFrame, *by: str) -> DataFrame:
    """The most that any of the rows asks for (cpus, memory and time as text), of each group if ``by`` is given: memory as
    it was given, the least text of equal sizes; time as H:MM:SS. A size or time that says nothing is an error."""
    size, seconds = parse_memory(F.col("memory")), parse_hms(normal_time(F.col("time")))
    long = F.split(normal_time(F.col("time")), ":")
    seconds = F.coalesce(seconds, F.get(long, F.lit(0)).try_cast("double") * 3600 + F.get(long, F.lit(1)).try_cast("double") * 60 + F.get(long, F.lit(2)).try_cast("double"))
    bad = lambda column, parsed, what: F.when(column.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit(f"no {what}: "), column)).cast("double")).otherwise(parsed)
    rows = resources.withColumns({"_size": bad(F.col("memory"), size, "memory"), "_seconds": bad(F.col("time"), seconds, "time")})
    most = F.min(F.when(F.col("_size").isNotNull(), F.struct((-F.col("_size")).alias("s"), F.col("memory").alias("m"))))["m"]
    return rows.groupBy(*by).agg(F.max("cpus").alias("cpus"), most.alias("memory"), hms(F.max("_seconds")).alias("time"))


def dry_run(plan: DataFrame) -> DataFrame:
    """How many rows and stages have each action and reason."""
    return plan.groupBy("action", "reason_code").agg(F.count("*").alias("n"))


def pending_groups(rows: DataFrame, by: list[str], cached: Column) -> DataFrame:
    """Groups that are not cached as a whole."""
    return rows.groupBy(*by).agg(F.bool_and(cached).alias("_all")).where(~F.col("_all")).drop("_all")


def preflight(flow: Flow) -> list[str]:
    """What is wrong with a flow before it runs."""
    out = []
    if flow.grid.isEmpty():
        out.append("the grid is empty")
    if flow.seed_col is not None and flow.seed_col not in flow.grid.columns:
        out.append(f"there is no seed column {flow.seed_col}")
    have = set(flow.grid.columns)
    for s in flow.ordered():
        have_bare = {h.split(".", 1)[-1] for h in have} | {h.replace(".", "_") for h in have} | set(s.constants)
        if not s.is_columns:
            out += [f"stage {s.id}: nothing is named {a}" for a in s.arguments() if a not in have | have_bare and inspect.signature(s.does).parameters[a].default is inspect.Parameter.empty]
        have |= {s.named(n) for n, _ in s.schema.fields}
    return out
