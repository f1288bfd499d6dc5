"""Stages of columns and of functions under every policy: the same rows, records and outputs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from gridweave import schema as S
from gridweave.operators import diagnostics as D
from gridweave.operators.flow import flow
from gridweave.plans.flow_plan import dry_run, explain, flow_plan
from gridweave.schema import Flex
from gridweave.sources import events as E
from gridweave.sources import run_store as R
from gridweave.sources.catalog import SIDECAR, Sink, artifact_catalog, file_ref_of, is_file_ref, manifest, manifest_clear, temporary_sink

KINDS = {"columns": {"y": "6 div x"}, "function": lambda x: 6 // x}
ONE = S.returns(y=S.int_())


def numbers(spark, *values):
    return spark.createDataFrame([(v, k) for k, v in enumerate(values)], "x long, ordinal long")


def both(column, function):
    return {"columns": column, "function": function}


def records(out):
    return [(r.x, r.stage, r.status, r.ok, r.error_class) for r in out.select("x", "ordinal", F.inline("`.diag`")).orderBy("ordinal", "stage").collect()]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("error", ["propagate", "keep", "omit", "stop"])
def test_error_modes(spark, kind, error):
    second = both({"z": "coalesce(`inv.y`, -1) + 1"}, lambda y: (-1 if y is None else y) + 1)[kind]
    out = flow(numbers(spark, 2, 0, 3), error=error).stage("inv", KINDS[kind], ONE).stage("use", second, S.returns(z=S.int_()), needs=("inv",)).collect()
    if error == "stop":
        for columns in (["`inv.y`"], ["ordinal"], ["`.ok`"], ["*"]):
            with pytest.raises(Exception, match="stage inv"):
                out.select(*columns).collect()
        fine = flow(numbers(spark, 2, 3), error=error).stage("inv", KINDS[kind], ONE).collect()
        assert sorted(r[0] for r in fine.select("`inv.y`").collect()) == [2, 3]
        return
    got = [tuple(r) for r in out.orderBy("ordinal").select("x", "`inv.y`", "`use.z`", "`.ok`").collect()]
    middle = {"propagate": [(0, None, None, False)], "keep": [(0, None, 0, False)], "omit": []}[error]
    assert got == [(2, 3, 4, True), *middle, (3, 2, 3, True)]
    if error != "omit":
        name = {"columns": "expression", "function": "ZeroDivisionError"}[kind]
        after = ("cancelled", False, "cancelled") if error == "propagate" else ("completed", True, None)
        assert records(out)[2:4] == [(0, "inv", "failed", False, name), (0, "use", *after)]
        assert [r.x for r in D.failed(out, "inv").collect()] == [0]


@pytest.mark.parametrize("codegen", ["true", "false"])
def test_errors_in_columns(spark, codegen):
    """Whatever an expression may raise, in generated code and without it."""
    spark.conf.set("spark.sql.codegen.wholeStage", codegen)
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK" if codegen == "true" else "NO_CODEGEN")
    for text, bad in (("cast(concat('a', x) as int)", 3), ("x * 9223372036854775807", 1), ("element_at(array(1, 2), cast(x as int))", 1), ("raise_error('no')", 3), ("if(x = 2, raise_error('two'), 'one')", 1)):
        out = flow(numbers(spark, 0, 1, 2), error="keep").stage("s", {"y": text}, S.returns(y=S.chr_())).collect()
        assert out.where("not `.ok`").count() == bad, text
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")


@pytest.mark.parametrize("kind", KINDS)
def test_casts(spark, kind):
    types = {"i": S.int_(), "d": S.dbl(), "c": S.chr_(), "l": S.lgl(), "a": S.lst(S.int_()), "p": S.pack(n=S.int_(), s=S.chr_())}
    cases = [
        ({"i": "2.5D", "d": "3", "c": "3", "l": "1", "a": "array(1, 2)", "p": "named_struct('n', 2.0D, 's', 'q')"}, {"i": 2.5, "d": 3, "c": 3, "l": 1, "a": [1, 2], "p": {"n": 2.0, "s": "q"}}, (None, 3.0, None, True, [1, 2], (2, "q"))),
        ({"i": "2.0D", "d": "double('NaN')", "c": "'t'", "l": "2", "a": "array(1.5D, 2D)", "p": "named_struct('n', 2.5D, 's', 'q')"}, {"i": 2.0, "d": float("nan"), "c": "t", "l": 2, "a": [1.5, 2.0], "p": {"n": 2.5, "s": "q"}}, (2, None, "t", None, None, None)),
        ({"i": "3000000000", "d": "'4'", "c": "true", "l": "'true'", "a": "array(1, null)", "p": "named_struct('n', 1)"}, {"i": 3000000000, "d": "4", "c": True, "l": "true", "a": [1, None], "p": {"n": 1}}, (None, None, None, None, [1, None], (1, None))),
        ({"i": "true", "d": "true", "c": "null", "l": "0.0D", "a": "null"}, {"i": True, "d": True, "c": None, "l": 0.0, "a": None}, (1, 1.0, None, False, None, None)),
    ]
    for columns, values, want in cases:
        out = flow(numbers(spark, 1)).stage("s", both(columns, lambda v=values: v)[kind], S.returns(**types)).collect()
        row = out.select(*[f"`s.{n}`" for n in types]).first()
        assert tuple(tuple(v) if hasattr(v, "asDict") else v for v in row) == want and out.first()[".ok"], columns


@pytest.mark.parametrize("kind", KINDS)
def test_contracts(spark, kind):
    does = both({"y": "x", "t": "if(x < 9, 'a', null)"}, lambda x: {"y": x, "t": "a" if x < 9 else None})[kind]
    rules = {"min": S.ctr_field("y", min=1), "max": S.ctr_field("y", max=6), "choices": S.ctr_field("y", choices=(1, 2, 3, 4, 9)), "predicate": S.ctr_field("y", predicate=lambda c: c % 2 == 1), "type": S.ctr_field("y", type=S.lgl()), "missing": S.ctr_field("t", allow_na=False)}
    bad = {"min": {0}, "max": {9}, "choices": {0}, "predicate": {0, 2}, "type": {2, 9}, "missing": {9}}
    for name, rule in rules.items():
        out = flow(numbers(spark, 0, 1, 2, 9)).stage("s", does, S.returns(y=S.int_(), t=S.chr_(), _contract=(rule,))).collect()
        rows = out.select("x", "`s.y`", F.inline("`.diag`")).collect()
        assert {r.x for r in rows if not r.ok} == bad[name], name
        assert all((r[1] is None, r.error_class, r.error_message) == (True, "contract", f"{rule.name}: {name}") for r in rows if not r.ok)
    with pytest.raises(ValueError, match="no output"):
        flow(numbers(spark, 1)).stage("s", does, S.returns(y=S.int_(), _contract=(S.ctr_field("q", min=0),)))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("skip", ["text", "column", lambda x: x == 2, lambda g: g == 20])
def test_skip_rules(spark, kind, skip):
    skip = {"text": lambda: "x = 2", "column": lambda: F.col("x") == 2}.get(skip, lambda: skip)()
    f = flow(numbers(spark, 1, 2)).stage("g", {"g": "x * 10"}, S.returns(g=S.int_()))
    out = f.stage("s", both({"y": "x"}, lambda x: x)[kind], ONE, skip_when=skip, needs=("g",)).collect()
    assert [(r.x, r[1]) for r in out.orderBy("x").select("x", "`s.y`").collect()] == [(1, 1), (2, None)]
    assert [r[2] for r in records(out)] == ["completed", "completed", "completed", "skipped"]


@pytest.mark.parametrize("kind", KINDS)
def test_a_skip_rule_that_raises_does_not_skip(spark, kind):
    for skip in ("1 div (x - 1) > 0", lambda x: 1 / (x - 1) > 0):
        out = flow(numbers(spark, 1, 2)).stage("s", both({"y": "x"}, lambda x: x)[kind], ONE, skip_when=skip).collect()
        assert [r[2] for r in records(out)] == ["completed", "skipped"]


@pytest.mark.parametrize("kind", KINDS)
def test_inputs_and_outputs(spark, kind):
    grid = numbers(spark, 1, 2).withColumn("m", F.when(F.col("x") == 1, "here"))
    does = both({"y": "x"}, lambda x: {"y": x})[kind]
    wide = S.returns(y=S.int_(), z=S.int_())
    for mode, status, kinds in (("off", "completed", {None}), ("warn", "completed", {None}), ("error", "failed", {"missing_input"})):
        out = flow(grid).stage("s", does, ONE, inputs=("m", "x"), io_mode=mode).collect()
        r = out.where("x = 2").select(F.inline("`.diag`")).first()
        assert (r.status, {r.error_class}, r.error_message) == (status, kinds, None if mode == "off" else "missing_input: m")
        assert out.where("x = 1").select(F.inline("`.diag`")).first().error_message is None
        r = flow(grid).stage("s", does, wide, io_mode=mode).collect().select(F.inline("`.diag`")).first()
        assert (r.status, r.error_class, r.error_message) == {"off": ("completed", None, None), "warn": ("completed", None, "missing_output: z"), "error": ("failed", "missing_output", "missing_output: z")}[mode]
        assert flow(grid).stage("s", does, wide, io_mode=mode, outputs=("y",)).collect().where("not `.ok`").count() == 0
    r = flow(grid).stage("s", does, ONE, input_artifacts=("m",), io_mode="error").collect().select(F.inline("`.diag`")).first()
    assert r.error_class == "not_artifact_input"


def test_what_columns_do_not_take(spark):
    for options in ({"retries": 2}, {"sink": Sink(("y",), "/x")}, {"retry_on": ("A",)}, {"backoff": "fixed"}):
        with pytest.raises(ValueError, match="takes no"):
            flow(numbers(spark, 1)).stage("s", {"y": "x"}, ONE, **options)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_times_of_records(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for does in KINDS.values():
            rows = flow(numbers(spark, 2)).stage("s", does, ONE).collect().select(F.inline("`.diag`")).select(F.unix_seconds("started_at").alias("s"), F.unix_seconds("ended_at").alias("e"), "duration_ms").collect()
            assert abs(rows[0].s - time.time()) < 120 and rows[0].e - rows[0].s <= 1 + rows[0].duration_ms / 1000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_functions_read_what_they_name(spark, tmp_path):
    spark.range(5).selectExpr("id as x", "repeat('w', 100) as wide", "id as other").write.parquet(str(tmp_path / "g"))
    out = flow(spark.read.parquet(str(tmp_path / "g"))).stage("s", lambda x: x, ONE).collect()
    plan = out.drop("row_id").select("`s.y`")._jdf.queryExecution().optimizedPlan().toString()
    udf = plan[plan.index("work(") :].split("\n")[0]
    assert "wide" not in udf.split("a0")[0] and [r[0] for r in out.select("`s.y`").orderBy("`s.y`").collect()] == list(range(5))


def test_long_flows_are_planned_in_proportion(spark):
    f = flow(numbers(spark, *range(50)))
    before = "x"
    for k in range(8):
        f = f.stage(f"s{k}", {"y": f"`{before}` + 1"}, S.returns(y=S.dbl(), _contract=(S.ctr_field("y", min=0, max=40),)), needs=(f"s{k - 1}",) if k else ())
        before = f"s{k}.y"
    began = time.time()
    assert D.failed(f.collect()).count() == 50 - 33 and time.time() - began < 120


def test_flexible_types(spark):
    class Thing:
        pass

    number = S.one_of(S.isa(int), S.isa("float"))
    costly = S.pred(lambda v: v > 1, cost="full")
    assert S.check_type(3, number) and S.check_type(2.5, number) and not S.check_type("3", number)
    assert S.check_type(None, S.maybe(S.isa(Thing))) and not S.check_type(3, S.maybe(S.isa(Thing))) and S.maybe(S.int_()) == S.int_()
    assert S.check_type(0, costly) and not S.check_type(0, costly, "full") and not S.check_type("x", costly, "full")
    assert not S.check_type(1, S.pred(lambda v: time.sleep(5) or True, timeout=0.1)) and S.check_type(1, S.pred(lambda v: True, timeout=5))
    assert S.is_flex(number) and not S.is_flex(S.dbl()) and isinstance(S.blob(dict), Flex) and not S.is_flex(S.blob())
    assert S.validate_row({"a": "s"}, S.returns(a=number, b=number, c=S.dbl())) == ["a: str is not one of several types", "b: missing"]
    shape = S.returns(v=S.one_of(S.isa(int), S.isa(str)), n=S.pred(lambda v: v != 2, stored=S.int_()))
    for validate, ok in (("light", [True, False, False]), ("full", [True, False, False])):
        out = flow(numbers(spark, 1, 2, 3), validate=validate).stage("s", lambda x: {"v": x if x < 3 else [x], "n": x}, shape).collect()
        assert [r[0] for r in out.orderBy("x").select("`.ok`").collect()] == ok
    import pickle

    row = out.orderBy("x").first()
    assert pickle.loads(row["s.v"]) == 1 and row["s.n"] == 1
    assert {r.error_class for r in out.select(F.inline("`.diag`")).collect()} == {None, "validation"}


def test_events_from_stages(spark, tmp_path):
    folder = str(tmp_path / "events")

    def work(x):
        E.heartbeat("on it")
        with_step = x == 2
        if with_step:
            E.step("load")
            E.log("inside", severity="warn", extra=1)
            E.step("load", "completed")
        E.log("done")
        if x == 3:
            raise ValueError("bad")
        return x

    E.log("outside a flow this is nothing")
    out = flow(numbers(spark, 1, 2, 3), run_id="r-1", events=folder, retries=1).stage("s", work, ONE).collect()
    assert out.where("`.ok`").count() == 2
    rows = R.read_lines(spark, folder, R.EVENT)
    counts = {(r.event_type, r.stage, r.severity): r["count"] for r in rows.groupBy("event_type", "stage", "severity").count().collect()}
    assert counts == {("stage_heartbeat", "s", "info"): 4, ("stage_started", "load", "info"): 1, ("user_log", "load", "warn"): 1, ("stage_completed", "load", "info"): 1, ("user_log", "s", "info"): 4}
    assert {(r.run_id, r.attempt) for r in rows.collect()} == {("r-1", 1), ("r-1", 2)}


def test_sinks_of_flows(spark, tmp_path):
    sink = temporary_sink(("m",), str(tmp_path), template="{stage}/{x}", format="json", code_version="v1", schema_signature="s", stage_fingerprint="f")
    out = flow(numbers(spark, 1, 2), run_id="r-9").stage("fit", lambda x: {"m": [x, x + 1]}, S.returns(m=S.file_ref()), sink=sink).collect()
    refs = out.orderBy("x").select("`fit.m`").collect()
    assert json.load(open(refs[1][0].path)) == [2, 3] and is_file_ref(out.schema["fit.m"].dataType)
    rows = artifact_catalog(spark, sink.base).collect()
    assert {r.upstream_run_id for r in rows} == {"r-9"} and all(r[f.name] is not None for r in rows for f in SIDECAR)
    assert manifest(spark, sink.base).where("stage is not null").count() == 2
    made = spark.range(1).select(file_ref_of(F.lit("/p"), F.lit(3), reused=True).alias("r")).first().r
    assert (made.path, made.bytes, made.written, made.existed) == ("/p", 3, False, True)
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "fit.jsonl").write_text("{}")
    assert manifest_clear(spark, str(tmp_path / "done"), "fit") and not manifest_clear(spark, str(tmp_path / "done"), "fit")


def test_plans_of_blocked_stages(spark):
    sink = Sink(("m",), "/a", overwrite="error")
    f = (
        flow(numbers(spark, 1, 2))
        .stage("fit", lambda x: {"m": x}, S.returns(m=S.file_ref()), sink=sink)
        .stage("use", lambda m: {"y": 1}, ONE, needs=("fit",), input_artifacts=("m",), io_mode="error")
        .stage("off", lambda x: {"y": 1}, ONE, input_artifacts=("x",), io_mode="warn")
        .stage("bad", lambda x: {"y": 1}, ONE, input_artifacts=("x",), io_mode="error")
        .stage("end", lambda x: {"y": 1}, ONE, needs=("bad",))
    )
    plan = flow_plan(f, spark.createDataFrame([("/a/1",)], "path string"), {"fit": F.concat(F.lit("/a/"), F.col("x").cast("string"))})
    got = {(r.x, r.stage): (r.action, r.reason_code) for r in plan.collect()}
    assert got == {
        (1, "fit"): ("blocked", "artifact_conflict"), (2, "fit"): ("execute", "artifact_missing"), (1, "use"): ("blocked", "missing_dependency"), (2, "use"): ("execute", "no_sink"),
        **{(x, "off"): ("execute", "warning_missing_artifact") for x in (1, 2)}, **{(x, "bad"): ("blocked", "missing_artifact") for x in (1, 2)}, **{(x, "end"): ("blocked", "missing_dependency") for x in (1, 2)},
    }
    assert sum(r.n for r in dry_run(plan).collect()) == 10
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4
    rows = explain(f, {"cpus": 2})
    assert [(r["stage"], r["needs"], r["inputs"], r["kind"], r["cpus"], r["cpus_source"]) for r in rows][0] == ("fit", "", "x", "function", 2, "profile")


def test_variants_of_both_kinds(spark):
    """Unions and records as variants, from functions and from columns, with rules on paths."""
    number_or_text = S.one_of(S.dbl(), S.chr_(), stored=S.variant())
    some = S.maybe(S.one_of(S.int_(), S.lst(S.int_()), stored=S.variant()))
    deep = S.ctr_field("d", predicate=lambda v: F.variant_get(v, "$.deep", "int") < 3)
    made = lambda x: {"u": x + 0.5 if x % 2 else f"t{x}", "m": None if x == 0 else [x, 1], "d": {"deep": x, "more": [x]}}
    f = flow(numbers(spark, 0, 1, 2, 3), error="keep").stage("f", made, S.returns(u=number_or_text, m=some, d=S.variant(), _contract=(deep,)))
    f = f.stage("use", lambda f_d, f_u: {"n": len(f_d["more"]) + (1 if isinstance(f_u, str) else 0)}, S.returns(n=S.int_()), needs=("f",))
    columns = {"u": "if(x % 2 = 1, to_variant_object(array(x)), cast(x as variant))", "m": "to_variant_object(array(cast(x as int)))", "d": "struct(cast(x as int) as deep)"}
    f = f.stage("c", columns, S.returns(u=number_or_text, m=some, d=S.variant(), _contract=(deep,)))
    rows = {int(r.x): r for r in f.collect().withColumns({c: F.to_json(F.col(f"`{c}`")) for c in ("f.u", "f.m", "f.d", "c.u", "c.d")}).collect()}
    assert [rows[x]["f.u"] for x in range(4)] == ['"t0"', "1.5", '"t2"', None]
    assert [rows[x]["f.m"] for x in range(3)] == [None, "[1,1]", "[2,1]"] and rows[2]["f.d"] == '{"deep":2,"more":[2]}'
    assert [rows[x]["use.n"] for x in range(3)] == [2, 1, 2]
    kinds = {x: [(d.stage, d.error_class) for d in rows[x][".diag"]] for x in range(4)}
    assert kinds[0] == [("f", None), ("c", None), ("use", None)] and kinds[1][1] == ("c", "validation") and kinds[3][0] == ("f", "contract") and kinds[3][1] == ("c", "validation")
    assert rows[2]["c.u"] == "2" and rows[2]["c.d"] == '{"deep":2}'
    bad = flow(numbers(spark, 1), error="keep").stage("b", lambda x: {"v": {1, 2}}, S.returns(v=S.variant())).stage("w", lambda x: {"v": float("nan")}, S.returns(v=number_or_text))
    assert [d.ok for d in bad.collect().first()[".diag"]] == [True, False] and bad.collect().where("`b.v` is null").count() == 1
    with pytest.raises(ValueError, match="Spark's types only"):
        flow(numbers(spark, 1)).stage("p", {"v": "1"}, S.returns(v=S.pred(bool)))


def test_tests_that_run_out_of_time_end():
    import threading
    import time

    beats = []

    def slow(v):
        while True:
            beats.append(v)
            time.sleep(0.01)

    before = threading.active_count()
    assert not S.pred(slow, timeout=0.1).accepts(1)
    time.sleep(0.3)
    count = len(beats)
    time.sleep(0.2)
    assert len(beats) == count and threading.active_count() == before
