import datetime
import os

import pytest
from pyspark.sql import functions as F

from gridweave import schema as S
from gridweave.operators import diagnostics as D
from gridweave.operators.flow import Flow, flow, map_rows, retry_delay
from gridweave.operators.grids import combine_grids, grid, lhs_grid, param_grid
from gridweave.plans.flow_plan import dry_run, flow_fingerprint, flow_plan, preflight, stage_resources
from gridweave.sources.catalog import Sink, artifact_catalog, catalog_search, export_manifest, import_manifest, materialize, verified


def numbers(spark, *values):
    return spark.createDataFrame([(float(v), k) for k, v in enumerate(values)], "x double, ordinal long")


def values(out, column):
    return [r[0] for r in out.orderBy("ordinal").select(F.col(f"`{column}`")).collect()]


def inverse(x):
    if x == 0:
        raise ZeroDivisionError("x is zero")
    return {"y": 1 / x}


ONE = S.returns(y=S.dbl())


def test_simple_and_limit(spark):
    f = flow(numbers(spark, 1, 2, 3)).stage("double", lambda x: {"y": x * 2}, ONE)
    assert values(f.collect(), "double.y") == [2, 4, 6]
    assert f.collect(limit=2).count() == 2


def test_chain_diamond_and_constants(spark):
    f = (
        flow(numbers(spark, 1, 2))
        .stage("s1", lambda x: x + 0.0, S.returns(a=S.dbl()))
        .stage("s2", {"b": "`s1.a` * 2"}, S.returns(b=S.dbl()), needs=("s1",))
        .stage("s3", lambda a, b, k: a + b + k, S.returns(c=S.dbl()), needs=("s1", "s2"), constants={"k": 1})
    )
    assert values(f.collect(), "s3.c") == [4, 7]
    with pytest.raises(ValueError, match="already"):
        f.stage("s1", lambda x: x, ONE)
    with pytest.raises(ValueError, match="needs"):
        flow(numbers(spark, 1)).stage("a", lambda x: x, ONE, needs=("b",)).ordered()


@pytest.mark.parametrize(("error", "kept", "y"), [("keep", 3, [1, None, 0.5]), ("omit", 2, [1, 0.5]), ("propagate", 3, [1, None, 0.5])])
def test_error_modes(spark, error, kept, y):
    out = flow(numbers(spark, 1, 0, 2), error=error).stage("inv", inverse, ONE).collect()
    assert out.count() == kept and values(out, "inv.y") == y


def test_stop(spark):
    with pytest.raises(Exception, match="x is zero"):
        flow(numbers(spark, 1, 0), error="stop").stage("inv", inverse, ONE).collect().collect()


@pytest.mark.parametrize("columns", [False, True])
def test_cancellation_and_skips(spark, columns):
    rule = S.returns(y=S.dbl(), _contract=(S.ctr_field("y", max=10),))
    first = {"y": "x * 4"} if columns else (lambda x: x * 4)
    skip = "x = 2" if columns else (lambda x: x == 2)
    second = {"z": "`s1.y` + 1"} if columns else (lambda y: y + 1)
    out = flow(numbers(spark, 1, 2, 3)).stage("s1", first, rule, skip_when=skip).stage("s2", second, S.returns(z=S.dbl()), needs=("s1",)).collect()
    assert values(out, "s1.y") == [4, None, None] and values(out, "s2.z") == [5, None, None]
    status = {(r.row, r.stage): r.status for r in out.select(F.col("x").alias("row"), F.inline("`.diag`")).collect()}
    assert status == {(1, "s1"): "completed", (2, "s1"): "skipped", (3, "s1"): "failed", (1, "s2"): "completed", (2, "s2"): "cancelled", (3, "s2"): "cancelled"}
    assert values(out, ".ok") == [True, False, False]
    kept = Flow(out.sparkSession.createDataFrame([(2.0, 0)], "x double, ordinal long"), cancel="none").stage("s1", first, rule, skip_when=skip).stage("s2", {"z": "coalesce(`s1.y`, 0) + 1"}, S.returns(z=S.dbl()), needs=("s1",)).collect()
    assert values(kept, "s2.z") == [1] and values(kept, ".ok") == [True]


def test_retries(spark, tmp_path):
    marks = str(tmp_path)

    def flaky(x):
        path = os.path.join(marks, str(int(x)))
        n = int(open(path).read()) if os.path.exists(path) else 0
        with open(path, "w") as f:
            f.write(str(n + 1))
        if n < 2:
            raise OSError("not yet")
        return n * 1.0

    out = flow(numbers(spark, 1, 2), retries=2).stage("f", flaky, ONE).collect().cache()
    assert values(out, "f.y") == [2, 2]
    assert {(r.attempt, r.retry_count) for r in D.diagnostics(out).collect()} == {(3, 2)}
    assert [retry_delay(k, "exponential", 2) for k in (1, 2, 3)] == [2, 4, 8] and retry_delay(3, "linear", 5) == 15 and retry_delay(60, "exponential", 9) == 86_400


def test_casting_is_lossless(spark):
    out = flow(numbers(spark, 1.5, 2)).stage("c", lambda x: {"n": x, "s": 3, "b": 1}, S.returns(n=S.int_(), s=S.chr_(), b=S.lgl())).collect()
    assert [tuple(r) for r in out.orderBy("ordinal").select("`c.n`", "`c.s`", "`c.b`").collect()] == [(None, None, True), (2, None, True)]


def test_prefix_off_and_seed(spark):
    import random

    out = flow(numbers(spark, 7, 7), seed_col="x").stage("r", lambda: random.random(), S.returns(u=S.dbl()), prefix=False).collect()
    u = values(out, "u")
    assert u[0] == u[1] and "u" in out.columns


def test_summary_and_failed(spark):
    out = flow(numbers(spark, 1, 0, 2)).stage("inv", inverse, ONE).collect().cache()
    assert [r.x for r in D.failed(out).collect()] == [0] and D.failed(out, "inv").count() == 1
    s = D.stage_summary(D.attempts(out, "run-1")).first()
    assert (s.total, s.completed, s.failed) == (3, 2, 1)
    r = D.run_summary(out, "run-1").first()
    assert (r.rows, r.failed_rows, r.ok) == (3, 1, False)
    assert D.attempts(out, "run-1").select("attempt_id").distinct().count() == 3
    a = D.diagnostics(out).first()
    assert isinstance(a.started_at, datetime.datetime) and a.duration_ms >= 0


def test_grids(spark):
    g = grid(spark, a=[1, 2, 3], b=["x", "y"], where="not (a = 2 and b = 'x')").orderBy("ordinal")
    assert [(r.a, r.b, r[".grid_id"]) for r in g.collect()] == [(1, "x", 1), (3, "x", 2), (1, "y", 3), (2, "y", 4), (3, "y", 5)]
    assert all(len(r[".grid_hash"]) == 8 for r in g.collect())
    assert param_grid(spark, a=[1, 2], b=[3]).columns == ["a", "b", "ordinal"]
    for n in (1, 7, 50):
        points = [r.p for r in lhs_grid(spark, n, p=(10.0, 20.0)).collect()]
        assert sorted(int((p - 10) / 10 * n) for p in points) == list(range(n))
    both = combine_grids(one=param_grid(spark, a=[1]), two=param_grid(spark, a=[2, 3]))
    assert sorted((r.a, r[".source"]) for r in both.collect()) == [(1, "one"), (2, "two"), (3, "two")]


def test_sink_catalog_and_manifest(spark, tmp_path):
    base = str(tmp_path / "artifacts")
    sink = Sink(("m",), base, template="{stage}/{x}", format="json")
    f = flow(numbers(spark, 1, 2)).stage("fit", lambda x: {"m": [x, x + 1]}, S.returns(m=S.file_ref()), sink=sink)
    f = Flow(f.grid, (f.stages[0].__class__("fit", _list_of, S.returns(m=S.blob()), sink=sink),))
    rows = [sink.written("fit", {"m": [x, 1]}, {"x": x}) for x in (1.0, 2.0)]
    assert rows[0]["m"]["written"] and not sink.written("fit", {"m": 0}, {"x": 1.0})["m"]["written"]
    assert materialize(rows[1]["m"], "json") == [2.0, 1]
    with pytest.raises(FileExistsError):
        Sink(("m",), base, template="{stage}/{x}", format="json", overwrite="error").written("fit", {"m": 0}, {"x": 1.0})
    with pytest.raises(ValueError, match="leaves"):
        Sink(("m",), base, template="../{x}", format="json").written("fit", {"m": 0}, {"x": 1.0})
    found = artifact_catalog(spark, base).collect()
    assert [(r.stage, r.field, r.params["x"]) for r in found] == [("fit", "m", "1.0"), ("fit", "m", "2.0")] and found[0].sha256 == rows[0]["m"]["sha256"]
    assert catalog_search(artifact_catalog(spark, base), "FIT/2", params={"x": 2.0}).count() == 1
    refs = spark.createDataFrame([(r["m"]["path"], r["m"]["sha256"]) for r in rows] + [(base + "/none.json", "0")], "path string, sha256 string")
    assert sorted(r.intact for r in verified(refs, spark, base).collect()) == [False, True, True]
    export_manifest(artifact_catalog(spark, base), str(tmp_path / "manifest"))
    assert import_manifest(spark, str(tmp_path / "manifest")).count() == 2


def _list_of(x):
    return [x]


def test_plan(spark):
    g = numbers(spark, 1, 2, 3)
    f = flow(g, resources={"memory": "4G"}).stage("fit", {"y": "x"}, ONE, resources={"cpus": 8}).stage("use", {"z": "x"}, S.returns(z=S.dbl()), inputs=("nothing",), io_mode="error")
    path = {"fit": F.concat(F.lit("/a/"), F.col("ordinal").cast("string"))}
    plan = flow_plan(f, spark.createDataFrame([("/a/1",)], "path string"), path)
    assert {tuple(r) for r in dry_run(plan).collect()} == {("reuse", "artifact_exists", 1), ("execute", "artifact_missing", 2), ("blocked", "missing_input", 3)}
    res = stage_resources(f, {"cpus": 1, "time": "0:30:00"})
    assert [(r["cpus"], r["cpus_source"], r["memory_source"], r["time_source"]) for r in res] == [(8, "stage", "flow", "profile"), (1, "profile", "flow", "profile")]
    one, again = flow_fingerprint(f).first()[0], flow_fingerprint(Flow(g.repartition(3), f.stages, resources=f.resources)).first()[0]
    assert one == again != flow_fingerprint(Flow(g.where("x > 1"), f.stages)).first()[0]
    assert preflight(f) == [] and preflight(flow(g.limit(0)).stage("s", lambda q: q, ONE)) == ["the grid is empty", "stage s: nothing is named q"]


def test_map_rows(spark):
    out = map_rows(numbers(spark, 1, 2), lambda x: {"z": x * 2}, "x double, z double")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2), (2, 4)]
