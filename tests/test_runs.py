"""Runs that keep what they make: reuse, resumption, retries in waves, files that are committed, values loaded again."""

import os

import pytest
from pyspark.sql import functions as F

from gridweave import schema as S
from gridweave.operators.flow import flow
from gridweave.operators.runs import forget, results_of, run, runs_of, write_result
from gridweave.sources.artifacts import use_artifacts
from gridweave.sources.catalog import Format, Sink, artifact_catalog, verified


def grid(spark, n=6):
    return spark.range(n).select(F.col("id").cast("int").alias("x"))


def calls(path):
    return len(os.listdir(path)) if os.path.isdir(path) else 0


def counted(path, value):
    """Leaves a file for each call."""
    import uuid

    os.makedirs(path, exist_ok=True)
    open(f"{path}/{uuid.uuid4().hex}", "w").close()
    return value


def plain(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def told(spark, store):
    return sorted((r.stage, r.executed, r.reused, r.failed, r.attempts) for r in runs_of(spark, store).collect())


def chain(spark, log, factor=2, rows=6):
    return (
        flow(grid(spark, rows))
        .stage("a", lambda x, log, factor: {"y": counted(f"{log}/a", x * factor)}, S.returns(y=S.int_()), constants={"log": log, "factor": factor})
        .stage("b", {"z": "`a.y` + 1"}, S.returns(z=S.int_()), needs=("a",))
        .stage("c", lambda z, log: {"w": counted(f"{log}/c", z * 10)}, S.returns(w=S.int_()), needs=("b",), constants={"log": log})
        .stage("d", lambda x, log: {"v": counted(f"{log}/d", -x)}, S.returns(v=S.int_()), constants={"log": log})
    )


def test_second_run_calls_nothing_and_a_change_runs_alone(spark, tmp_path):
    log, store = str(tmp_path / "log"), f"file://{tmp_path}/store"
    first, lazy = run(chain(spark, log), store), chain(spark, f"{log}-lazy").collect()
    columns = ["x", "a.y", "b.z", "c.w", "d.v", ".ok"]
    assert first.columns == lazy.columns
    assert plain(first, *columns) == plain(lazy, *columns) == [(x, 2 * x, 2 * x + 1, 20 * x + 10, -x, True) for x in range(6)]
    assert [calls(f"{log}/{s}") for s in "acd"] == [6, 6, 6]
    again = run(chain(spark, log), store)
    assert plain(again, *columns) == plain(first, *columns) and [calls(f"{log}/{s}") for s in "acd"] == [6, 6, 6]
    # Two new rows; then another constant of "a", on which "c" depends through "b", and "d" does not.
    run(chain(spark, log, rows=8), store)
    assert [calls(f"{log}/{s}") for s in "acd"] == [8, 8, 8]
    changed = run(chain(spark, log, factor=3, rows=8), store)
    assert [calls(f"{log}/{s}") for s in "acd"] == [16, 16, 8]
    assert plain(changed, "a.y", "d.v") == [(3 * x, -x) for x in range(8)]
    assert ("d", 0, 8, 0, 1) in told(spark, store) and ("a", 8, 0, 0, 1) in told(spark, store)
    assert forget(spark, store, "d")
    run(chain(spark, log, factor=3, rows=8), store)
    assert [calls(f"{log}/{s}") for s in "acd"] == [16, 16, 16]


def test_failures_run_again_and_successes_stay(spark, tmp_path):
    log, store, mended = str(tmp_path / "log"), f"file://{tmp_path}/store", str(tmp_path / "mended")

    def odd(x, log, mended):
        counted(log, 0)
        if x % 2 and not os.path.exists(mended):
            raise ValueError(f"odd {x}")
        return {"y": x}

    f = flow(grid(spark), error="propagate").stage("a", odd, S.returns(y=S.int_()), constants={"log": log, "mended": mended}).stage("b", lambda y: {"z": y + 1}, S.returns(z=S.int_()), needs=("a",))
    assert plain(run(f, store).where("`.ok`"), "x", "b.z") == [(0, 1), (2, 3), (4, 5)] and calls(log) == 6
    stop = flow(f.grid, error="stop").add_stage(f.stages[0]).add_stage(f.stages[1])
    with pytest.raises(Exception, match="stage a: odd"):
        run(stop, store).collect()
    assert calls(log) == 9
    open(mended, "w").close()
    assert plain(run(f, store), "x", "b.z", ".ok") == [(x, x + 1, True) for x in range(6)] and calls(log) == 12


def test_retries_in_waves_hold_no_task(spark, tmp_path):
    waits, log = [], str(tmp_path / "log")

    def third(x, log):
        n = len(os.listdir(f"{log}/{x}")) if os.path.isdir(f"{log}/{x}") else 0
        counted(f"{log}/{x}", 0)
        if x and n < x:
            raise (KeyError if x == 4 else OSError)(f"attempt {n + 1}")
        return {"y": n + 1}

    f = flow(grid(spark, 5), retries=2, backoff="exponential", base=3600.0, retry_on=lambda e: isinstance(e, OSError)).stage("a", third, S.returns(y=S.int_()), constants={"log": log})
    out = run(f, f"file://{tmp_path}/store", wait=waits.append)
    record = lambda r: r[".diag"][0]
    got = {r.x: (r["a.y"], record(r).attempt, record(r).retry_count, record(r).error_class) for r in out.collect()}
    assert got == {0: (1, 1, 0, None), 1: (2, 2, 1, None), 2: (3, 3, 2, None), 3: (None, 3, 2, "OSError"), 4: (None, 1, 0, "KeyError")}
    assert waits == [3600.0, 7200.0] and told(spark, f"file://{tmp_path}/store") == [("a", 5, 0, 2, 3)]


@pytest.mark.parametrize("rule, attempts", [(("OSError",), 3), (("FileNotFoundError",), 3), (("KeyError",), 1), (lambda e: "gone" in str(e), 3), (lambda e: 1 / 0, 1), (None, 3)])
def test_rules_for_retries(spark, rule, attempts):
    def lost(x):
        raise FileNotFoundError("gone")

    out = flow(grid(spark, 1), error="keep", retries=2, retry_on=rule).stage("a", lost, S.returns(y=S.int_())).collect()
    assert out.first()[".diag"][0].attempt == attempts


def two_fields(x):
    return {"a": {"x": x}, "b": [{"k": x, "v": x * 1.5}], "n": x}


def saving(spark, base, n=3, **options):
    sink = Sink(("a", "b"), base, formats={"a": "json", "b": "csv"}, **options)
    return flow(grid(spark, n), error="keep").stage("fmt", two_fields, S.returns(a=S.file_ref(), b=S.file_ref(), n=S.int_()), sink=sink)


def test_fields_have_formats_and_are_loaded_again(spark, tmp_path):
    base = str(tmp_path / "files")
    f = saving(spark, base, autoload=True).stage("use", lambda a, fmt_b: {"y": a["x"] + float(fmt_b["v"].iloc[0])}, S.returns(y=S.dbl()), needs=("fmt",))
    for made in (f.collect, lambda: run(f, f"file://{tmp_path}/store")):
        out = made()
        rows = sorted(out.collect(), key=lambda r: r.x)
        assert [(r["fmt.a"].path.endswith(".json"), r["fmt.b"].path.endswith(".csv"), r["use.y"]) for r in rows] == [(True, True, 2.5 * x) for x in range(3)]
    assert [r["fmt.a"].existed for r in rows] == [True] * 3 and artifact_catalog(spark, base).count() == 6
    refs = out.select(F.col("`fmt.a`.path"), F.col("`fmt.a`.sha256"))
    assert [r.intact for r in verified(refs, spark, base).collect()] == [True] * 3


def test_values_in_place_of_references(spark, tmp_path):
    sink = Sink(("v",), str(tmp_path / "files"), autoload=True)
    f = flow(grid(spark, 3)).stage("write", lambda x: {"v": x}, S.returns(v=S.dbl()), sink=sink).stage("use", lambda write_v: {"y": write_v + 1}, S.returns(y=S.dbl()), needs=("write",))
    for out in (f.collect(), run(f, f"file://{tmp_path}/store")):
        assert plain(out, "write.v", "use.y") == [(x, x + 1) for x in range(3)]
    assert artifact_catalog(spark, sink.base).count() == 3


def test_policies_for_files_that_are_there(spark, tmp_path):
    base = str(tmp_path / "files")
    first = run(saving(spark, base, overwrite="error"), f"file://{tmp_path}/1")
    assert first.where("`.ok` and `fmt.a`.written and not `fmt.a`.existed").count() == 3
    # The same contents again are no conflict, in a run or in a flow that is evaluated twice; others are.
    assert run(saving(spark, base, overwrite="error"), f"file://{tmp_path}/2").where("`.ok` and `fmt.a`.existed and not `fmt.a`.written").count() == 3
    lazy = saving(spark, base, overwrite="error").collect()
    assert lazy.where("`.ok`").count() == lazy.where("`.ok`").count() == 3
    victim = first.where("x = 1").first()["fmt.b"].path
    with open(victim, "a") as h:
        h.write("more")
    out = {r.x: r for r in run(saving(spark, base, overwrite="error"), f"file://{tmp_path}/3").collect()}
    assert [out[x][".ok"] for x in range(3)] == [True, False, True]
    assert (out[1][".diag"][0].error_class, out[1][".diag"][0].error_message, out[1]["fmt.a"]) == ("FileExistsError", victim, None)
    skip = {r.x: r["fmt.b"] for r in run(saving(spark, base), f"file://{tmp_path}/4").collect()}
    assert not skip[1].written and skip[1].sha256 != skip[0].sha256
    assert run(saving(spark, base, overwrite="overwrite"), f"file://{tmp_path}/5").where("`fmt.b`.written and `fmt.b`.existed").count() == 3
    with open(victim) as h:
        assert "more" not in h.read()


def test_rows_that_share_a_place(spark, tmp_path):
    for policy, ok, written in (("skip", 3, 1), ("error", 1, 1), ("overwrite", 3, 1)):
        sink = Sink(("v",), str(tmp_path / policy), template="one", format="json", overwrite=policy)
        f = flow(grid(spark, 3), error="keep").stage("s", lambda x: {"v": x}, S.returns(v=S.file_ref()), sink=sink)
        out = run(f, f"file://{tmp_path}/store-{policy}")
        assert (out.where("`.ok`").count(), out.where("`s.v`.written").count()) == (ok, written)
        assert len({r[0] for r in out.where("`.ok`").select("`s.v`.sha256").collect()}) == 1


def test_failed_jobs_leave_no_file(spark, tmp_path):
    """Neither of tasks that were done; and what one task writes twice is there once."""
    use_artifacts(spark)
    base = str(tmp_path / "files")
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit(f"{base}/"), "id").alias("path"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"), F.lit("{}").alias("sidecar"))
    late = rows.withColumn("content", F.when(F.col("path").endswith("/39"), F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        late.write.format("artifacts").mode("append").save(base)
    assert [f for _, _, names in os.walk(base) for f in names] == []
    with pytest.raises(Exception, match="is not below"):
        rows.withColumn("path", F.lit(f"{base}/../out")).write.format("artifacts").mode("append").save(base)
    rows.write.format("artifacts").mode("append").save(base)
    rows.write.format("artifacts").mode("append").save(base)
    assert sorted(os.listdir(base), key=str) == sorted([str(k) for k in range(40)] + [f"{k}.json" for k in range(40)], key=str)
    got = spark.read.format("artifacts").load(base).where("not path like '%.json'")
    assert {(int(r.path.rsplit("/", 1)[1]), bytes(r.content).decode(), r.bytes) for r in got.collect()} == {(k, str(k), len(str(k))) for k in range(40)}
    assert spark.read.format("artifacts").load(str(tmp_path / "nowhere")).count() == 0


def test_formats_of_ones_own_with_options(spark, tmp_path):
    def write(value, path, mark="."):
        with open(path, "w") as f:
            f.write(mark + str(value))

    own = Format(write, lambda p: open(p).read(), ".txt")
    sink = Sink(("v",), str(tmp_path / "files"), formats={"v": own}, options={"mark": "#"}, autoload=True)
    f = flow(grid(spark, 2)).stage("s", lambda x: {"v": x}, S.returns(v=S.file_ref()), sink=sink).stage("t", lambda v: {"w": v}, S.returns(w=S.chr_()), needs=("s",))
    assert plain(run(f, f"file://{tmp_path}/store"), "t.w") == [("#0",), ("#1",)]
    with pytest.raises(ValueError, match="no fields"):
        Sink(("v",), "/x", formats={"w": "json"})


def test_hoisted_records(spark):
    f = flow(grid(spark, 2)).stage("s", lambda x: {"p": {"a": x, "b": "t"}, "q": x}, S.returns(p=S.pack(a=S.int_(), b=S.chr_()), q=S.int_()), hoist_struct=True).stage("t", lambda p: {"r": p["a"] + 1}, S.returns(r=S.int_()), needs=("s",))
    out = f.collect()
    assert "s.p" not in out.columns and {"s.p$a", "s.p$b", "s.q"} <= set(out.columns)
    assert plain(out, "s.p$a", "s.p$b", "t.r") == [(0, "t", 1), (1, "t", 2)]


def test_results_have_a_record(spark, tmp_path):
    """Counted while they are written; also of what is broken off, and of kept runs."""
    store, path = f"file://{tmp_path}/store", f"file://{tmp_path}/out"
    f = flow(grid(spark), error="keep", run_id="r1").stage("a", {"y": "if(x < 2, 1 div 0, x)"}, S.returns(y=S.int_())).stage("b", lambda x: {"z": 10 // (x - 3)}, S.returns(z=S.int_()))
    got = write_result(f, path, store)
    assert (got["n_rows"], got["ok"], got["failed"], got["failed_by_stage"], got["status"]) == (6, 3, 3, {"a": 2, "b": 1}, "completed")
    assert spark.read.parquet(path).count() == 6
    stop = flow(f.grid, error="stop", run_id="r2").add_stage(f.stages[0])
    with pytest.raises(Exception, match="stage a"):
        write_result(stop, path, store)
    write_result(flow(f.grid, error="omit", run_id="r3").add_stage(f.stages[1]), path, store, made=lambda g: run(g, store))
    rows = {r.run_id: r for r in results_of(spark, store).collect()}
    assert {k: (r.status, r.n_rows, r.failed) for k, r in rows.items()} == {"r1": ("completed", 6, 3), "r2": ("failed", 0, 0), "r3": ("completed", 5, 0)}
    assert "stage a" in rows["r2"].error and len({r.run_key for r in rows.values()}) == 3 and all(r.started_at <= r.ended_at for r in rows.values())
