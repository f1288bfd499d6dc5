import datetime
import json

import pytest
from pyspark.sql import functions as F

from gridweave import schema as S
from gridweave.functions import scalars as X
from gridweave.operators import diagnostics as D
from gridweave.operators.flow import flow
from gridweave.operators.grids import describe_grid
from gridweave.operators.ordinals import in_ranges, numbered
from gridweave.operators.partitioning import Dist, balance_by_weight, chunk_by, dealt
from gridweave.plans.flow_plan import larger_memory, resource_envelope
from gridweave.sources import catalog as C
from gridweave.sources import run_store as R
from gridweave.sources.logs import by_time, find_logs, read_log, search_logs, with_context
from gridweave.streaming.watch import event_stream, new_errors, progress, silent, silent_now, watch, windowed_counts


@pytest.fixture
def events(tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    path = str(folder / "e.jsonl")
    for k in range(6):
        R.append_line(path, {"timestamp": f"2024-01-01T00:00:0{k}", "event_type": "chunk_completed" if k % 2 else "stage_error", "severity": "info" if k % 2 else "error", "run_id": "r", "chunk_id": 1, "stage": "s", "row_id": "1", "message": "same" if k < 4 else "other"})
    with open(path, "a") as f:
        f.write('{"event_type": broken\n\n')
    return str(folder)


def test_events(spark, events):
    rows = R.read_lines(spark, events, R.EVENT)
    assert rows.count() == 6
    assert {tuple(r) for r in R.event_counts(rows).collect()} == {("chunk_completed", 3), ("stage_error", 3)}
    assert R.read_events(rows, severity=["error"], last_n=2).count() == 2


def test_registry(spark):
    records = spark.createDataFrame([("a", 1, "running", 3), ("a", 2, "completed", None), ("b", 3, None, 1)], "run_id string, seq long, status string, n long")
    assert sorted(tuple(r) for r in R.compact(records, "run_id", "seq", ["status", "n"]).collect()) == [("a", 1, "completed", 3), ("b", 3, None, 1)]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, None), (3, "z")], "k long, v string")
    assert sorted(tuple(r) for r in R.merged(old, new, "k").collect()) == [(1, "x"), (2, "y"), (3, "z")]
    assert sorted(tuple(r) for r in R.merged(old, new, "k", keep_old=False).collect()) == [(1, "x"), (2, None), (3, "z")]


def test_manifests(spark):
    records = spark.createDataFrame([("h", ["a", "b"], {"a": "/1"}, 1), ("h", ["b", "a"], {"a": "/2"}, 2), ("h", ["a"], {"a": "/1"}, 3)], "param_hash string, output_names array<string>, output_paths map<string,string>, seq long")
    wanted = spark.createDataFrame([("h", ["a", "b"])], "param_hash string, output_names array<string>")
    assert R.manifest_latest(records, wanted, "seq").first().seq == 2
    assert R.manifest_latest(records, wanted, "seq", spark.createDataFrame([("/1",)], "path string")).first().seq == 1
    params = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "1"}), (3, {"a": "9"}), (4, {"a": "1", "b": "2"})], "id long, params map<string,string>")
    assert sorted(tuple(r) for r in R.manifest_subset(params, params).collect()) == [(1, 2), (4, 2)]
    assert R.adopted(params.withColumn("param_hash", F.lit("")), {"b": "7"}).count() == 2


def test_ordinals_with_a_hot_group(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 30).cast("string"))).alias("g"))
    got = {(r.g, r.o): r.row_number for r in numbered(df, "o", ("g",), parts=16).collect()}
    for g in {k[0] for k in got}:
        assert [got[k] for k in sorted(k for k in got if k[0] == g)] == list(range(1, 1 + sum(k[0] == g for k in got)))
    chunks = sorted(r.chunk for r in chunk_by(spark.range(10), "id", n_chunks=4).collect())
    assert chunks == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4]
    weights = spark.range(400).select("id", (F.col("id") % 37 + 1).alias("w"))
    sums = [r[1] for r in balance_by_weight(weights, "id", "w", 4).groupBy("group").agg(F.sum("w")).collect()]
    assert len(sums) == 4 and max(sums) - min(sums) < 0.06 * sum(sums) / 4


def test_ordinals_with_gaps(spark):
    """No range has many more rows than another, however the ordinals are spread."""
    sparse = spark.range(20_000).select(F.xxhash64("id").alias("o"))
    uneven = spark.range(20_000).select(F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") * 10**12).alias("o"))
    for df in (sparse, uneven):
        sizes = [r["count"] for r in in_ranges(df, "o", 40).groupBy("_block").count().collect()]
        assert len(sizes) == 40 and max(sizes) < 3 * 500
        got = [r.row_number for r in numbered(df, "o", parts=40).orderBy("o").collect()]
        assert got == list(range(1, 20_001))
    near = spark.range(1000).select((F.col("id") + 2**60).alias("o"))
    assert [r.row_number for r in numbered(near, "o").orderBy("o").collect()] == list(range(1, 1001))
    assert numbered(spark.range(0), "id").count() == 0


def test_weights_of_any_size(spark):
    cases = ["case when id % 4 = 0 then 1e9 else 1e6 end", "case when id % 4 = 0 then 0.5 else 0.001 end", "pow(10, id % 13 - 3) * (1 + (id % 4) * 4)"]
    for weight in cases:
        rows = balance_by_weight(spark.range(520).selectExpr("id", f"{weight} as w"), "id", "w", 4)
        sums = [r[1] for r in rows.groupBy("group").agg(F.sum("w")).collect()]
        heaviest = [r[1] for r in rows.groupBy(F.floor(F.log2("w") * 4)).agg(F.max("w")).collect()]
        assert len(sums) == 4 and max(sums) - min(sums) <= sum(heaviest)
    odd = spark.createDataFrame([(k, (None, 0.0, -2.0, float("nan"), 1e-300, 1e300)[k % 6]) for k in range(48)], "id long, w double")
    counts = balance_by_weight(odd, "id", "w", 4).groupBy("group", F.nanvl("w", F.lit(None).cast("double")).alias("w")).count().collect()
    assert len(counts) == 20 and {(r["count"], r.w is None) for r in counts} == {(2, False), (4, True)}


def test_exact_distinct_values(spark, tmp_path):
    df = spark.range(30_000).select((F.col("id") % 9973).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    assert [tuple(r) for r in describe_grid(df).select("parameter", "rows", "n_distinct").collect()] == [("a", 30_000, 9973), ("b", 30_000, 15_000)]
    events = df.selectExpr("'2024-01-01 00:00:00' as timestamp", "'chunk_completed' as event_type", "'r' as run_id", "a as chunk_id")
    events.write.json(str(tmp_path / "events"))
    assert tuple(progress(events).first()) == ("r", 9973)
    for mode in ("update", "complete"):
        name = f"progress_{mode}"
        progress(event_stream(spark, str(tmp_path / "events"))).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        assert [tuple(r) for r in spark.table(name).collect()] == [("r", 9973)]


def test_logs(spark, tmp_path):
    path = tmp_path / "job-7.err"
    path.write_text("\n".join("ERROR here" if k in (20, 23, 60) else f"line {k}" for k in range(100)) + "\n")
    lines = read_log(spark, str(tmp_path))
    for block in (8, 4096):
        got = sorted((r.line, r.is_match) for r in with_context(lines, F.col("text").startswith("ERROR"), "file", "line", 3, 2, block).collect())
        want = sorted({n for m in (21, 24, 61) for n in range(m - 3, m + 3)})
        assert [g[0] for g in got] == want and [g[0] for g in got if g[1]] == [21, 24, 61]
    long = tmp_path / "many"
    long.mkdir()
    (long / "big.log").write_text("".join(f"{k} " + "x" * (k % 50) + "\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    big = read_log(spark, str(long))
    assert big.select("text").rdd.getNumPartitions() > 4
    assert [(r.line, int(r.text.split(" ")[0])) for r in big.orderBy("line").collect()] == [(k + 1, k) for k in range(3000)]
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")
    two = search_logs(lines, "^ERROR", 1, 2)
    assert sorted((r.line, r.is_match) for r in two.collect()) == [(20, False), (21, True), (22, False), (23, False), (24, True), (25, False)]
    assert search_logs(lines, "^ERROR", 1).where("is_match").count() == 3
    assert by_time(spark.createDataFrame([("b", 2), ("a", 1)], "path string, mtime int")).first().path == "a"
    assert tuple(find_logs(lines, spark.createDataFrame([(7, "FAILED")], "chunk_id long, state string")).select("lines", "chunk_id", "state").first()) == (100, 7, "FAILED")


def test_manifest_subset_of_stages_and_files(spark):
    schema = "id long, stage_id string, params map<string,string>, param_hash string, output_paths map<string,string>"
    records = [
        (1, "s", {}, "none", {"o": "/1"}), (2, "s", {"a": "1"}, "a1", {"o": "/1", "p": "/2"}), (3, "s", {"a": "1"}, "a1", {"o": "/1"}),
        (4, "t", {"a": "1"}, "a1", {"o": "/1"}), (5, "s", {"b": None}, "b", {"o": "/1"}), (6, "s", {"b": "2"}, "b2", {"o": "/gone"}), (7, "t", {}, "none", None), (8, "s", None, "null", None),
    ]
    wanted = spark.createDataFrame([(10, "s", {"a": "1", "b": "2"}), (11, "s", {"a": "3", "b": None}), (12, "s", {}), (13, "t", {"a": "1"}), (14, "s", None)], "id long, stage_id string, params map<string,string>")
    files = spark.createDataFrame([("/1",), ("/2",), ("/1",)], "path string")
    got = sorted(tuple(r) for r in R.manifest_subset(spark.createDataFrame(records, schema), wanted, files=files).collect())
    assert got == [(10, 1), (10, 2), (11, 1), (11, 5), (13, 7)]
    got = sorted(tuple(r) for r in R.manifest_subset(spark.createDataFrame(records, schema), wanted, files=files.where("path = '/1'")).collect())
    assert got == [(10, 1), (10, 3), (11, 1), (11, 5), (13, 7)]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    for text, want in (("1-02:03:04", 93784.0), ("01:02:03", 3723.0), ("02:03", 123.0), ("17", 17.0), ("x", None)):
        assert one(spark, X.parse_hms(F.lit(text))) == want
    for text, want in (("8G", 8 * 1024.0**3), ("1.5k", 1536.0), ("N/A", None), ("12", 12.0)):
        assert one(spark, X.parse_memory(F.lit(text))) == want
    for text, want in (("2h", "2:00:00"), ("90 min", "1:30:00"), ("3:05", "3:05:00"), ("1:02:03", "1:02:03"), ("soon", None)):
        assert one(spark, X.normal_time(F.lit(text))) == want
    assert one(spark, X.safe_name(F.lit(" a b/../c\n--"))) == "a-b-..-c" and one(spark, X.safe_name(F.lit("..")))== "job"
    assert one(spark, X.normal_message(F.lit("Error at line 42 in /a/b/c.R 0xAF  2024-01-01 10:00:00"))) == "Error at line <N> in <path>/c.R <addr> <time>"
    assert one(spark, X.expand("{stage}/{name}.x", stage=F.lit("s"), name=F.lit(3))) == "s/3.x"
    assert one(spark, X.format_bytes(F.lit(1536))) == "1.5K" and one(spark, X.offset(F.lit(3725))) == "+1:02:05"
    assert one(spark, X.coerced(F.lit("12"))).as_integer == 12 and one(spark, X.coerced(F.lit("TRUE"))).as_boolean is True
    assert tuple(one(spark, X.exit_code(F.lit("1:9")))) == (1, 9)
    with pytest.raises(KeyError):
        X.expand("{nothing}")
    assert one(spark, X.stem(F.lit("/a/sample_07.csv"), r"_(\d+)")) == "07" and one(spark, X.stem(F.lit("/a/b.tar.gz"), "^x")) == "b.tar"
    for rule, element, want in (("auto", "/x/data 1.csv", "data-1"), ("auto", "plain", "job-3"), ("index", "q", "job-3"), ("stem", "a/b.c", "b"), ("digest", "q", "job-7694f4a6"), (lambda e, n: F.concat(e, F.lit("!")), "f", "f"), (lambda e, n: F.lit(""), "f", "job-3")):
        assert one(spark, X.named_by(rule, F.lit(element), F.lit(3))) == want
    with pytest.raises(Exception, match="line break"):
        one(spark, X.one_line(F.lit("a\nb")))
    values = X.path_values(datetime.datetime(2024, 5, 6, 7, 8, 9), name="n")
    assert one(spark, X.expand("{name}/{date}-{time}/{run}", **values)) == "n/20240506-070809/20240506_070809"
    null = F.lit(None).cast("string")
    assert one(spark, X.event_brief(F.lit("stage_failed"), F.lit(2), F.lit("fit"), F.lit(1), F.lit("bad"), null, F.lit(1500.0))) == "stage failed chunk 2 / fit (attempt 1) (1.5s): bad"
    assert one(spark, X.event_brief(F.lit("run_completed"), null, null, null, null, F.lit("all done"), F.lit(None).cast("double"))) == "run completed: all done"
    assert tuple(one(spark, X.submit_error(F.lit("Socket timed out")))) == ("submission_transient_error", True)
    assert one(spark, larger_memory(F.lit("8G"), F.lit("9000M"))) == "9000M" and one(spark, larger_memory(F.lit("1G"), F.lit("1024M"))) == "1G"
    asks = spark.createDataFrame([("a", 2, "8G", "90min"), ("a", 4, "512M", "2:00:00"), ("b", 1, None, None)], "g string, cpus int, memory string, time string")
    assert sorted(tuple(r) for r in resource_envelope(asks, "g").collect()) == [("a", 4, "8G", "2:00:00"), ("b", 1, None, None)]
    with pytest.raises(Exception, match="no memory"):
        resource_envelope(spark.createDataFrame([(1, "much", "1h")], "cpus int, memory string, time string")).collect()


def test_failures(spark):
    rows = [("OUT_OF_MEMORY", None, None, None, "oom"), ("TIMEOUT", None, None, None, "timeout"), ("NODE_FAIL", None, None, None, "slurm_infra"), ("FAILED", 9, None, None, "oom"), (None, None, None, "cancelled", "dependency"), (None, None, "contract", "failed", "validation"), (None, None, "ValueError", "failed", "r_error"), ("FAILED", None, None, None, "r_crash"), (None, None, None, None, "unknown")]
    df = spark.createDataFrame(rows, "state string, signal int, kind string, status string, want string")
    assert df.where(D.classify_failure(F.col("state"), F.col("signal"), F.col("kind"), F.col("status")) != F.col("want")).count() == 0
    more = spark.createDataFrame([(*r, "msg", 3 * 1024**3, "2G", 5400) for r in rows], df.schema.simpleString()[7:-1].replace(":", " ") + ", error_message string, max_rss long, requested_memory string, elapsed_seconds long").withColumnRenamed("kind", "error_class")
    details = D.failure_details(more)
    by = {(r["class"], r.state): (r.label, r.detail, r.suggestion) for r in details.collect()}
    assert by["oom", "OUT_OF_MEMORY"] == ("OOM", "killed for memory at 3.0G against 2G", "ask for 3G of memory")
    assert by["timeout", "TIMEOUT"] == ("TIMEOUT", "out of time after 1:30:00", "ask for 3:00:00 of time")
    assert by["slurm_infra", "NODE_FAIL"] == ("NODE_FAIL", "a node failed", "run it again")
    assert by["r_error", None] == ("ERROR", "msg", None) and by["dependency", None][0] == "DEP"
    assert {r["class"]: r.n for r in D.failure_suggestions(details).collect()} == {"oom": 2, "timeout": 1, "slurm_infra": 1, "dependency": 1, "validation": 1, "r_crash": 1, "unknown": 1}
    errors = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 3), ("c", 1), ("d", 1), ("d", 3)], "message string, run_idx long")
    assert {r.message: r.pattern for r in D.failure_patterns(errors).collect()} == {"a": "persistent", "b": "new", "c": "resolved", "d": "flaky"}
    clean_last = D.failure_patterns(errors.withColumn("class", F.lit("r_error")), n_runs=4).collect()
    assert {r.message: r.pattern for r in clean_last} == dict.fromkeys("abcd", "resolved") and {r["class"] for r in clean_last} == {"r_error"}


def test_errors_of_a_run(spark):
    diag = "array<struct<stage:string,ok:boolean,skipped:boolean,status:string,error_class:string,error_message:string>>"
    results = spark.createDataFrame([(1, "r1", [("a", True, False, "completed", None, None), ("b", False, False, "failed", "contract", "b: max")]), (2, "r2", [("a", False, True, "skipped", None, None)]), (2, "r3", [("a", False, False, "failed", "ValueError", None)])], f"chunk_id long, row_id string, `.diag` {diag}")
    jobs = spark.createDataFrame([(1, "COMPLETED"), (2, "FAILED"), (3, "TIMEOUT"), (4, "COMPLETED"), (5, "RUNNING"), (6, "OUT_OF_MEMORY")], "chunk_id long, state string")
    labels = spark.createDataFrame([(3, "three")], "chunk_id long, label string")
    got = sorted((r.chunk_id, r.stage, r.error_msg, r.source, r.context, r["class"]) for r in D.run_errors(results, jobs, labels).collect())
    assert got == [(1, "b", "b: max", "index", None, "validation"), (2, "a", "unknown error", "index", None, "r_error"), (3, None, "timeout without a result", "missing", "three", "timeout"), (4, None, "completed without a result", "missing", None, "r_crash")]
    assert sorted(r.chunk_id for r in D.incomplete_jobs(jobs, results).collect()) == [2, 3, 4, 5, 6]
    assert [r.state for r in D.by_state(jobs, "chunk_id").collect()] == ["FAILED", "TIMEOUT", "RUNNING", "COMPLETED", "COMPLETED", "OUT_OF_MEMORY"]
    packed = D.packed_errors(spark.range(10_000).selectExpr("id % 2 as chunk_id", "id as index", "id % 1000 < 2 as is_error")).collect()
    assert sum(r.n_errors for r in packed) == 20 and max(len(r.error_indices) for r in packed) <= 4096 and {r.chunk_id for r in packed} == {0, 1}


def test_run_info(spark):
    registry = spark.createDataFrame([("a", 1, "running", 3), ("a", 2, None, 4), ("b", 3, "completed", 1)], "run_id string, _line long, status string, n_chunks long")
    status = spark.createDataFrame([("a", "completed", None)], "run_id string, status string, n_chunks long")
    events = spark.createDataFrame([("a", "chunk_completed"), ("a", "chunk_completed"), ("a", "chunk_failed"), ("b", "x")], "run_id string, event_type string")
    r = R.run_info(registry, status, events, "a").first()
    assert (r.status, r.n_chunks, r.n_events, r.chunks_completed, r.chunks_failed, r.event_counts) == ("completed", 4, 3, 2, 1, {"chunk_completed": 2, "chunk_failed": 1})
    r = R.run_info(registry, status, events, "none").first()
    assert (r.status, r.n_events) == ("unknown", 0)


def test_streams(spark, events, tmp_path):
    out = str(tmp_path / "out")
    stream = watch(new_errors(event_stream(spark, events)).select("sig", "message"), out, str(tmp_path / "check"))
    stream.awaitTermination(120)
    assert sorted(r.message for r in spark.read.schema("sig string, message string").json(out).collect()) == ["other", "same"]
    table = spark.createDataFrame([(k, "a") for k in range(10)], "s long, event_type string").select(F.timestamp_seconds("s").alias("ts"), "event_type")
    assert sorted(r.n for r in windowed_counts(table, "ts", "4 seconds").collect()) == [2, 4, 4]


def test_silent_workers(spark):
    rows = [("r", 1, "stage_heartbeat", 0), ("r", 1, "stage_heartbeat", 100), ("r", 2, "stage_heartbeat", 10), ("r", 3, "worker_heartbeat", 20), ("r", 3, "chunk_completed", 30)]
    events = spark.createDataFrame(rows, "run_id string, chunk_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.chunk_id for r in silent_now(events, F.timestamp_seconds(F.lit(150)), 60).collect()] == [2]
    assert sorted(r.chunk_id for r in silent_now(events, F.timestamp_seconds(F.lit(200)), 60).collect()) == [1, 2]
    beats = sorted((r.chunk_id, r.beats) for r in silent(events, "1 minute").collect())
    assert beats == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_small_helpers(spark, tmp_path):
    registry = spark.createDataFrame([("a", 1, "running", "2024-01-01"), ("a", 2, "completed", None), ("b", 3, "failed", "2024-01-02"), ("c", 4, "completed", None)], "run_id string, _line long, status string, created_at string")
    assert [r.run_id for r in R.run_ls(registry).collect()] == ["b", "a", "c"]
    assert [r.run_id for r in R.run_ls(registry, ["completed"], 1).collect()] == ["a"]
    assert one(spark, X.clean_params(F.create_map(F.lit("b"), F.lit("1"), F.lit(".x"), F.lit("2"), F.lit("a"), F.lit("3")))) == {"a": "3", "b": "1"}
    assert one(spark, X.escape_html(F.lit("<a> & b"))) == "&lt;a&gt; &amp; b"
    assert one(spark, D.suggested_memory(F.lit(2 * 1024**3))) == 3 and one(spark, D.suggested_hours(F.lit(3601))) == 3
    by = dealt(spark.range(100).withColumn("g", F.col("id") % 3), Dist(("g",))).groupBy("g", F.spark_partition_id().alias("p")).count()
    assert by.count() == 3
    for name in ("b.x", "a.x", "c.y"):
        (tmp_path / name).write_text("1")
    assert [r.path.rpartition("/")[2] for r in C.glob(spark, f"{tmp_path}/*.x").collect()] == ["a.x", "b.x"]
    assert C.glob(spark, f"{tmp_path}/*.none").count() == 0


def test_summaries_in_files(spark, tmp_path):
    out = flow(spark.range(3).withColumnRenamed("id", "x")).stage("s", {"y": "6 div x"}, S.returns(y=S.int_())).collect()
    D.write_summary(out, "r<1>", str(tmp_path / "s.json"))
    found = json.loads((tmp_path / "s.json").read_text())
    assert (found["rows"], found["failed_rows"], found["stages"][0]["completed"], found["stages"][0]["failed"]) == (3, 1, 2, 1)
    D.write_summary(out, "r<1>", str(tmp_path / "s.html"))
    assert "r&lt;1&gt;" in (tmp_path / "s.html").read_text()
    attempts = D.attempts(out, "r")
    errors = attempts.where("not ok").select("row_id", "stage", "error_class").unionByName(spark.createDataFrame([("none", "s", "x")], "row_id string, stage string, error_class string"))
    got = sorted((r.error_class, r.attempt) for r in D.with_attempts(errors, attempts).collect())
    assert got == [("expression", 1), ("x", None)]


def test_context_of_any_length(spark):
    lines = spark.range(200).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    got = with_context(lines, F.col("line") == 100, "file", "line", before=40, after=70, block=16)
    assert sorted(r.line for r in got.collect()) == list(range(60, 171))


def test_completion_manifest_knows_what_exists(spark):
    schema = "stage_id string, param_hash string, params map<string,string>, output_paths map<string,string>, completed_at string, script string"
    rows = [("s", "h", {"a": "1", "b": "2"}, {"o": "/1", "p": "/2"}, "t", "x"), ("s", "h", {"b": "2", "a": "1"}, {"p": "/2", "o": "/1"}, "t", "y"), ("s", "g", {"a": "2"}, {"o": "/1", "p": "/gone"}, "t", "x"), ("s", "e", {}, {}, None, "x"), ("s", "n", None, None, None, "x"), ("t", "h", {}, {"o": "/1"}, "t", "x"), (None, "h", {}, {"o": "/1"}, "t", "x")]
    records = spark.createDataFrame(rows, schema)
    files = spark.createDataFrame([("/1",), ("/2",), ("/1",), ("/3",)], "path string")
    got = R.completion_manifest(records, "s", files)
    assert sorted((r.param_hash, r.outputs_current) for r in got.collect()) == [("e", False), ("g", False), ("h", True), ("h", True), ("n", False)]
    assert R.completion_manifest(records, "s").columns == ["stage_id", "param_hash", "params", "output_paths", "completed_at"]
    assert R.completion_manifest(records, "nowhere", files).collect() == []


def test_patterns_of_paths(spark):
    now, L = F.to_timestamp(F.lit("2024-01-15 14:30:22")), F.lit
    P = X.path_patterns
    assert one(spark, P.timestamped(L("results"), L("analysis"), L("csv"), now)) == "results/20240115_143022_analysis.csv"
    assert one(spark, P.experiment(L("exp001"), L("model_v2"), L(3))) == "experiments/exp001/model_v2/run_003"
    assert one(spark, P.user_workspace(L("temp"), L("data.rds"), user="ann")) == "workspace/ann/temp/data.rds"
    assert one(spark, P.daily_log(L("fit"), now)) == "logs/20240115/fit_143022.log"
    assert one(spark, P.checkpoint(L("m"), L(12), now)) == "checkpoints/m/epoch_0012_20240115.pkl"
    for text, want in (("8GB", 8 * 1024.0**3), ("4Gc", 4 * 1024.0**3), ("12X", None), ("2T", 2 * 1024.0**4), ("NA", None)):
        assert one(spark, X.parse_memory(F.lit(text))) == want
    for text, want in (("3-1:02:03", 262923.0), ("1:02:03", 3723.0), ("3-02:03", None), ("90.5", 90.5)):
        assert one(spark, X.parse_hms(F.lit(text))) == want
