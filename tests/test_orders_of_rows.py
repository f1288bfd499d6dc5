"""Balance, containment, last values before, timelines and grids against plain versions."""

import heapq
import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from gridweave.operators.grids import grid, param_grid
from gridweave.operators.ordinals import numbered, running_total
from gridweave.operators.partitioning import balance_longest_first
from gridweave.operators.timeline import TOLD, as_of, event_label, run_timeline
from gridweave.sources.run_store import manifest_subset, subset_candidates


def one_after_another(rows, n):
    heap, out = [(0.0, g) for g in range(1, n + 1)], {}
    for k, w in sorted(rows, key=lambda r: (-r[1], r[0])):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + w, g))
        out[k] = g
    return out


@pytest.mark.parametrize("n, parts", [(1, 16), (3, 16), (7, 4)])
def test_heavy_rows_as_one_after_another(spark, n, parts):
    rng = random.Random(n)
    rows = [(k, float(rng.choice([50, 60, 70, 80]))) for k in range(n * parts // 2)]
    got = balance_longest_first(spark.createDataFrame(rows, "id long, w double"), "id", "w", n, parts=parts)
    assert {r.id: r.group for r in got.collect()} == one_after_another(rows, n)


@pytest.mark.parametrize("draw", [lambda r: r.random(), lambda r: r.paretovariate(0.6), lambda r: 1.0, lambda r: r.choice([1e-9, 1e9]), lambda r: r.choice([0.0, 0.0, 1.0, 500.0])])
def test_loads_within_the_bound(spark, draw):
    rng, n, parts = random.Random(9), 6, 16
    rows = [(k, draw(rng)) for k in rng.sample(range(10**6), 3000)]
    got = balance_longest_first(spark.createDataFrame(rows, "id long, w double").repartition(5), "id", "w", n, parts=parts).collect()
    assert sorted((r.id, r.w) for r in got) == sorted(rows) and {r.group for r in got} <= set(range(1, n + 1))
    load = {g: math.fsum(r.w for r in got if r.group == g) for g in range(1, n + 1)}
    total, plain = math.fsum(w for _, w in rows), one_after_another(rows, n)
    best = max(math.fsum(w for k, w in rows if plain[k] == g) for g in range(1, n + 1))
    assert max(load.values()) <= best * (1 + 1e-9) + total / (n * parts)


def test_rows_without_weight_are_dealt_in_turn(spark):
    rows = [(k, (None, 0.0, float("nan"))[k % 3]) for k in range(40)]
    got = balance_longest_first(spark.createDataFrame(rows, "id long, w double"), "id", "w", 4)
    assert sorted((r.group, r["count"]) for r in got.groupBy("group").count().collect()) == [(g, 10) for g in range(1, 5)]
    assert balance_longest_first(spark.createDataFrame([], "id long, w double"), "id", "w", 4).count() == 0
    with pytest.raises(ValueError, match="weights"):
        balance_longest_first(spark.createDataFrame([(1, -1.0)], "id long, w double"), "id", "w", 4)


def test_running_total_and_null_ordinals(spark):
    rows = [(k, float(k % 7)) for k in range(500)]
    got = {r.id: r.before for r in running_total(spark.createDataFrame(rows, "id long, v double"), "id", "v", parts=9).collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}
    assert sorted(r.row_number for r in numbered(spark.createDataFrame([(1,), (None,), (5,)], "o long"), "o", parts=3).collect()) == [1, 2, 3]


def maps(rng, n, wide):
    return [(k, rng.choice("st"), {f"k{j}": rng.choice(["1", "2", None]) for j in rng.sample(range(wide), rng.randint(0, wide))}) for k in range(n)]


def test_subsets_against_all_pairs(spark):
    rng = random.Random(6)
    records, wanted = maps(rng, 150, 4), maps(rng, 80, 5)
    schema = "id long, stage_id string, params map<string,string>"
    got = sorted(tuple(r) for r in manifest_subset(spark.createDataFrame(records, schema), spark.createDataFrame(wanted, schema)).collect())
    assert got == sorted((w, r) for w, s, p in wanted for r, t, q in records if s == t and len(q) < len(p) and q.items() <= p.items())


def test_an_entry_that_all_share_makes_no_pairs(spark):
    params = lambda own: F.create_map(F.lit("all"), F.lit("1"), F.lit("own"), own.cast("string"))
    records = spark.range(100_000).select(F.col("id").alias("record_id"), F.lit("s").alias("stage_id"), params(F.col("id")).alias("params"))
    wanted = spark.range(0, 100_000, 100).select(F.col("id").alias("wanted_id"), F.lit("s").alias("stage_id"), F.map_concat(params(F.col("id")), F.create_map(F.lit("more"), F.lit("2"))).alias("params"))
    assert subset_candidates(wanted, records).count() == 1000
    full = manifest_subset(records.withColumnRenamed("record_id", "id"), wanted.withColumnRenamed("wanted_id", "id"))
    assert full.where("wanted_id = record_id").count() == full.count() == 1000


def at(seconds):
    return datetime.fromtimestamp(seconds, UTC)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_last_value_before(spark, parts):
    rng = random.Random(parts)
    group = lambda: rng.choice(["hot"] * 20 + ["a", "b", None])
    left = [(group(), rng.randrange(3000), k) for k in range(300)] + [("a", None, 999)]
    right = [(group(), rng.randrange(3000), rng.choice([None, rng.randrange(50)])) for _ in range(400)] + [("hot", None, 3)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"g string, t long, {name} long").withColumn("at", F.timestamp_seconds("t"))
    got = {r.k: r.last for r in as_of(frame(left, "k"), frame(right, "v"), "at", ("g",), "v", "last", parts).collect()}

    def plain(g, t):
        before = [(u, v) for h, u, v in right if h == g and v is not None and u is not None and t is not None and u <= t]
        return max(before)[1] if before else None

    assert got == {k: plain(g, t) for g, t, k in left}
    assert as_of(frame(left, "k"), frame(right[:0], "v"), "at", ("g",), "v", "last", parts).where("last is null").count() == 301


def test_labels_of_events(spark):
    rows = [(kind, c, s, "m" * 70, "e" * 70, 2) for kind in (*TOLD, "odd_one") for c, s in ((4, "fit"), (None, None))]
    frame = spark.createDataFrame(rows, "event_type string, chunk_id long, stage string, message string, error string, attempt int")
    got = {(r.event_type, r.chunk_id): r.label for r in frame.withColumn("label", event_label(frame.columns)).collect()}
    assert got["chunk_failed", 4] == "[FAIL] chunk 4 failed: " + "e" * 60 and got["chunk_started", None] == "[CHUNK] chunk ? started"
    assert got["stage_retried", 4] == "[RETRY] chunk 4 stage 'fit' attempt 2" and got["stage_completed", None] == "[STAGE] stage '?' completed"
    assert got["worker_heartbeat", None] == "[HEARTBEAT] worker: " + "m" * 60 and got["user_log", 4] == "[LOG] " + "m" * 70 and got["odd_one", 4] == "[ODD_ONE]"
    assert got["run_completed", 4] == "[DONE] Pipeline completed"


def test_timeline_of_four_sources(spark):
    events = spark.createDataFrame([("r", 10, "run_started", None, None, None, "info"), ("r", 20, "worker_heartbeat", 1, None, "on", "info"), ("r", 25, "user_log", 1, None, "half way", "info"), ("r", 40, "worker_heartbeat", 2, None, None, None), ("r", 50, "stage_failed", 1, "fit", None, "error"), ("r", 55, "other", 1, None, None, None), ("x", 60, "chunk_started", 3, None, None, None)], "run_id string, t long, event_type string, chunk_id long, stage string, message string, severity string").withColumns({"ts": F.timestamp_seconds("t"), "error": F.lit("bad")})
    attempts = spark.createDataFrame([("r", 1, "fit", False, False, "failed", 51, "ValueError", "no fit"), ("r", 1, "use", False, False, "cancelled", 52, "cancelled", None), ("r", 2, "fit", True, False, "completed", 53, None, None)], "run_id string, chunk_id long, stage string, ok boolean, skipped boolean, status string, t long, error_class string, error_message string").withColumn("ended_at", F.timestamp_seconds("t"))
    jobs = spark.createDataFrame([("r", 2, "TIMEOUT", 0, 60.5), ("r", 3, "COMPLETED", 0, 1.0), ("r", 4, "FAILED", 0, None)], "run_id string, chunk_id long, state string, signal int, elapsed_s double")
    runs = spark.createDataFrame([("r", 10, 80, 4, 2), ("s", 10, None, 1, 0)], "run_id string, a long, b long, n_chunks long, n_failed long").withColumns({"submitted_at": F.timestamp_seconds("a"), "finished_at": F.timestamp_seconds("b")})
    got = run_timeline(events, attempts, jobs, runs, parts=3)
    lines = [(r.run_id, r.offset, r.event, r["class"], r.source, r.last_log) for r in got.orderBy("run_id", "at").collect()]
    assert lines == [
        ("r", "+0:00:00", "[START] Pipeline started", None, "events", None), ("r", "+0:00:10", "[HEARTBEAT] chunk 1: on", None, "events", None), ("r", "+0:00:15", "[LOG] half way", None, "events", None), ("r", "+0:00:30", "[HEARTBEAT] chunk 2: ", None, "events", None),
        ("r", "+0:00:40", "[FAIL] chunk 1 stage 'fit': bad", None, "events", "half way"), ("r", "+0:00:41", "[FAIL] chunk 1, stage 'fit': no fit", "r_error", "attempts", "half way"), ("r", "+0:00:42", "[FAIL] chunk 1, stage 'use': unknown", "dependency", "attempts", "half way"),
        ("r", "+0:01:00", "[TIMEOUT] chunk 2: job TIMEOUT", "timeout", "jobs", None), ("r", "+0:01:10", "[DONE] 2/4 ok, 2 failed", None, "runs", None), ("x", "    ?    ", "[CHUNK] chunk 3 started", None, "events", None),
    ]
    beats = {r.event: r.last_heartbeat.replace(tzinfo=UTC).timestamp() for r in got.where("last_heartbeat is not null").collect()}
    assert beats == {"[FAIL] chunk 1 stage 'fit': bad": 20, "[FAIL] chunk 1, stage 'fit': no fit": 20, "[FAIL] chunk 1, stage 'use': unknown": 20, "[TIMEOUT] chunk 2: job TIMEOUT": 40}


def test_grids_by_digits(spark):
    names = spark.createDataFrame([("p", 0), ("q", 1), ("r", 2)], "name string, place long")
    parameters = {"a": list(range(5)), "b": ["x", None], "c": names, "d": [(1, 2), (3, 4)], "e": [float(k) for k in range(1500)]}
    out = param_grid(spark, **parameters)
    assert out.count() == 5 * 2 * 3 * 2 * 1500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    some = sorted(tuple(r) for r in out.where("ordinal % 997 = 0").select("ordinal", "a", "b", "c", "d._2", "e").collect())
    digit = lambda o: (o, o % 5, ["x", None][o // 5 % 2], "pqr"[o // 10 % 3], [2, 4][o // 30 % 2], float(o // 60))
    assert some == [digit(o) for o in range(0, 90_000, 997)]
    with pytest.raises(ValueError, match="no parameters"):
        param_grid(spark, {"z": "true"}, a=[1])


def test_cuts_before_expansion(spark):
    parameters = {"a": list(range(100)), "b": list(range(50)), "c": list(range(4))}
    cut = param_grid(spark, {"a": "a % 25 = 0", "b": "b < a"}, **parameters)
    whole = param_grid(spark, **parameters).where("a % 25 = 0 and b < a")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) and cut.count() == (25 + 50 + 50) * 4
    sizes = [r[0] for r in cut.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * min(sizes)
    assert grid(spark, where="c > 0", cut={"a": "a < 2"}, metadata=False, **parameters).count() == 2 * 50 * 3
    assert param_grid(spark, {"a": "a < 0"}, **parameters).count() == 0
