"""Segments of a registry against compaction of all records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridweave.sources.run_store import compact
from gridweave.streaming import registry as G

FIELDS = ["status", "n"]
SCHEMA = "run_id string, first_seq long, status string, n long"


def records(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(f"r{rng.randrange(40)}" if rng.random() < 0.6 else "hot", k, rng.choice([None, "running", "failed", "completed"]), rng.choice([None, rng.randrange(9)])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "run_id string, seq long, status string, n long")


def rows(df):
    return sorted(tuple(r) for r in df.select("run_id", "first_seq", *FIELDS).collect())


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_batches_in_any_order_give_the_same(spark, tmp_path, fan):
    _, all_of = records(spark)
    store, batches = f"file://{tmp_path}/s", random.Random(fan).sample(range(10), 10)
    for number, part in enumerate(batches):
        assert G.append(all_of.where(F.col("seq") % 10 == part), number, store, "run_id", "seq", FIELDS, fan)
        if number in (3, 9):
            seen = all_of.where((F.col("seq") % 10).isin(batches[: number + 1]))
            assert rows(G.registry(spark, store, "run_id", SCHEMA)) == rows(compact(seen, "run_id", "seq", FIELDS))
    # What is in is not taken again.
    assert not G.append(all_of, 9, store, "run_id", "seq", FIELDS, fan)
    now = G.state(spark, store)
    assert now["mark"] == 9 and len(now["segments"]) <= (fan - 1) * (5 if fan < 8 else 2)
    assert len(list((tmp_path / "s/segments").iterdir())) <= len(now["segments"]) + len(now["dead"]) and len(list((tmp_path / "s/versions").glob("*.json"))) == 2


def test_readers_that_keep_up_read_new_segments(spark, tmp_path):
    _, all_of = records(spark)
    store = f"file://{tmp_path}/s"
    for number in range(5):
        G.append(all_of.where(F.col("seq") % 5 == number), number, store, "run_id", "seq", FIELDS, fan=8)
    late = G.registry(spark, store, "run_id", SCHEMA, after=3)
    assert rows(late) == rows(compact(all_of.where("seq % 5 = 4"), "run_id", "seq", FIELDS)) and len(late.inputFiles()) < len(G.registry(spark, store, "run_id", SCHEMA).inputFiles())
    assert G.registry(spark, store, "run_id", SCHEMA, after=4).collect() == G.registry(spark, f"{store}-none", "run_id", SCHEMA).collect() == []


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = f"file://{tmp_path}/s"
    G._publish(spark, store, {"version": 1, "mark": 0, "segments": [], "dead": []})
    with pytest.raises(Exception, match="exists"):
        G._publish(spark, store, {"version": 1, "mark": 7, "segments": [], "dead": []})
    assert G.state(spark, store)["mark"] == 0


def test_streams_that_start_again(spark, tmp_path):
    plain, all_of = records(spark, 120)
    (tmp_path / "in").mkdir()
    for number in range(6):
        part = [dict(zip(("run_id", "seq", *FIELDS), r, strict=True)) for r in plain[number * 20 : number * 20 + 20]]
        (tmp_path / f"in/{number}.json").write_text("\n".join(json.dumps({k: v for k, v in r.items() if v is not None}) for r in part))
        stream = spark.readStream.schema("run_id string, seq long, status string, n long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        if number % 2:
            stream.writeStream.foreachBatch(G.follower(f"file://{tmp_path}/s", "run_id", "seq", FIELDS, fan=3)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert rows(G.registry(spark, f"file://{tmp_path}/s", "run_id", SCHEMA)) == rows(compact(all_of, "run_id", "seq", FIELDS))
    assert G.state(spark, f"file://{tmp_path}/s")["mark"] == 5
