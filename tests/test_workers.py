"""Alerts of silent workers and progress over streams: late and repeated events, restarts, state that ends."""

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from gridweave.streaming import workers as W
from gridweave.streaming.watch import event_stream


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds files of events to a query, each as a batch of its own, and returns what was written so far."""
    W.use_timers(spark)
    (tmp_path / "events").mkdir()
    count = iter(range(10_000))

    def run(query, batches, name="q"):
        out = []
        for batch in batches:
            lines = [json.dumps({"timestamp": datetime.fromtimestamp(t, UTC).isoformat(), "event_type": kind, "run_id": r, "chunk_id": c}) for t, r, c, kind in batch]
            (tmp_path / "events" / f"{next(count):05}.json").write_text("\n".join(lines))
            events = event_stream(spark, str(tmp_path / "events"))
            # Started anew for each batch, so that every step is a restart from the checkpoint.
            query(events).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
            out.append(sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()))
        return out

    run.path = f"{tmp_path}/q"
    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def seconds(rows):
    return sorted((r[0], r[1], r[2], int(r[3].replace(tzinfo=UTC).timestamp()), int(r[4].replace(tzinfo=UTC).timestamp())) for r in rows)


BEAT, END = "worker_heartbeat", "chunk_completed"


def test_silent_while_it_lasts_and_returned(stream):
    query = lambda events: W.worker_alerts(events, gap_s=60, late="10 seconds", forget_s=10_000)
    got = stream(query, [
        [(1000, "r", 1, BEAT), (1000, "r", 2, BEAT), (1000, "r", 3, BEAT), (1000, "r", 3, BEAT), (1005, "r", 3, END)],
        [(1050, "r", 1, BEAT), (1200, "r", 1, "user_log"), (1090, "r", 1, BEAT)],
        [(1500, "other", 9, BEAT)],
        [(1400, "r", 2, BEAT), (1495, "r", 2, BEAT), (1495, "r", 2, BEAT)],
        [(1000, "r", 1, BEAT), (3000, "other", 9, BEAT)],
    ])
    assert seconds(got[0]) == []
    # Time has come to 1090 less the 10 seconds that events may be late: worker 2 is silent and nothing came of it.
    assert seconds(got[1]) == [("r", 2, "silent", 1060, 1000)]
    # Worker 1 is found silent while it is; the one that ended is not.
    assert seconds(got[2]) == sorted(seconds(got[1]) + [("r", 1, "silent", 1150, 1090)])
    # The sign at 1400 is later than the watermark allows.
    assert seconds(got[3]) == sorted(seconds(got[2]) + [("r", 2, "returned", 1495, 1000)])
    # The gap of "other" within its own batches is told, with its end.
    assert seconds(got[4]) == sorted(seconds(got[3]) + [("other", 9, "silent", 1560, 1500), ("other", 9, "returned", 3000, 1500), ("r", 2, "silent", 1555, 1495)])


def test_batches_do_not_matter(spark, stream):
    """Events in order give the same alerts in one batch, in many, and as a table, but for what is still going on."""
    rng, events, t = random.Random(2), [], 1000
    for _ in range(300):
        t += rng.choice([1, 5, 40])
        events.append((t, "r", rng.randrange(4), BEAT))
    query = lambda e: W.worker_alerts(e, gap_s=90, late="0 seconds")
    many = stream(query, [events[k : k + 60] for k in range(0, 300, 60)], "many")[-1]
    table = spark.createDataFrame([(r, c, k, t) for t, r, c, k in events], "run_id string, chunk_id long, event_type string, t long").withColumn("ts", F.timestamp_seconds("t"))
    whole = seconds(query(table).collect())
    ended = {(r[1], r[4]) for r in whole if r[2] == "returned"}
    assert len(whole) > 10 and [r for r in seconds(many) if (r[1], r[4]) in ended] == whole


def test_marks_count_chunks_once_and_forget(spark, stream):
    rng = random.Random(1)
    done = [(1000 + k, "r", c, END) for k, c in enumerate(rng.sample(range(10_000), 5_000))]
    query = lambda events: W.chunk_marks(events, late="100 seconds", forget_s=1_000)
    batches = [done[:2000], done[1500:4000] + done[3000:4000], done[4000:] + [(1000, "late", 1, END), (6500, "s", -1, END), (6500, "s", 5000, END)], [(20_000, "s", 1, END)], [(20_001, "r", done[-1][2], END), (20_001, "s", 1, "chunk_failed")]]
    stream(query, batches[:3])
    marks = spark.read.parquet(stream.path)
    assert {tuple(r)[:2] for r in W.progress(marks).collect()} == {("r", 5000), ("s", 1)}
    assert marks.where("run_id = 'r'").agg(F.max("block")).first()[0] == 2
    stream(query, batches[3:])
    # All of r's blocks were forgotten by then, so its chunk is as new.
    assert {tuple(r)[:2] for r in W.progress(spark.read.parquet(stream.path)).collect()} == {("r", 5001), ("s", 2)}


def test_tables_without_events(spark):
    events = spark.createDataFrame([(None, None, BEAT, 1), ("r", 1, None, 1), ("r", 1, BEAT, None)], "run_id string, chunk_id long, event_type string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert W.worker_alerts(events, 10).collect() == W.worker_alerts(events.limit(0), 10).collect() == []
    assert W.progress(W.chunk_marks(events)).collect() == []
