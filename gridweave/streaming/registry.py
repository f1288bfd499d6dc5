"""A registry of records as a few compacted segments instead of all lines that were ever written.

A segment has a row for each key: the least ``order`` of its records, and for each field the last value that is not null with
the order it is from. Segments combine in any order to the same result as :func:`gridweave.sources.run_store.compact` over
all records. Each batch of a stream becomes a segment of level 0; as soon as there are ``fan`` segments of a level, they are merged
to one of the next, so a record is rewritten once for each level and a reader meets a few segments. Which segments are
there is a small file for each version, written anew and never over another; it also has the high-water mark, the last
batch that is in, so that a batch that comes again after a restart changes nothing. Segments that a version leaves out
are deleted one version later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.sources.shared import delete


def _versions(spark: SparkSession, store: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/versions")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(folder)) if system.exists(folder) else []


def state(spark: SparkSession, store: str) -> dict:
    """The newest version: its number, the high-water mark, and the segments as (level, name, first batch, last batch)."""
    names = _versions(spark, store)
    if not names:
        return {"version": 0, "mark": None, "segments": [], "dead": []}
    return json.loads(spark.read.text(f"{store}/versions/{names[-1]}", wholetext=True).first()[0])


def _publish(spark: SparkSession, store: str, new: dict) -> None:
    """The next version; an error if another writer was first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/versions/{new['version']:010}.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    try:
        out.write(bytearray(json.dumps(new).encode()))
    finally:
        out.close()


def segment_of(records: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Records as a segment."""
    value = lambda f: F.max_by(F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("seq"), F.col(f).alias("v"))), F.when(F.col(f).isNotNull(), F.col(order)))
    return records.groupBy(key).agg(F.min(order).alias("first_seq"), *[value(f).alias(f) for f in fields])


def combined(segments: DataFrame, key: str) -> DataFrame:
    """Segments under one another as one."""
    fields = [c for c in segments.columns if c not in (key, "first_seq")]
    return segments.groupBy(key).agg(F.min("first_seq").alias("first_seq"), *[F.max_by(F.col(f), F.col(f"{f}.seq")).alias(f) for f in fields])


def append(records: DataFrame, batch: int, store: str, key: str, order: str, fields: list[str], fan: int = 8) -> bool:
    """Adds a batch of records; False if the high-water mark says that it is in. Batches are numbered upwards."""
    spark = records.sparkSession
    now = state(spark, store)
    if now["mark"] is not None and batch <= now["mark"]:
        return False
    made: list[str] = []

    def written(df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{store}/segments/{name}")
        made.append(name)
        return name

    live = [*now["segments"], [0, written(segment_of(records, key, order, fields)), batch, batch]]
    level = 0
    while len(own := [s for s in live if s[0] == level]) >= fan:
        whole = combined(spark.read.parquet(*[f"{store}/segments/{s[1]}" for s in own]), key)
        live = [s for s in live if s[0] != level] + [[level + 1, written(whole), own[0][2], own[-1][3]]]
        level += 1
    kept = {s[1] for s in live}
    dead = [n for n in [*[s[1] for s in now["segments"]], *made] if n not in kept]
    _publish(spark, store, {"version": now["version"] + 1, "mark": batch, "segments": live, "dead": dead})
    # Readers of the version before may still be at what this one leaves out.
    for name in now["dead"]:
        delete(spark, f"{store}/segments/{name}")
    for name in _versions(spark, store)[:-2]:
        delete(spark, f"{store}/versions/{name}")
    return True


def registry(spark: SparkSession, store: str, key: str, schema: str, after: int | None = None) -> DataFrame:
    """The registry as :func:`compact` has it: key, first_seq and the fields, which ``schema`` names with their types. With
    ``after`` only what came in segments with batches later than that, for readers that keep up."""
    segments = [s for s in state(spark, store)["segments"] if after is None or s[3] > after]
    if not segments:
        return spark.createDataFrame([], schema)
    rows = combined(spark.read.parquet(*[f"{store}/segments/{s[1]}" for s in segments]), key)
    return rows.select(key, "first_seq", *[F.col(f"{f}.v").alias(f) for f in rows.columns if f not in (key, "first_seq")])


def follower(store: str, key: str, order: str, fields: list[str], fan: int = 8) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` of a stream of records takes."""

    def take(batch: DataFrame, number: int) -> None:
        append(batch, number, store, key, order, fields, fan)

    return take
