"""The run store: events, registry, manifests and status files as DataFrames over JSON lines.

Malformed lines are left out, as a reader of logs that are being written must.
"""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.schema import record

EVENT = record(
    "timestamp string, event_type string, severity string, source string, run_id string, chunk_id long, row_id string, row_index long, stage string, attempt int, job_id string, message string, error string"
)
MANIFEST = record("stage_id string, param_cols array<string>, params map<string,string>, param_hash string, output_names array<string>, output_paths map<string,string>, completed_at string, script string")
REGISTRY = record("run_id string, status string, backend string, n_chunks long, label string, created_at string, updated_at string")


def parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines (``value``, any other columns) as records beside the other columns; blank and malformed ones are left out."""
    marked = T.StructType([*schema, T.StructField("_corrupt_record", T.StringType())])
    # Parsed from text, so that a query of any columns knows which lines are malformed.
    rows = lines.where(F.trim("value") != "").withColumn("_row", F.from_json("value", marked, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    rows = rows.where(F.col("_row._corrupt_record").isNull() & F.col("_row").isNotNull())
    return rows.select(*[c for c in lines.columns if c != "value"], *[F.col(f"_row.{f.name}").alias(f.name) for f in schema])


def read_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Well-formed JSON lines of files or folders, with the file and the line's place in it."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    return parsed_lines(lines, schema)


def append_line(path: str, record: dict[str, Any]) -> None:
    """One line at the end of a log, in one write so that writers don't mix."""
    line = json.dumps(record, default=str, sort_keys=True) + "\n"
    handle = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
    try:
        os.write(handle, line.encode())
    finally:
        os.close(handle)


def read_events(events: DataFrame, types: list[str] | None = None, severity: list[str] | None = None, last_n: int | None = None, order: str = "_line") -> DataFrame:
    """Events of some types and severities, the last n in the order of the log."""
    for name, wanted in (("event_type", types), ("severity", severity)):
        events = events if wanted is None else events.where(F.col(name).isin(*wanted))
    return events if last_n is None else events.orderBy(F.col(order).desc()).limit(last_n)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def last_n_by_key(events: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last n events of each key. Spark keeps n rows of each key in every task before the shuffle, so a hot key is
    no burden."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def compact(records: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Of each field the last value that is not null, for each key; ``order`` tells which record is later."""
    latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return records.groupBy(key).agg(F.min(order).alias("first_seq"), *latest)


def merged(old: DataFrame, new: DataFrame, key: str, keep_old: bool = True) -> DataFrame:
    """Records of both; where both have one, the new values win, a null one too unless ``keep_old``."""
    fields = [c for c in old.columns if c != key]
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if keep_old else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(key, *[pick(c).alias(c) for c in fields])


def completion_manifest(records: DataFrame, stage: str, files: DataFrame | None = None) -> DataFrame:
    """stage_id, param_hash, params, output_paths and completed_at of a stage's records; with ``files`` (path) also
    ``outputs_current``, whether there are outputs and all of them exist. Records that are there twice stay so. Files are joined to the
    paths of records, which are put together again by a hash of the record."""
    fields = ["stage_id", "param_hash", "params", "output_paths", "completed_at"]
    own = records.where(F.col("stage_id").eqNullSafe(F.lit(stage))).select(*fields)
    if files is None:
        return own
    # Maps in the order of their names, so that equal records have one hash.
    flat = lambda c: F.array_sort(F.map_entries(c))
    key = F.sha2(F.to_json(F.struct("stage_id", "param_hash", flat("params").alias("p"), flat("output_paths").alias("o"), "completed_at"), {"ignoreNullFields": "false"}), 256)
    one = own.groupBy(key.alias("_key")).agg(F.any_value(F.struct(*fields)).alias("_r"), F.count("*").alias("_times"))
    paths = one.select("_key", F.explode(F.map_values("_r.output_paths")).alias("path"))
    found = paths.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left").groupBy("_key").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("_all"))
    kept = one.join(found, "_key", "left").withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))))
    return kept.select("_r.*", F.coalesce("_all", F.lit(False)).alias("outputs_current"))


def manifest_latest(records: DataFrame, wanted: DataFrame, order: str, files: DataFrame | None = None) -> DataFrame:
    """For each wanted (param_hash, output_names) the newest record with that hash and those outputs whose files all
    exist (``files``: path), by the largest of its fields rather than by a sort of each hash's records."""
    rows = records
    if files is not None:
        paths = records.select("param_hash", order, F.explode(F.map_values("output_paths")).alias("path"))
        gone = paths.join(files.select("path").distinct(), "path", "left_anti").select("param_hash", order).distinct()
        rows = records.join(gone, ["param_hash", order], "left_anti")
    same = wanted.withColumn("_names", F.concat_ws("\x1f", F.array_sort("output_names"))).select("param_hash", "_names")
    found = rows.withColumn("_names", F.concat_ws("\x1f", F.array_sort("output_names"))).join(same.distinct(), ["param_hash", "_names"], "left_semi")
    whole = F.struct(*[F.col(c) for c in records.columns])
    return found.groupBy("param_hash", "_names").agg(F.max_by(whole, F.col(order)).alias("_r")).select("_r.*")


def manifest_subset(records: DataFrame, wanted: DataFrame, id_column: str = "id", files: DataFrame | None = None) -> DataFrame:
    """Pairs of a wanted row and a record whose parameters (maps) are a strict subset of its own.

    Records are met through one entry each, see :func:`subset_candidates`. Records without parameters are a subset of every
    row that has some. Where records have a ``stage_id``, wanted rows have one too and only records of the same stage
    match. With ``files`` (path) all ``output_paths`` of a record exist. Of records of one ``param_hash`` a wanted row gets the
    one of the least id."""
    if files is not None:
        paths = records.select(id_column, F.explode(F.map_values("output_paths")).alias("path"))
        records = records.join(paths.join(files.select("path").distinct(), "path", "left_anti").select(id_column).distinct(), id_column, "left_anti")
    stage = F.col("stage_id") if "stage_id" in records.columns else F.lit("")
    own = wanted.select(F.col(id_column).alias("wanted_id"), stage.alias("stage_id"), "params")
    theirs = records.select(F.col(id_column).alias("record_id"), stage.alias("stage_id"), "params")
    near = subset_candidates(own, theirs)
    holds = F.forall(F.map_entries("record_params"), lambda e: F.map_contains_key("params", e["key"]) & F.try_element_at("params", e["key"]).eqNullSafe(e["value"]))
    found = near.where((F.size("record_params") < F.size("params")) & holds).select("wanted_id", "record_id")
    bare = theirs.where(F.size("params") == 0).select("record_id", "stage_id")
    found = found.unionByName(own.where(F.size("params") > 0).join(bare, "stage_id").select("wanted_id", "record_id"))
    if "param_hash" not in records.columns:
        return found
    hashed = found.join(records.select(F.col(id_column).alias("record_id"), "param_hash"), "record_id")
    lone = F.when(F.col("param_hash").isNull(), F.col("record_id"))
    return hashed.groupBy("wanted_id", "param_hash", lone.alias("_lone")).agg(F.min("record_id").alias("record_id")).select("wanted_id", "record_id")


def subset_candidates(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """wanted_id, params, record_id and record_params of the pairs in question: a record meets only wanted rows that have its rarest
    (stage, name, value) entry, rarest among wanted rows; one with an entry that no wanted row has meets none. An entry that
    all records share costs a pair only where a record has no rarer one.

    ``wanted``: wanted_id, stage_id, params; ``records``: record_id, stage_id, params. Counting combines on the map side; both
    joins have plain exchanges, so adaptive execution splits frequent entries.
    """
    entry = lambda df, *rest: df.select("stage_id", F.explode("params").alias("k", "v"), *rest)
    same = lambda x, y: (F.col(f"{x}.stage_id") == F.col(f"{y}.stage_id")) & (F.col(f"{x}.k") == F.col(f"{y}.k")) & F.col(f"{x}.v").eqNullSafe(F.col(f"{y}.v"))
    counts = entry(wanted).groupBy("stage_id", "k", "v").agg(F.count("*").alias("n"))
    told = entry(records, "record_id").alias("r").join(counts.alias("c"), same("r", "c"), "left").select("record_id", "r.stage_id", "r.k", "r.v", "n")
    rarest = told.groupBy("record_id", "stage_id").agg(F.min_by(F.struct("k", "v"), F.struct("n", "k")).alias("e"), F.bool_or(F.col("n").isNull()).alias("lost"))
    rarest = rarest.where(~F.col("lost")).select("record_id", "stage_id", "e.k", "e.v")
    pairs = entry(wanted, "wanted_id").alias("w").join(rarest.alias("r"), same("w", "r")).select("wanted_id", "record_id")
    # One row for each id on either side.
    return pairs.join(wanted.select("wanted_id", "params"), "wanted_id").join(records.select("record_id", F.col("params").alias("record_params")), "record_id")


def adopted(records: DataFrame, new: dict[str, str]) -> DataFrame:
    """Records that lack all the new parameters, with these added and their hash made anew."""
    names = F.array(*[F.lit(k) for k in new])
    lacking = records.where(~F.arrays_overlap(F.map_keys("params"), names))
    extra = F.create_map(*[F.lit(x) for pair in new.items() for x in pair])
    full = lacking.withColumn("params", F.map_concat("params", extra))
    return full.withColumn("param_hash", F.sha1(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params"))))))


def run_ls(registry: DataFrame, status: list[str] | None = None, n: int = 20) -> DataFrame:
    """The newest runs."""
    rows = compact(registry, "run_id", "_line", [c for c in registry.columns if c not in ("run_id", "_line", "_file")])
    rows = rows if status is None else rows.where(F.col("status").isin(*status))
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "run_id").limit(n)


def run_info(registry: DataFrame, status: DataFrame, events: DataFrame, run_id: str) -> DataFrame:
    """One row about a run: its registry record under its status snapshot, and counts of its events. A run of which
    nothing is known has the status "unknown"."""
    fields = [c for c in registry.columns if c not in ("run_id", "_line", "_file")]
    own = compact(registry.where(F.col("run_id") == run_id), "run_id", "_line", fields).drop("first_seq")
    known = merged(own, status.where(F.col("run_id") == run_id).select("run_id", *fields), "run_id")
    asked = registry.sparkSession.createDataFrame([(run_id,)], "run_id string").join(known, "run_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    kinds = events.where(F.col("run_id") == run_id).groupBy("event_type").agg(F.count("*").alias("n"))
    # A row for each type of event.
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("n"))), F.lit(0))
    counts = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("event_counts"), of("chunk_failed").alias("chunks_failed"), of("chunk_completed").alias("chunks_completed"))
    return asked.crossJoin(F.broadcast(counts))
