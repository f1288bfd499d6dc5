"""Text logs: files, lines, and matches with their surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 1, in the order of the file) and text. Files are read in splits; lines are numbered by the split
    they are in and their place there, so a very long log is no burden to one task."""
    splits = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), splits.alias("_p"), F.col("value").alias("text"))
    # Of one file, splits later in it and lines later in a split have larger ids within a split.
    within = F.row_number().over(Window.partitionBy("file", "_p.file_block_start").orderBy("_p.at"))
    placed = lines.withColumn("_n", within)
    sizes = placed.groupBy("file", F.col("_p.file_block_start").alias("_start")).agg(F.max("_n").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("file").orderBy("_start")) - F.col("_size")
    offsets = sizes.select("file", "_start", before.alias("_before"))
    joined = placed.withColumn("_start", F.col("_p.file_block_start")).join(offsets, ["file", "_start"])
    return joined.select("file", (F.col("_before") + F.col("_n")).cast("int").alias("line"), "text")


def find_logs(lines: DataFrame, states: DataFrame | None = None, failed_only: bool = True) -> DataFrame:
    """Files with their number of lines, the chunk in their names and, with ``states`` (chunk_id, state), the states;
    by default those failed or unknown."""
    chunk = F.regexp_extract("file", r"(\d+)\.[^./]*$", 1).try_cast("long")
    rows = lines.groupBy("file").agg(F.count("*").alias("lines")).withColumn("chunk_id", chunk)
    if states is None:
        return rows
    rows = rows.join(states, "chunk_id", "left")
    return rows.where(F.col("state").isNull() | F.col("state").isin("FAILED", "TIMEOUT", "CANCELLED", "OUT_OF_MEMORY")) if failed_only else rows


def with_context(lines: DataFrame, match: Column, by: str, order: str, before: int = 3, after: int = 3, block: int = 4096) -> DataFrame:
    """Lines that match or lie within so many lines of one that does, with ``is_match``; a line is returned once.

    ``order`` numbers the lines of ``by`` from some number on without gaps. Lines are handled in blocks of neighbours, at
    least as many as the context has, and matches are copied to the blocks that their context reaches, so a very long
    log is spread over tasks and a match is in three blocks at most.
    """
    size = max(block, before + after)
    rows = lines.withColumns({"is_match": F.coalesce(match, F.lit(False)), "_block": F.floor(F.col(order) / size)})
    reached = F.sequence(F.floor((F.col(order) - before) / size), F.floor((F.col(order) + after) / size))
    copies = rows.withColumn("_own", F.explode(F.when(F.col("is_match"), reached).otherwise(F.array("_block"))))
    near = F.max("is_match").over(Window.partitionBy(by, "_own").orderBy(order).rangeBetween(-after, before))
    return copies.withColumn("_near", near).where((F.col("_own") == F.col("_block")) & F.col("_near")).drop("_own", "_block", "_near")


def capped(lines: DataFrame, match: Column, order: list[str], most: int) -> DataFrame:
    """``lines`` with ``hit``: whether a line matches and is one of the first ``most`` that do, in an order over all files."""
    place = F.struct(*order)
    # One row, from no more rows than the cap.
    last = lines.where(match).orderBy(*order).limit(most).agg(F.max(place).alias("_last"))
    return lines.crossJoin(F.broadcast(last)).withColumn("hit", F.coalesce(match & (place <= F.col("_last")), F.lit(False))).drop("_last")


def search_logs(lines: DataFrame, pattern: str, context: int = 3, max_matches: int | None = 50) -> DataFrame:
    """Lines (file, line, text) that match or lie near one that does, with ``is_match``; at most so many matches over
    all files."""
    match = F.col("text").rlike(pattern)
    rows = lines.withColumn("hit", match) if max_matches is None else capped(lines, match, ["file", "line"], max_matches)
    return with_context(rows, F.col("hit"), "file", "line", context, context).drop("hit")


def by_time(files: DataFrame) -> DataFrame:
    """Files (path, mtime) from the oldest on."""
    return files.orderBy("mtime", "path")
