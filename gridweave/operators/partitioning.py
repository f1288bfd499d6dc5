"""Chunks, balanced groups and layouts of work."""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.ordinals import numbered, running_total


def chunk_by(df: DataFrame, ordinal: str, size: int | None = None, n_chunks: int | None = None, by: tuple[str, ...] = (), name: str = "chunk") -> DataFrame:
    """``df`` with a chunk number from 1: ``size`` neighbouring rows each, or ``n_chunks`` of equal size (the last may
    be smaller), within ``by`` if given."""
    if (size is None) == (n_chunks is None):
        raise ValueError("either size or n_chunks")
    rows = numbered(df, ordinal, by, name="_rn")
    if size is not None:
        return rows.withColumn(name, F.ceil(F.col("_rn") / size).cast("long")).drop("_rn")
    counts = df.groupBy(*by).agg(F.count("*").alias("_n")) if by else df.agg(F.count("*").alias("_n"))
    if by:
        same = F.lit(True)
        for c in by:
            same = same & rows[c].eqNullSafe(counts[c])
        joined = rows.join(counts, same).drop(*[counts[c] for c in by])
    else:
        joined = rows.crossJoin(F.broadcast(counts))
    return joined.withColumn(name, F.ceil(F.col("_rn") / F.ceil(F.col("_n") / n_chunks)).cast("long")).drop("_rn", "_n")


def balance_round_robin(df: DataFrame, ordinal: str, n_groups: int, name: str = "group") -> DataFrame:
    """``df`` dealt to groups 1..n in turn."""
    return numbered(df, ordinal, name="_rn").withColumn(name, ((F.col("_rn") - 1) % n_groups + 1).cast("long")).drop("_rn")


def balance_by_weight(df: DataFrame, key: str, weight: str, n_groups: int, name: str = "group") -> DataFrame:
    """Groups of about equal total weight, without placing rows one after another: rows of about the same weight (equal
    to within a factor of 2 ** 0.25, whatever the range) are dealt in turn, each class starting where the one before it
    stopped. Of each class no group has more than one row more than another. Rows of weight zero are a class of their
    own, as are those without a weight (null or NaN); negative weights have classes by size."""
    own = F.col(weight).cast("double")
    size = F.floor(F.log2(F.abs(own)) * 4)
    # The classes of doubles lie between -4296 and 4096.
    level = F.when(own.isNull() | F.isnan(own), -10001).when(own == 0, -10000).when(own > 0, size).otherwise(-20000 - size).cast("long")
    rows = df.withColumn("_class", level)
    seen = numbered(rows, key, ("_class",), name="_rn")
    sizes = rows.groupBy("_class").agg(F.count("*").alias("_n"))
    # A row for each class.
    starts = sizes.join(sizes.select(F.col("_class").alias("_above"), F.col("_n").alias("_m")), F.col("_above") > F.col("_class"), "left").groupBy("_class").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_start"))
    return seen.join(F.broadcast(starts), "_class").withColumn(name, ((F.col("_start") + F.col("_rn") - 1) % n_groups + 1).cast("long")).drop("_class", "_rn", "_start")


def balance_longest_first(df: DataFrame, key: str, weight: str, n_groups: int, name: str = "group", parts: int = 16) -> DataFrame:
    """Groups of about equal total weight: the heaviest rows first, each to the group with the least so far.

    Rows above 1 / (n_groups * parts) of all weight are fewer than n_groups * parts: those are placed one after another, equal
    weights by ``key`` (a unique whole number), equal loads to the smallest group. What is left of the groups up to a common level
    is then filled with the other rows in the order of the key, by the sum of the weights before each. So no load is above
    the larger of that level and the load that the heavy rows alone make by more than one light row, which is 1 / parts of
    a group's fair share; where all rows are heavy, groups are those of placing all rows one after another. Rows without
    weight (zero, null or NaN) are dealt in turn. Negative weights are an error.
    """
    if n_groups < 1 or parts < 1:
        raise ValueError("n_groups and parts are 1 at least")
    own = F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    rows = df.withColumn("_weight", own)
    total, least = rows.agg(F.coalesce(F.sum("_weight"), F.lit(0.0)), F.coalesce(F.min("_weight"), F.lit(0.0))).first()
    if least < 0:
        raise ValueError("weights are 0 at least")
    limit = total / (n_groups * parts)
    heavy = sorted(rows.where(F.col("_weight") > limit).select("_weight", key).collect(), key=lambda r: (-r[0], r[1]))
    loads = [(0.0, g) for g in range(n_groups)]
    placed = []
    for w, k in heavy:
        load, g = loads[0]
        heapq.heapreplace(loads, (load + w, g))
        placed.append((k, g))
    # The level to which the groups can be filled with the rest, and the share of it that each one takes.
    rest = max(0.0, total - sum(w for w, _ in heavy))
    levels, level, filled = sorted(loads), 0.0, 0.0
    for k, (load, _) in enumerate(levels):
        filled += load
        level = (rest + filled) / (k + 1)
        if k + 1 == n_groups or level <= levels[k + 1][0]:
            break
    room = [(max(0.0, level - load), g) for load, g in sorted(loads, key=lambda x: x[1]) if level > load]
    # A room too small to tell in the sum of all is passed over.
    edges, takers = [-float("inf")], []
    for edge, (_, g) in zip(itertools.accumulate(r for r, _ in room), room, strict=True):
        if edge > edges[-1]:
            edges.append(edge)
            takers.append(g)
    splits = [*edges[:-1], float("inf")]

    light = rows.where((F.col("_weight") <= limit) & (F.col("_weight") > 0))
    light = running_total(light, key, "_weight", "_sum")
    if len(takers) > 1:
        light = Bucketizer(splits=splits, inputCol="_sum", outputCol="_slot").transform(light)
        light = light.withColumn(name, F.element_at(F.array(*[F.lit(g) for g in takers]), F.col("_slot").cast("int") + 1).cast("long") + 1).drop("_slot")
    else:
        light = light.withColumn(name, F.lit(takers[0] if takers else 0).cast("long") + 1)
    bare = numbered(rows.where("_weight = 0"), key, name="_rn").withColumn(name, ((F.col("_rn") - 1) % n_groups + 1).cast("long")).drop("_rn")
    kind = df.schema[key].dataType.simpleString()
    # Fewer rows than n_groups * parts.
    known = df.sparkSession.createDataFrame(placed, f"_key {kind}, _group long")
    first = rows.where(F.col("_weight") > limit).join(F.broadcast(known), F.col(key) == F.col("_key")).withColumn(name, F.col("_group") + 1).drop("_key", "_group")
    columns = [*df.columns, name]
    return first.select(columns).unionByName(light.select(columns)).unionByName(bare.select(columns))


def chunk_plan(df: DataFrame, chunk: str, by: tuple[str, ...], ordinal: str) -> DataFrame:
    """Groups, rows, first row and label of each chunk."""
    label = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in by]) if by else F.lit("all")
    rows = df.groupBy(chunk, label.alias("_label")).agg(F.count("*").alias("_n"), F.min(ordinal).alias("_first"))
    return rows.groupBy(F.col(chunk).alias("chunk_id")).agg(F.count("*").alias("group_count"), F.sum("_n").alias("row_count"), F.min("_first").alias("first_row"), F.min_by("_label", "_first").alias("label"))


@dataclass(frozen=True)
class Dist:
    """How rows are dealt: by columns, in chunks; workers are Spark's."""

    by: tuple[str, ...] = ()
    chunks_per_job: int = 1
    target_jobs: int | None = None


def resolve_layout(df: DataFrame, dist: Dist) -> DataFrame:
    """n_rows, n_groups, groups_per_job and n_jobs (as many as there are chunks)."""
    groups = df.groupBy(*dist.by).agg(F.count("*").alias("n")) if dist.by else df.agg(F.count("*").alias("n"))
    per_job = F.lit(dist.chunks_per_job) if dist.target_jobs is None else F.ceil(F.col("n_groups") / dist.target_jobs)
    return groups.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups")).withColumn("groups_per_job", per_job.cast("long")).withColumn("n_jobs", F.ceil(F.col("n_groups") / F.greatest(F.col("groups_per_job"), F.lit(1))).cast("long"))


def dealt(df: DataFrame, dist: Dist) -> DataFrame:
    """``df`` in partitions by the layout's columns."""
    return df.repartition(*dist.by) if dist.by else df


def waves(df: DataFrame, ordinal: str, size: int, name: str = "wave") -> DataFrame:
    """Waves of ``size`` rows."""
    return chunk_by(df, ordinal, size=size, name=name)
