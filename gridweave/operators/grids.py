"""Grids: tables of parameters to run stages over."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.ordinals import numbered


#: A list of more values is joined by position instead of being part of the plan.
WRITTEN_OUT = 1000


def _with_value(out: DataFrame, name: str, values: Any) -> DataFrame:
    """``out`` with the value of a parameter in place of ``.at <name>``, its position from 0."""
    at = F.col(f"`.at {name}`")
    if isinstance(values, DataFrame):
        given = values.select(F.col(values.columns[0]).alias(name), F.col(values.columns[1]).cast("long").alias(".at"))
    else:
        given = out.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values)], [name, ".at"])
        kind = given.schema[name].dataType
        if len(values) <= WRITTEN_OUT and all(v is None or isinstance(v, (bool, int, float, str)) for v in values):
            return out.withColumn(name, F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at.cast("int"))).drop(f".at {name}")
    return out.join(given, at == F.col("`.at`")).drop(f".at {name}", ".at")


def param_grid(spark: SparkSession, cut: dict[str, Column | str] | None = None, **parameters: Any) -> DataFrame:
    """All combinations of the parameters' values, the first varying fastest, with ``ordinal`` from 0.

    A parameter is a list, or a DataFrame of (value, position from 0 without gaps) for one too large for the driver. Combinations
    are numbers whose digits are the positions, so there are as many in each partition and nothing is crossed or
    sorted. ``cut`` has predicates by the name of the last parameter that they are about: each is applied before the
    parameters after it are expanded, to combinations of those up to it, and what is left is dealt evenly.
    """
    cut = cut or {}
    if unknown := set(cut) - set(parameters):
        raise ValueError(f"no parameters: {', '.join(sorted(unknown))}")
    sizes = {n: v.count() if isinstance(v, DataFrame) else len(v) for n, v in parameters.items()}
    # Runs of parameters, each up to one with a predicate.
    runs: list[list[str]] = [[]]
    for name in parameters:
        runs[-1].append(name)
        if name in cut:
            runs.append([])
    out, stride = None, 1
    for k, names in enumerate(runs):
        if not names:
            continue
        total = math.prod(sizes[n] for n in names)
        if out is None:
            out = spark.range(total).select(F.col("id").alias(".code"), F.lit(0).cast("long").alias("ordinal"))
        else:
            out = out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
            out = out.withColumn(".code", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long")))) if total else out.where("false").withColumn(".code", F.lit(0).cast("long"))
        out = out.withColumn("ordinal", F.col("ordinal") + F.col("`.code`") * stride)
        within = 1
        for n in names:
            out = out.withColumn(f".at {n}", F.expr(f"(`.code` div {within}L) % {max(1, sizes[n])}L"))
            within *= sizes[n] or 1
        out = out.drop(".code")
        for n in names:
            out = _with_value(out, n, parameters[n])
        stride *= total
        if names[-1] in cut:
            out = out.where(cut[names[-1]])
    return out.select(*parameters, "ordinal")


def with_metadata(grid: DataFrame, names: list[str], ordinal: str = "ordinal") -> DataFrame:
    """``.grid_id`` from 1 in the grid's order and ``.grid_hash``, eight characters of a hash of the row and its id."""
    rows = numbered(grid, ordinal, name=".grid_id")
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) for c in (*names, ".grid_id")]
    return rows.withColumn(".grid_hash", F.substring(F.md5(F.concat_ws("\x1e", *text)), 1, 8))


def grid(spark: SparkSession, where: Column | str | None = None, metadata: bool = True, cut: dict[str, Column | str] | None = None, **parameters: Any) -> DataFrame:
    """A parameter grid, filtered by a typed predicate (and by those of ``cut`` while it is made) and then numbered."""
    out = param_grid(spark, cut, **parameters)
    out = out if where is None else out.where(where)
    return with_metadata(out, list(parameters)) if metadata else out


def lhs_grid(spark: SparkSession, n: int, seed: int = 42, **ranges: tuple[float, float]) -> DataFrame:
    """A Latin hypercube of ``n`` points: each parameter has one uniform draw in each of n equal strata, in a random order
    of its own (points are numbered by a seeded hash). The same seed gives the same points."""
    out = spark.range(1, n + 1).withColumnRenamed("id", "_i")
    for k, (name, (low, high)) in enumerate(ranges.items()):
        if not low < high:
            raise ValueError(f"{name}: the minimum is below the maximum")
        hashed = spark.range(1, n + 1).select(F.col("id").alias("_i"), F.xxhash64("id", F.lit(seed), F.lit(2 * k)).alias("_hash"))
        draw = F.pmod(F.xxhash64("_i", F.lit(seed), F.lit(2 * k + 1)), F.lit(1 << 40)) / float(1 << 40)
        point = F.lit(float(low)) + (F.col("_stratum") - 1 + draw) * ((high - low) / n)
        out = out.join(numbered(hashed, "_hash", name="_stratum").select("_i", point.alias(name)), "_i")
    return out.withColumnRenamed("_i", ".lhs_id")


def combine_grids(id_name: str = ".source", **grids: DataFrame) -> DataFrame:
    """Grids of the same columns under one another, with the name of each row's grid."""
    out = None
    for name, one in grids.items():
        named = one.withColumn(id_name, F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def describe_grid(df: DataFrame) -> DataFrame:
    """Rows, distinct values, minimum and maximum (as text) of each column. The counts are exact:
    distinct values are found on the map side first."""
    names = df.columns
    aggregates = [F.count("*").alias("rows")]
    for k, c in enumerate(names):
        own = F.col(f"`{c}`")
        aggregates += [F.count_distinct(own).alias(f"d{k}"), F.min(own).cast("string").alias(f"a{k}"), F.max(own).cast("string").alias(f"b{k}")]
    one = df.agg(*aggregates)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("parameter"), "rows", F.col(f"d{k}").alias("n_distinct"), F.col(f"a{k}").alias("min"), F.col(f"b{k}").alias("max")) for k, c in enumerate(names)])))
