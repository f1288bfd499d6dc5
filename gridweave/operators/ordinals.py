"""Row numbers in an order, without sending all rows or one large group to a single task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_ranges(df: DataFrame, ordinal: str, parts: int, name: str = "_block") -> DataFrame:
    """``df`` with the number of the range its ordinal lies in. The ranges have about equal numbers of rows however the
    ordinals are spread; their limits come from quantiles, for which the column is read once when this is called. What
    has no ordinal is in a last range."""
    own = df.withColumn("_ordinal", F.col(ordinal).cast("double"))
    limits = own.approxQuantile("_ordinal", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    if not limits:
        return df.withColumn(name, F.lit(0))
    splits = [-float("inf"), *sorted(set(limits)), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_ordinal", outputCol=name, handleInvalid="keep").transform(own)
    return ranged.withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(len(splits)))).drop("_ordinal")


def numbered(df: DataFrame, ordinal: str, by: tuple[str, ...] = (), name: str = "row_number", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of the whole number ``ordinal`` (unique), within ``by`` if given.

    Rows are numbered within ``parts`` ranges of ordinals (four for each shuffle partition unless given), and the ranges'
    counts are summed up: the only window over a whole group is over one row for each range, and the rows of a hot group
    are dealt by range.
    """
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_ranges(df, ordinal, parts)
    counts = rows.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy("_block") if by else Window.orderBy("_block")
    offsets = counts.select(*by, "_block", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    condition = rows["_block"] == offsets["_block"]
    for c in by:
        condition &= rows[c].eqNullSafe(offsets[c])
    # Without groups there is a row for each range, and so a bound.
    joined = rows.join(offsets if by else F.broadcast(offsets), condition).drop(*[offsets[c] for c in (*by, "_block")])
    local = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(ordinal))
    return joined.withColumn(name, (F.col("_before") + local).cast("long")).drop("_block", "_before")


def running_total(df: DataFrame, ordinal: str, value: str, name: str = "before", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of the doubles ``value`` of all rows before each one in the order of ``ordinal`` (unique),
    added up within ranges and over the ranges' sums as :func:`numbered` does it."""
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_ranges(df, ordinal, parts)
    sums = rows.groupBy("_block").agg(F.sum(value).alias("_sum"))
    offsets = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    local = F.coalesce(F.sum(value).over(Window.partitionBy("_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.join(F.broadcast(offsets), "_block").withColumn(name, F.col("_before") + local).drop("_block", "_before")
