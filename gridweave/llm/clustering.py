"""Centroid clustering with integer vectors: Lloyd's rounds over distinct vectors with multiplicities.

Vectors become whole numbers, equal ones are grouped and counted, every round assigns the distinct ones only and adds
up multiplicity times vector, and the assignments are joined back to the rows at the end. All arithmetic is exact, so
results do not depend on how rows are dealt to tasks.

Scale: grouping combines on the map side, so a vector that a third of all rows have costs one row a task. A round is one
pass over the distinct vectors and sends k sums a task; the driver holds k centroids. The join back has a plain exchange
on either side, so adaptive execution splits a hot vector.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shared import drop_stored, stored

#: Components are below this in size, so that squared distances fit a long.
LARGEST = 1 << 27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    """vec_id and ``q``, the components as floor(scale * x), of the vectors with ``size`` finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = lambda v: v.cast("double") * scale
    whole = F.transform(x, lambda v: F.when(F.abs(scaled(v)) < LARGEST, F.floor(scaled(v)).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {LARGEST}")).cast("int")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size(x) == size) & finite).select("vec_id", whole.alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` rows with the smallest SHA-256 of ``seed:vec_id``; rows without a vec_id come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["q"] for r in rows.orderBy(digest.asc_nulls_last(), "q").limit(k).collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row of ``x`` (ties: the smallest) and the squared distance."""
    if x.shape[1] * float(abs(x).max(initial=0)) * float(abs(centroids).max(initial=0)) < 2**53:
        product = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        product = x @ centroids.T
    apart = (x * x).sum(1)[:, None] - 2 * product + (centroids * centroids).sum(1)
    cluster = apart.argmin(1)
    return cluster, apart[np.arange(len(x)), cluster]


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch["q"].flatten().to_numpy().reshape(-1, size).astype(np.int64)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that is nearest to some vector: how many rows, and the sum of their vectors."""
    size = centroids.shape[1]

    def work(batches):
        # Python's whole numbers do not overflow; a batch's products are of one vector at a time below 2 ** 63.
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, n = _vectors(batch, size), batch["n"].to_numpy()
            cluster, _ = nearest(x, centroids)
            safe = float(abs(x).max(initial=0)) * float(n.sum()) < 2**62
            weight, x = (n, x) if safe else (n.astype(object), x.astype(object))
            for c in np.unique(cluster).tolist():
                own = cluster == c
                now = np.append((x[own] * weight[own, None]).sum(0), weight[own].sum()).astype(object)
                total[c] = total[c] + now if c in total else now
        rows = [(c, at, Decimal(int(v))) for c, sums in total.items() for at, v in enumerate(sums)]
        if rows:
            c, at, v = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(v, pa.decimal128(38, 0))], ["cluster", "at", "v"])

    parts = distinct.mapInArrow(work, "cluster int, at int, v decimal(38,0)")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum("v").alias("v")).orderBy("cluster", "at").collect():
        found.setdefault(r["cluster"], []).append(int(r["v"]))
    return {c: (v[-1], v[:-1]) for c, v in found.items()}


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after ``rounds`` rounds over ``distinct`` (q, n): each becomes the floor of its vectors' mean, those
    nearest to no vector stay."""
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, sums) in _sums(distinct, centroids).items():
            moved[c] = [s // n for s in sums]
        centroids = moved
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``distinct`` (q, n) with cluster and distance."""
    size = centroids.shape[1]

    def work(batches):
        for batch in batches:
            cluster, distance = nearest(_vectors(batch, size), centroids)
            yield pa.RecordBatch.from_arrays([batch["q"], batch["n"], pa.array(cluster.astype(np.int32)), pa.array(distance)], ["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(work, "q array<int>, n long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of ``vectors`` (vec_id,
    embedding; other columns are ignored) that has exactly ``size`` components, all of them finite.

    Rows with null, shorter or longer vectors or with a component that is null, NaN or infinite give no row. Every row
    of a repeated vec_id counts and is returned; a null vec_id stays null and starts no centroid while others are left.
    Fewer than ``k`` rows start fewer centroids; none give no rows. A component that reaches 2**27 when scaled is an
    error, as squared distances would not fit a long; so is an inertia beyond a long.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, size)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    distinct = stored(rows.groupBy("q").agg(F.count("*").alias("n")), "vectors")
    centroids = lloyd(distinct, centroids, rounds)
    found = stored(assigned(distinct, centroids), "assigned")
    drop_stored(distinct)

    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("distance"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row for each centroid, and so at most k.
    totals = spark.createDataFrame([(c, v, sum(inertia.values()), digest[c]) for c, v in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(found.select("q", "cluster", "distance"), "q").join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
