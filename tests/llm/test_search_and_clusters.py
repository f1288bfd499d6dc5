"""Ranked search and centroid clustering against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import clustering as C
from gridweave.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for d, b in bags:
            m = 25 + (75 * sum(b.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(x for x in scored if x[0])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def test_search_odd_texts(spark):
    rng = random.Random(3)
    words = ["Ab", "ab", "AB", "été", "Été", "数据", "\U0001f600", "c3", "\0", "_", "-", "it's", "\x7f", "x" * 200]
    text = lambda n: rng.choice([" ", "\n", "."]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 50]))) for i in range(120)] + [(3, text(20))] * 3 + [(None, text(20)), (None, None), (7, None), (8, ""), (9, "-_"), (10, text(30_000))]
    items = [(i, text(6)) for i in range(8)] + [(1, text(4)), (1, "ab"), (None, "ab ab c3"), (20, None), (21, ""), (22, "nowhere"), (23, "ab " * 500), (24, "ab"), (24, "ab")]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, item int").repartition(4)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    want = plain_search(docs, items)
    assert found(L.search(frame, asked)) == want
    assert found(L.search(frame, asked, block_chars=40)) == want
    assert found(L.search(frame, asked, k=3)) == plain_search(docs, items, 3)


def test_search_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert found(L.search(docs.limit(0), items)) == found(L.search(docs, items.limit(0))) == []
    assert [r[:3] for r in found(L.search(docs, items))] == [(1, 1, 1)]


@pytest.mark.parametrize("seed", range(30))
def test_stops_only_when_proven(seed):
    """A shard's search gives the k best, with and without a floor, whatever the weights and ties."""
    rng = np.random.default_rng(seed)
    n_terms, n_docs, k = 40, int(rng.integers(1, 400)), int(rng.integers(1, 12))
    sizes = rng.integers(0, 20, n_docs)
    term = np.concatenate([np.sort(rng.choice(n_terms, s, replace=False, p=(p := rng.power(0.3, n_terms)) / p.sum())) for s in sizes] + [np.zeros(0, np.int64)]).astype(np.int64)
    tf = rng.integers(1, 4, len(term))
    n = np.bincount(np.repeat(np.arange(n_docs), sizes), tf, n_docs).astype(np.int64) + rng.integers(0, 3, n_docs) * 10
    weights = rng.integers(0, [3, 9000][seed % 2], n_terms)
    shard = L.Shard(n, sizes, term, tf, weights, n_docs, int(n.sum()))
    for _ in range(6):
        own = np.sort(rng.choice(n_terms, rng.integers(1, 15), replace=False))
        counts = rng.integers(1, 4, len(own))
        dense = np.zeros(n_terms, np.int64)
        dense[own] = counts
        score = np.bincount(np.repeat(np.arange(n_docs), sizes), dense[term] * shard.impact, n_docs).astype(np.int64)
        for floor in (1, int(np.median(score)), int(score.max())):
            near, got = shard.search(own, counts, dense, k, max(floor, 1))
            assert (got == score[near]).all()
            least = max(np.sort(score)[-k] if n_docs >= k else 0, floor, 1)
            assert set(np.flatnonzero(score >= least)) <= set(near.tolist())


def test_search_reads_few_postings():
    """A rare term decides: of a frequent one next to nothing is added up."""
    n = np.full(50_000, 20, np.int64)
    sizes = np.where(np.arange(50_000) < 30, 2, 1)
    term = np.concatenate([[0, 1] * 30, np.zeros(50_000 - 30)]).astype(np.int64)
    shard = L.Shard(n, sizes, term, np.ones(len(term), np.int64), np.array([1, 9000]), 50_000, int(n.sum()))
    near, _ = shard.search(np.array([0, 1]), np.array([1, 1]), np.array([1, 1]), 10, 1)
    assert sorted(near) == list(range(30))
    assert np.count_nonzero(shard.total) == 30


def plain_clusters(rows, k, rounds, size, scale=64):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        cents = [tuple(sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)) if j in groups else c for j, c in enumerate(cents)]
    got = [(i, near(q)) for i, q in kept]
    own = Counter()
    for _, (d, j) in got:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, (d, j) in got), key=str)


def clustered(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("k, n", [(5, 300), (4, 3), (16, 40)])
def test_clusters_odd_vectors(spark, k, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(n)]
    rows += [(i, [0.25] * 4) for i in range(1000, 1000 + n)] + [(2, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0]), (2, [9.0] * 4), (None, [0.1] * 4), (None, [-5.0] * 4)]
    rows += [(5000, None), (5001, []), (5002, [1.0] * 3), (5003, [1.0] * 5), (5004, [1.0, None, 1.0, 1.0]), (5005, [float("nan")] * 4), (5006, [float("inf"), 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, n int, q string").repartition(3)
    assert clustered(C.cluster_vectors(frame, k=k, size=4)) == plain_clusters(rows, k, 3, 4)


def test_clusters_large_components_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**20 for _ in range(3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustered(C.cluster_vectors(frame, k=4, size=3)) == plain_clusters(rows, 4, 3, 3)
    assert clustered(C.cluster_vectors(frame.limit(0), size=3)) == []
    assert C.cluster_vectors(frame, size=64).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="a component times 64 reaches"):
        C.cluster_vectors(spark.createDataFrame([(1, [2.0**40] * 3)], "vec_id long, embedding array<double>"), size=3).collect()
