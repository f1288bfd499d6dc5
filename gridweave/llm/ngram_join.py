"""Jaccard self-join on word n-grams with Bayesian pruning of candidates (Satuluri and Parthasarathy, "Bayesian
Locality Sensitive Hashing for Fast Similarity Search", 2012).

1. Texts with the same words in the same order make one class, known by 128 bits of a hash of them; one text stands
   for it, so a doc_id with several texts is in several classes.
2. Each representative has 108 MinHash values. Two that share any of 27 bands of four values are compared; a pair at
   the threshold of 0.8 shares none with a probability of 7e-7, the design's only source of loss beside the tolerance.
3. The values of a pair are compared 18 at a time. With a uniform prior on the similarity, the posterior after m
   matches in n is Beta(m + 1, n - m + 1); a pair goes as soon as its probability of reaching the threshold is below
   the tolerance. What remains joins representatives into clusters.
4. Within a cluster pairs are pruned once more in the same way and the rest verified exactly on their n-gram sets.

Scale: large buckets and clusters are dealt into blocks of about 256 by a hash of the document; a task compares two
blocks and returns counts and roots, a row for each document, never the pairs. Copies are counted, not compared.
Texts are read twice and shuffled once, for the exact step.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.components import connected_components
from gridweave.llm.shared import drop_stored, stored, unused, values
from gridweave.llm.words import Chunk, chunks, hashes, mix

BANDS, ROWS = 27, 4
VALUES = BANDS * ROWS
STEP = 18
BLOCK = 256
#: Pairs compared at once in a task.
AT_ONCE = 150_000
_ODD = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def text_grams(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text and the text of each, in order of texts. A text of fewer words than n has
    one: all its words."""
    grams, at = chunk.grams(n)
    text = chunk.doc[at]
    count = np.diff(chunk.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = hashes([chunk.hash[chunk.first[s] : chunk.first[s + 1]].tobytes() for s in short])
        grams, text = np.concatenate([grams, own]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        grams, text = grams[order], text[order]
    return grams, text


def sequence_hashes(chunk: Chunk) -> np.ndarray:
    """128 bits of each text's words in order, as two columns of signed integers."""
    cut = chunk.first.tolist()
    return np.frombuffer(b"".join([blake2b(chunk.hash[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]), "<i8").reshape(-1, 2)


def signatures(grams: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have n-grams, and their MinHash values (a row of VALUES uint32 for each)."""
    have, start = np.unique(text, return_index=True)
    out = np.empty((len(have), VALUES), np.uint32)
    if len(have):
        for k in range(VALUES):
            out[:, k] = np.minimum.reduceat(grams * _ODD[k], start) >> np.uint64(32)
    return have, out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r] + np.uint64(1))
    return key.astype(np.int64)


@cache
def least_matches(threshold: Fraction, tolerance: float) -> tuple[int, ...]:
    """For 18, 36, ... values the fewest matches with which a pair may still reach the threshold."""
    t, out = float(threshold), []
    for n in range(STEP, VALUES + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of ``sig``) that are not pruned."""
    matches = np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        cut = slice(k * STEP, (k + 1) * STEP)
        matches += (sig[a, cut] == sig[b, cut]).sum(axis=1)
        alive = matches >= need
        a, b, matches = a[alive], b[alive], matches[alive]
    return a, b


def pair_slices(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups that lie one after another, some at a time."""
    starts = np.cumsum(sizes) - sizes
    amount = sizes * (sizes - 1) // 2
    at = 0
    while at < len(sizes):
        till = at + max(1, int(np.searchsorted(np.cumsum(amount[at:]), AT_ONCE, side="right")))
        first, size = starts[at], sizes[at:till]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        more = np.repeat(size, size) - 1 - place
        a = np.repeat(np.arange(len(place)), more)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)
        yield a + first, b + first
        at = till


def roots(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name that each of n rows is connected with by the pairs."""
    root = names.copy()
    while len(a):
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' sizes, from batches sorted by ``keys`` (no nulls)."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        change = _changes(table, keys)
        rest = table.slice(change[-1]) if len(change) else table
        if len(change) and change[-1]:
            yield table.slice(0, change[-1]), np.diff(change)
    if rest is not None and len(rest):
        yield rest, np.diff(np.append(_changes(rest, keys), len(rest)))


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        values = table[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _blocks(df: DataFrame, group: str, size: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: columns low, high and block."""
    count = F.ceil(F.col(size) / BLOCK).cast("int")
    own = df.withColumns({"_n": count, "block": F.pmod(F.xxhash64("node"), count.cast("long")).cast("int")})
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")}).drop("_other", "_n")
    return dealt.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", "node")


def _texts_signed(docs: DataFrame, n: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for begin, chunk in chunks((t or "").lower() for t in values(batch["text"])):
                count = len(chunk.first) - 1
                keys = _keys(chunk)
                have, sig = signatures(*text_grams(chunk, n))
                sigs, bands = [None] * count, [None] * count
                for row, s, band in zip(have, sig, band_keys(sig), strict=True):
                    sigs[row], bands[row] = s.tobytes(), band
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(begin, count), *keys, pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "sig", "bands"])

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(work, "doc_id long, k1 long, k2 long, sig binary, bands array<long>")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _candidate_edges(buckets: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """For each pair of blocks, who is connected with whom by pairs that survive pruning."""

    def work(batches):
        for table, sizes in whole_groups(batches, ["key", "low", "high"]):
            names, sig = table["node"].to_numpy(), _matrix(table["sig"], VALUES)
            block, across = table["block"].to_numpy(), table["low"].to_numpy() != table["high"].to_numpy()
            group = np.repeat(np.arange(len(sizes)), sizes)
            for a, b in pair_slices(sizes):
                apart = (names[a] != names[b]) & (~across[a] | (block[a] != block[b]))
                a, b = pruned(sig, a[apart], b[apart], least)
                if not len(a):
                    continue
                rows = np.unique(np.concatenate([a, b]))
                root = roots(len(rows), np.searchsorted(rows, a), np.searchsorted(rows, b), names[rows])
                far = root != names[rows]
                yield pa.RecordBatch.from_arrays([pa.array(names[rows][far]), pa.array(root[far])], ["a", "b"])

    return buckets.mapInArrow(work, "a long, b long")


def _shared_counts(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many n-grams each pair has in common; ``grams`` are sorted sets."""
    if len(a) < 64:
        return np.array([len(np.intersect1d(grams[i], grams[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    rows = np.unique(np.concatenate([a, b]))
    value, column, times = np.unique(np.concatenate([grams[r] for r in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(grams[r]) for r in rows])
    common = times[column] > 1  # others are in no two of them
    owner, column = owner[common], (np.cumsum(times > 1) - 1)[column[common]]
    total = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 2048
    for at in range(0, int((times > 1).sum()), width):
        own = slice(*np.searchsorted(column, [at, at + width]))
        part = np.zeros((len(rows), width), np.float32)
        part[owner[own], column[own] - at] = 1
        total += part @ part.T
    return total[np.searchsorted(rows, a), np.searchsorted(rows, b)].astype(np.int64)


def _verified(members: DataFrame, threshold: Fraction, least: tuple[int, ...]) -> DataFrame:
    """For each pair of blocks of a cluster and each class in them: its links there and its root."""

    def work(batches):
        for table, sizes in whole_groups(batches, ["cluster", "low", "high"]):
            names, sig, copies = table["node"].to_numpy(), _matrix(table["sig"], VALUES), table["copies"].to_numpy()
            block, across = table["block"].to_numpy(), table["low"].to_numpy() != table["high"].to_numpy()
            grams = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
            length = np.array([len(g) for g in grams], np.int64)
            for at in np.split(np.arange(len(names)), np.cumsum(sizes)[:-1]):
                a, b = next(pair_slices(np.array([len(at)])))
                a, b = a + at[0], b + at[0]
                apart = ~across[a] | (block[a] != block[b])
                a, b = pruned(sig, a[apart], b[apart], least)
                shared = _shared_counts(grams, a, b)
                linked = shared * threshold.denominator >= threshold.numerator * (length[a] + length[b] - shared)
                a, b = a[linked] - at[0], b[linked] - at[0]
                own = copies[at]
                links = np.bincount(a, own[b], len(at)) + np.bincount(b, own[a], len(at))
                root = roots(len(at), a, b, names[at])
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(root), pa.array(links.astype(np.int64)), pa.array(table["blocks"].to_numpy()[at])], ["node", "root", "links", "blocks"])

    return members.mapInArrow(work, "node long, root long, links long, blocks int")


def _keys(chunk: Chunk) -> list[pa.Array]:
    keys = sequence_hashes(chunk)
    return [pa.array(keys[:, 0]), pa.array(keys[:, 1])]


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id (smallest doc_id it is connected with by links), n_links (documents whose texts have a Jaccard
    similarity of at least ``threshold`` on sets of n-word windows, itself left out), copy_id (smallest doc_id with the
    same words), k1 and k2 (the hash of the words) and class_key (one number for each class; null without words), for
    each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are what white space parts, in lower case. A text of fewer than n words has one window, all its words. Null
    texts and texts without words have no links and make classes of their own. Rows that repeat a doc_id and its text
    are one document, and each is returned; a doc_id's other texts are compared as those of other documents are. Rows
    with a null doc_id are left out. No rows give no rows.
    """
    limit = Fraction(str(threshold))
    least = least_matches(limit, tolerance)
    signed = stored(_texts_signed(docs, n), "signatures")
    worded = signed.where(F.col("sig").isNotNull())
    # Classes have numbers of their own in graphs, which are part of the stored table and so stay what they are.
    counted = worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_id"), F.count_distinct("doc_id").alias("copies"))
    classes = stored(counted.withColumn("node", F.monotonically_increasing_id()), "classes")

    standing = worded.select("doc_id", "k1", "k2", "bands").join(classes.select(F.col("copy_id").alias("doc_id"), "k1", "k2", "node"), ["doc_id", "k1", "k2"])
    keys = stored(standing.select("node", F.explode("bands").alias("key")).distinct(), "bands")
    crowded = stored(keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1), "buckets")
    placed = keys.join(crowded, "key")
    crowd = placed.select("node").distinct().join(classes.select("node", "k1", "k2", F.col("copy_id").alias("doc_id")), "node")
    sigs = worded.select("doc_id", "k1", "k2", "sig").join(crowd, ["doc_id", "k1", "k2"]).groupBy("node").agg(F.min("sig").alias("sig"))
    edges = _candidate_edges(_blocks(placed.join(sigs, "node").select("key", "size", "node", "sig"), "key", "size"), least)

    joined = connected_components(edges)
    clusters = stored(joined, "clusters")
    sizes = stored(clusters.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    member = clusters.join(sizes, "component").join(classes.select("node", "k1", "k2", "copy_id", "copies"), "node")
    # A doc_id with several texts brings them all; the one that is the class's is known by its key.
    texts = docs.select("doc_id", "text").join(member.withColumnRenamed("copy_id", "doc_id"), "doc_id").select("node", "k1", "k2", "component", "size", "copies", "text")

    def with_grams(batches):
        for batch in batches:
            for begin, chunk in chunks((t or "").lower() for t in values(batch["text"])):
                count = len(chunk.first) - 1
                named = np.column_stack([batch[c].slice(begin, count).to_numpy() for c in ("k1", "k2")])
                own = np.flatnonzero((sequence_hashes(chunk) == named).all(axis=1))
                grams, text = text_grams(chunk, n)
                have, sig = signatures(grams, text)
                cut = np.searchsorted(text, np.arange(count + 1))
                place = np.searchsorted(have, own)
                kept = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch[c].slice(begin, count).take(kept) for c in ("node", "component", "size", "copies")], pa.array([sig[k].tobytes() for k in place], pa.binary()),
                        pa.array([np.unique(grams[cut[i] : cut[i + 1]]).tobytes() for i in own], pa.binary()),
                    ],
                    ["node", "cluster", "size", "copies", "sig", "grams"],
                )

    members = stored(texts.mapInArrow(with_grams, "node long, cluster long, size long, copies long, sig binary, grams binary").dropDuplicates(["node"]), "members")
    dealt = _blocks(members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "cluster", "size")
    found = stored(_verified(dealt, limit, least), "links")

    totals = found.groupBy("node").agg(F.min("root").alias("root"), F.sum("links").alias("links"), F.max("blocks").alias("blocks"))
    wide = found.where((F.col("blocks") > 1) & (F.col("node") != F.col("root"))).select(F.col("node").alias("a"), F.col("root").alias("b"))
    across = connected_components(wide)
    labels = totals.join(across, "node", "left").select("node", "links", F.coalesce("component", F.when(F.col("blocks") > 1, F.col("node")).otherwise(F.col("root"))).alias("_class"))
    labelled = stored(classes.join(labels, "node", "left").withColumn("_class", F.coalesce("_class", "node")), "labelled")
    least_id = labelled.groupBy("_class").agg(F.min("copy_id").alias("class_id"))
    known = stored(labelled.join(least_id, "_class").select("k1", "k2", "copy_id", "class_id", F.col("_class").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    for table in (classes, keys, crowded, joined, clusters, sizes, members, found, across, labelled):
        drop_stored(table)
    bare = signed.where(F.col("sig").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), "k1", "k2", F.lit(None).cast("long").alias("class_key"))
    return worded.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).select("doc_id", "class_id", "n_links", "copy_id", "k1", "k2", "class_key").unionByName(bare)


def without_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row, all columns as they are, of each class of :func:`ngram_join`: of its smallest doc_id (and key, where that
    has several texts in the class). Rows without words stay, each doc_id and text once; rows with a null doc_id stay."""
    found = ngram_join(docs, n, threshold)
    row = F.struct("doc_id", "k1", "k2")
    keep = found.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min(row).alias("r")).select("r.*")
    keep = keep.unionByName(found.where(F.col("class_key").isNull()).select("doc_id", "k1", "k2").distinct())
    k1, k2 = unused(docs.columns, "_k1", "_k2")
    fields = T.StructType([*docs.schema, T.StructField(k1, T.LongType()), T.StructField(k2, T.LongType())])

    def keyed(batches):
        for batch in batches:
            for begin, chunk in chunks((t or "").lower() for t in values(batch["text"])):
                part = batch.slice(begin, len(chunk.first) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, *_keys(chunk)], [*part.schema.names, k1, k2])

    named = docs.where(F.col("doc_id").isNotNull()).mapInArrow(keyed, fields)
    kept = named.join(keep.select("doc_id", F.col("k1").alias(k1), F.col("k2").alias(k2)), ["doc_id", k1, k2], "left_semi").dropDuplicates(["doc_id", k1, k2])
    return kept.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
