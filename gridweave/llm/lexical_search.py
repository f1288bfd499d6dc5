"""Ranked lexical search, impact-ordered and score-at-a-time.

1. Each document is read once: how many terms it has, and how often each term of the items. This forward table is stored.
2. One pass over it counts documents, their terms, and the documents of each term; weights of terms follow.
3. One pass over it searches. A task turns some documents at a time into postings, for each term in groups of exactly equal
   impact, the largest first. For an item the groups are added up in descending order of what they contribute, until
   the k-th largest sum is above all that the remaining groups can give together: documents not met yet are out. Those
   whose sum and bound still reach it get their complete scores from the forward table.
4. The k best of each task are ranked together.

Scale: postings are never shuffled; an item's rows in the last step are k for each task, and Spark drops all but k of a
partition before the exchange. A task holds some documents' postings and k documents for each item; later documents of a
task have to reach the k-th score of those before. Items are taken in blocks of a bounded number of characters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.shared import drop_stored, stored
from gridweave.llm.words import CHUNK_BYTES, spans

#: Bytes of terms: ASCII letters and digits and all beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Constants of the score.
SCALE, SATURATION, LENGTH, B = 1_000_000_000, 1000, 8, 75
#: Documents are searched together up to so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 16
#: Bits of a posting's sort key that hold its impact.
_BITS = 36
_MOST = (1 << _BITS) - 1


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The text of each term in order, a number for each term, equal where the terms are, and the term of each number."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _TERM[data]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    stop = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    number, different = spans(data, start, end)
    return np.searchsorted(stop, start, side="right"), number, different


@dataclass(frozen=True)
class Items:
    """Items of a block: their ids, the terms of all of them by number, and for each item its terms and how often."""

    ids: list[int | None]
    known: dict[bytes, int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def items_of(rows: list[tuple[int | None, str]]) -> Items:
    known: dict[bytes, int] = {}
    terms, counts = [], []
    for _, text in rows:
        _, number, different = terms_of([text.encode()])
        own = np.array([known.setdefault(t, len(known)) for t in different], np.int64)
        found, count = np.unique(own[number] if len(number) else own, return_counts=True)
        terms.append(found)
        counts.append(count.astype(np.int64))
    return Items([i for i, _ in rows], known, terms, counts)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[Items]:
    """The items without repetition, a bounded number of characters at a time."""
    kept = stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    total = kept.agg(F.coalesce(F.sum(F.char_length("text") + 1), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // block_chars))
    for part in range(parts):
        rows = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield items_of(sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
    drop_stored(kept)


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def forward(docs: DataFrame, items: Items) -> DataFrame:
    """For each row of ``docs``: doc_id, ``n`` (its terms with repeats), ``terms`` (numbers of the items' terms in it) and
    ``tf`` (how often each occurs)."""
    known, wide = items.known, max(1, len(items.known))

    def part(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        doc, number, different = terms_of(texts)
        meant = np.array([known.get(t, -1) for t in different], np.int64)
        own = meant[number] if len(number) else meant
        key, tf = np.unique(doc[own >= 0] * wide + own[own >= 0], return_counts=True)
        return np.bincount(doc, minlength=len(texts)), key // wide, key % wide, tf

    def work(batches):
        for batch in batches:
            texts, begin, found = [(t or "").encode() for t in batch["text"].to_pylist()], 0, []
            while begin < len(texts):
                end, size = begin + 1, len(texts[begin])
                while end < len(texts) and size + len(texts[end]) <= CHUNK_BYTES:
                    size, end = size + len(texts[end]), end + 1
                n, doc, term, tf = part(texts[begin:end])
                found.append((n, doc + begin, term, tf))
                begin = end
            if found:
                n, doc, term, tf = map(np.concatenate, zip(*found, strict=True))
                columns = [batch["doc_id"], pa.array(n.astype(np.int64)), _lists(term, doc, len(texts)), _lists(tf, doc, len(texts))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n long, terms array<int>, tf array<int>")


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, list[int]]:
    """Documents with a term, terms of all of them, and the documents of each of the items' terms."""

    def work(batches):
        df, docs, length = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            n = batch["n"].to_numpy()
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
            df += np.bincount(batch["terms"].flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held]), pa.int64()), pa.array(np.concatenate([[docs, length], df[held]]), pa.int64())], ["term", "v"])

    found = {r[0]: int(r[1]) for r in rows.select("n", "terms").mapInArrow(work, "term long, v long").groupBy("term").agg(F.sum("v")).collect()}
    return found.get(-2, 0), found.get(-1, 0), [found.get(t, 0) for t in range(n_terms)]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Postings of some documents. ``name`` and ``n`` are the documents' ids and numbers of terms; ``term`` and ``impact``
    stand in the order of documents (``first``: where each begins), ``posted`` in that of terms and falling impact."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, length: int):
        wide = B * int(n.max(initial=0)) * n_docs >= 1 << 63
        norm = (100 - B) + ((B * n.astype(object) * n_docs) // max(1, length) if wide else (B * n * n_docs) // max(1, length)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.term, doc = term, np.repeat(np.arange(len(n)), sizes)
        self.impact = weights[term] * ((SCALE * tf) // (SATURATION * tf + LENGTH * norm[doc]))
        key = (term << _BITS) | (_MOST - self.impact)
        order = np.argsort(key)
        self.key, self.doc = key[order], doc[order]
        self.total = np.zeros(len(n), np.int64)

    def search(self, terms: np.ndarray, counts: np.ndarray, dense: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and their scores, that can be among the ``k`` best and score ``floor`` or more, all of the k best with
        them. ``dense`` has each term's count in the item by its number."""
        total = self.total
        total[:] = 0
        at = np.searchsorted(self.key, terms << _BITS)
        stop = np.searchsorted(self.key, (terms << _BITS) | _MOST, side="right")
        while True:
            left = at < stop
            head = np.where(left, counts * (_MOST - (self.key[np.minimum(at, len(self.key) - 1)] & _MOST)), 0) if len(self.key) else np.zeros(len(terms), np.int64)
            rest, remaining = int(head.sum()), int((stop - at).sum())
            reached = int(np.partition(total, len(total) - k)[len(total) - k]) if len(total) >= k else 0
            reached = max(reached, floor, 1)
            if not remaining or reached > rest:
                near = np.flatnonzero(total + rest >= reached)
                if not remaining:
                    return near, total[near]
                near = near[total[near] > 0]
                if int((self.first[near + 1] - self.first[near]).sum()) <= 2 * remaining:
                    return near, self.complete(near, dense)
            # All groups that contribute at least three quarters of what the best one does.
            level = -(-3 * int(head.max()) // 4)
            to = np.maximum(at, np.searchsorted(self.key, (terms << _BITS) | np.maximum(_MOST - -(-level // counts), 0), side="right"))
            if not level:
                to = stop
            size = to - at
            place = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
            np.add.at(total, self.doc[place], np.repeat(counts, size) * (_MOST - (self.key[place] & _MOST)))
            at = to

    def complete(self, near: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The whole scores of the documents ``near``."""
        size = self.first[near + 1] - self.first[near]
        place = np.arange(int(size.sum())) + np.repeat(self.first[near] - (np.cumsum(size) - size), size)
        out = np.zeros(len(near), np.int64)
        np.add.at(out, np.repeat(np.arange(len(near)), size), dense[self.term[place]] * self.impact[place])
        return out


def _best(rows: DataFrame, items: Items, k: int, n_docs: int, length: int, df: list[int]) -> DataFrame:
    """item, doc_id, score: at least the ``k`` best documents of each task for each item, the items by number."""
    weights = np.array([weight(n_docs, d) for d in df], np.int64)
    last = np.iinfo(np.int64).max

    def work(batches):
        top: list[list[tuple[int, bool, int]]] = [[] for _ in items.ids]
        dense = np.zeros(max(1, len(df)), np.int64)

        def searched(held: list[pa.RecordBatch]) -> None:
            name = np.concatenate([b["doc_id"].fill_null(last).to_numpy() for b in held])
            null = np.concatenate([b["doc_id"].is_null().to_numpy(zero_copy_only=False) for b in held])
            n, sizes, term, tf = (np.concatenate([part(b) for b in held]).astype(np.int64) for part in (lambda b: b["n"].to_numpy(), lambda b: b["terms"].value_lengths().to_numpy(), lambda b: b["terms"].flatten().to_numpy(), lambda b: b["tf"].flatten().to_numpy()))
            shard = Shard(n, sizes, term, tf, weights, n_docs, length)
            for item, (terms, counts) in enumerate(zip(items.terms, items.counts, strict=True)):
                dense[terms] = counts
                best = top[item]
                near, score = shard.search(terms, counts, dense, k, best[k - 1][0] if len(best) == k else 1)
                dense[terms] = 0
                keep = score > 0
                near, score = near[keep], score[keep]
                order = np.lexsort((name[near], null[near], -score))[:k]
                found = [(int(s), bool(x), int(d)) for s, x, d in zip(score[order], null[near[order]], name[near[order]], strict=True)]
                top[item] = sorted(best + found, key=lambda r: (-r[0], r[1], r[2]))[:k]

        held, size, count = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_DOCS):
                part = batch.slice(at, SHARD_DOCS)
                held, size, count = [*held, part], size + len(part["terms"].flatten()), count + part.num_rows
                if size >= SHARD_POSTINGS or count >= SHARD_DOCS:
                    searched(held)
                    held, size, count = [], 0, 0
        if count:
            searched(held)
        out = [(i, None if null else d, s) for i, best in enumerate(top) for s, null, d in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return rows.mapInArrow(work, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = 8_000_000) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` rows of ``docs`` (doc_id, text) that score highest, above 0, for each
    item of ``items`` (item_id, text); equal scores by ascending doc_id, nulls last. Other columns are ignored.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. Null and empty texts
    have none: such documents are found by no item, and such items find nothing. Every row of ``docs`` is a document, so
    a repeated row is found as often as it is there. Rows of ``items`` with one item_id and different texts are
    searched apart under the same item_id, repeated rows once; ids that are null stay null. An empty table on either
    side gives no rows.
    """
    out = None
    for block in _blocks(items, block_chars):
        rows = stored(forward(docs, block), "forward")
        best = _best(rows, block, k, *statistics(rows, len(block.known)))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # As many rows as the block has items.
        names = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return out
