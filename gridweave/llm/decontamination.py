"""Benchmark decontamination: pairs of near words join training texts to test items, and Smith-Waterman alignment of words
scores the passages around them, so that edited and paraphrased copies are found too.

1. A seed is a pair of words that are neighbours, or have one word between them, both in the item and in the text.
2. Passages where the seeds of an item weigh enough are aligned with it (match 2, mismatch -1, gap -1). The score is
   divided by that of a whole copy.

No pair that scores ``least`` is missed. From one match of an alignment to the next the score changes by 2 less the words
edited between them, and one without an edit is a seed of weight 2, with one edit a seed of weight 1; so the seeds of an
alignment of ``least`` weigh at least its score less 2. It begins and ends with a seed, and its length is bounded, since
each edit costs 1. Words of an item whose pairs are common in the benchmark need no seeds as long as what they can weigh
at most is taken off that bound and the bound stays positive; the alignment may then begin before the first seed.

Scale: one pass over the texts and no shuffle of them. Items are handled in blocks of a bounded number of words, a pass
over the texts for each, so the tables sent to the tasks have a fixed bound however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shared import drop_stored, stored, values
from gridweave.llm.words import Chunk, chunks

MATCH, MISMATCH, GAP = 2, -1, -1
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A pair at more places of the items than this is common; cells of an alignment table; words of a passage besides its span.
_COMMON, _CELLS, _PIECE = 32, 1 << 17, 4096


def _pairs(chunk: Chunk, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of words of one text so many words apart, and the index of each one's first word."""
    at = np.flatnonzero(chunk.doc[apart:] == chunk.doc[:-apart])
    return chunk.hash[at] * _BASE + chunk.hash[at + apart], at


@dataclass
class Items:
    """Words of some test items and the places of their pairs. ``grams`` are sorted; the places of gram k are
    ``owner[at[k]:at[k + 1]]`` (item) and ``near[...]`` (whether the words are neighbours there). A passage of at most
    ``span`` words scores enough only if its seeds weigh ``need``; it begins at most ``lead`` words before the first."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    near: np.ndarray
    need: np.ndarray
    span: np.ndarray
    lead: np.ndarray
    sieve: np.ndarray

    def hits(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seeds of the texts: the index of each one's first word, its item and its weight."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for apart in (1, 2) if len(self.grams) else ():
            value, first = _pairs(chunk, apart)
            maybe = np.flatnonzero(self.sieve[(value & np.uint64(len(self.sieve) - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.grams, value[maybe]), len(self.grams) - 1)
            real = self.grams[k] == value[maybe]
            first, k = first[maybe[real]], k[real]
            many = self.at[k + 1] - self.at[k]
            entry = np.repeat(self.at[k] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            out.append((np.repeat(first, many), self.owner[entry], 1 + (self.near[entry] & (apart == 1))))
        return tuple(map(np.concatenate, zip(*out, strict=True)))


def items_of(rows: list[tuple], n: int, least: float) -> Items:
    """Items from (item_id, text). An item of fewer than n words has no seeds."""
    chunk = Chunk([(t or "").lower() for _, t in rows], bare=True)
    words = [chunk.hash[chunk.first[i] : chunk.first[i + 1]] for i in range(len(rows))]
    length = np.diff(chunk.first)
    need = np.ceil(MATCH * length * least - MATCH - 1e-9).astype(np.int64)
    (v1, p1), (v2, p2) = _pairs(chunk, 1), _pairs(chunk, 2)
    value, place, near = np.concatenate([v1, v2]), np.concatenate([p1, p2]), np.arange(len(v1) + len(v2)) < len(v1)
    _, which, count = np.unique(value, return_inverse=True, return_counts=True)
    common = np.zeros(len(chunk.hash), np.int64)
    np.maximum.at(common, place, count[which])
    # The commonest words of each item first; of these go as many as leave it a positive bound.
    order = np.lexsort((-common, chunk.doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - chunk.first[chunk.doc[order]]
    gone = (common > _COMMON) & (rank < (need[chunk.doc] - 1) // MATCH)
    lost = np.bincount(chunk.doc[gone], minlength=len(rows))
    need -= MATCH * lost
    keep = ~gone[place] & (length[chunk.doc[place]] >= n)
    value, owner, near = value[keep], chunk.doc[place[keep]], near[keep]
    order = np.argsort(value, kind="stable")
    grams, start = np.unique(value[order], return_index=True)
    sieve = np.zeros(1 << min(24, max(20, (8 * len(grams)).bit_length())), bool)
    sieve[(grams & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
    span = np.ceil(length + MATCH * length * (1 - least)).astype(np.int64)
    return Items([i for i, _ in rows], words, grams, np.append(start, len(value)), owner[order], near[order], need, span, np.where(lost > 0, span, 0), sieve)


def _table(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words side by side, and which places hold one."""
    length = np.array(list(map(len, rows)))
    real = np.arange(length.max()) < length[:, None]
    out = np.zeros(real.shape, np.uint64)
    out[real] = np.concatenate(rows)
    return out, real


def aligned(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its passage, and the end (in words) of its first best alignment."""
    (text, real), (word, held) = _table(passages), _table(items)
    ramp = -GAP * np.arange(text.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(passages), text.shape[1] + 1), np.int32)
    best, end = np.zeros(len(passages), np.int64), np.zeros(len(passages), np.int64)
    for k in range(word.shape[1]):
        same = real & held[:, k, None] & (text == word[:, k, None])
        now = np.zeros_like(row)
        np.maximum(row[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] + np.int32(GAP), out=now[:, 1:])
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + ramp, axis=1) - ramp
        top = row.argmax(axis=1)
        value = row[np.arange(len(row)), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
    return best, end


def passages_of(chunk: Chunk, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, seeds) of the passages whose seeds weigh enough, as words of the chunk; overlapping ones
    are joined, and long ones cut so that each alignment is whole in one piece."""
    first, item, weight = items.hits(chunk)
    if not len(first):
        return []
    # A word of a text begins at most one step of an alignment: of its seeds for an item the heaviest counts.
    wide = len(chunk.hash) + 1
    key = item * wide + first
    order = np.argsort(key, kind="stable")
    key, start = np.unique(key[order], return_index=True)
    weight = np.maximum.reduceat(weight[order], start)
    item, first = key // wide, key % wide
    total = np.concatenate([[0], np.cumsum(weight)])
    stop = np.minimum(first + items.span[item], chunk.first[chunk.doc[first] + 1])
    enough = np.flatnonzero(total[np.searchsorted(key, item * wide + stop)] - total[:-1] >= items.need[item])
    if not len(enough):
        return []
    item, first, stop = item[enough], first[enough], stop[enough]
    text = chunk.doc[first]
    begin = np.maximum(first - items.lead[item], chunk.first[text])
    new = np.ones(len(enough), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (begin[1:] >= stop[:-1])
    head = np.flatnonzero(new)
    out = []
    for i, t, b, e in zip(item[head].tolist(), text[head].tolist(), begin[head].tolist(), stop[np.append(head[1:], len(new)) - 1].tolist(), strict=True):
        for at in range(b, e, _PIECE):
            to = min(e, at + _PIECE + int(items.span[i]))
            seeds = np.searchsorted(key, [i * wide + at, i * wide + to])
            out.append((t, i, at, to, int(seeds[1] - seeds[0])))
            if to == e:
                break
    return out


def matches(chunk: Chunk, items: Items, least: float) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, seeds, begin, end) of the best passage of each text for each item, where the score is at
    least ``least``. begin and end are words of the text: the passage aligned, up to the alignment's end."""
    # A table is as wide as the longer of passage and item.
    wide = lambda x: max(x[3] - x[2], len(items.words[x[1]]))
    found = sorted(passages_of(chunk, items), key=wide)
    out: dict[tuple[int, int], tuple] = {}
    while found:
        size = max(1, _CELLS // wide(found[-1]))
        part, found = found[-size:], found[:-size]
        best, end = aligned([items.words[i] for _, i, *_ in part], [chunk.hash[b:e] for _, _, b, e, _ in part])
        for (t, i, b, _, seeds), top, stop in zip(part, best.tolist(), end.tolist(), strict=True):
            score, b = top / (MATCH * len(items.words[i])), b - int(chunk.first[t])
            if score >= least and ((t, i) not in out or (score, seeds) > out[t, i][:2]):
                out[t, i] = (score, seeds, b, b + stop)
    return [(t, i, score, seeds, b, e) for (t, i), (score, seeds, b, e) in sorted(out.items())]


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return ((t or "").lower() for t in values(batch["text"]))


def _found(docs: DataFrame, items: Items, least: float) -> DataFrame:
    ids = np.array(items.ids, object)

    def work(batches):
        for batch in batches:
            for begin, chunk in chunks(_texts(batch), bare=True):
                rows = matches(chunk, items, least)
                if rows:
                    text, item, score, seeds, b, e = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(pa.array([begin + t for t in text])), pa.array(list(ids[item]), pa.int64()), pa.array(score, pa.float64()), pa.array(seeds, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.int64())],
                        ["doc_id", "item_id", "score", "seeds", "begin_word", "end_word"],
                    )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, item_id long, score double, seeds long, begin_word long, end_word long")


def _blocks(benchmark: DataFrame, n: int, least: float, block_words: int) -> Iterator[Items]:
    """The items with their seeds, a bounded number of words at a time."""
    if n * least <= 1:
        raise ValueError("n * least is above 1: otherwise one word would be a match")
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    items = stored(benchmark.select("item_id", "text").distinct().withColumn("size", size), "items")
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // block_words))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text").collect()
        yield items_of(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), n, least)
    drop_stored(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, score (1 for a whole copy), seeds, begin_word and end_word for each row of ``docs`` (doc_id,
    text) and each item of ``benchmark`` (item_id, text) whose best alignment scores ``least`` or more. Other columns
    are ignored.

    Words are in lower case, parted by white space and ASCII punctuation. Null and empty texts match nothing, nor do
    items of fewer than ``n`` words. Repeated items count once. A row of ``docs`` that is repeated gives its matches
    again; null ids stay null. An empty table on either side gives no rows.
    """
    out = None
    for block in _blocks(benchmark, n, least, block_words):
        found = _found(docs, block, least)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that match no item as :func:`contaminated` has it; decided where
    they are read, without a shuffle."""

    def filtered(rows: DataFrame, block: Items) -> DataFrame:
        def work(batches):
            for batch in batches:
                for begin, chunk in chunks(_texts(batch), bare=True):
                    keep = np.ones(len(chunk.first) - 1, bool)
                    keep[[row[0] for row in matches(chunk, block, least)]] = False
                    yield batch.slice(begin, len(keep)).filter(pa.array(keep))

        return rows.mapInArrow(work, rows.schema)

    out = docs
    for block in _blocks(benchmark, n, least, block_words):
        out = filtered(out, block)
    return out
