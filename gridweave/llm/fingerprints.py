"""Context-triggered piecewise hashing of documents.

A rolling hash of the last seven bytes ends a chunk wherever its lowest ``k`` bits are 0, so chunks follow the content and
an edit changes those around it only. A signature has one character for each chunk. A fingerprint is
``block:signature:signature``: of block size 2**k, the smallest that gives at most 64 chunks, and of twice that size.
Fingerprints are compared by the edit distance of signatures of one block size (insertions and deletions cost 1,
replacements 2); where no block size is common the likeness is 0.

:func:`fingerprints` reads each text once, where it lies. :func:`edited_fingerprints` needs each document beside the next
one: one shuffle by ranges of doc_id, whose limits come from the doc_id column alone, with the first document of each range
sent to the range before it as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.words import CHUNK_BYTES, mix
from gridweave.operators.ordinals import in_ranges

#: Bytes of the rolling window, characters of a signature at most, and the run of characters that two signatures must have
#: in common to be alike (less in short ones): ends of unrelated texts meet by chance now and then, four in a row hardly do.
WINDOW, LONGEST, RUN = 7, 64, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_SALT, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3
_ROUND = 1 << 64


class Signatures:
    """Of several texts: ``level`` (k), ``first`` and ``second`` as rows of characters, 0 behind their end, and the
    lengths of both."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        size = np.fromiter(map(len, texts), np.int64, n)
        # Zeros before each text, so that windows do not reach into the one before.
        whole = b"".join(bytes(WINDOW) + t for t in texts) + bytes(8)
        begin = np.cumsum(size + WINDOW) - size
        self.level = np.zeros(n, np.int64)
        self.first, self.second = np.zeros((n, LONGEST), np.uint8), np.zeros((n, LONGEST), np.uint8)
        self.lengths = np.zeros((2, n), np.int64)
        if not n or not size.sum():
            return
        data = np.frombuffer(whole, np.uint8)[:-8]
        inside = np.ones(len(data), bool)
        for k in range(WINDOW):
            inside[begin - 1 - k] = False
        ends = np.flatnonzero(inside)
        eight = np.ndarray((len(data),), "<u8", whole, strides=(1,))
        rolled = mix((eight[ends - WINDOW] >> np.uint64(8)) ^ _SALT)
        power, inverse = _powers(len(data))
        self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        self._inverse, stop = inverse, begin + size

        open_, seconds, k = np.flatnonzero(size), np.zeros(0, np.int64), 0
        while len(open_) or len(seconds):
            if k:
                keep = (rolled & np.uint64(1 << (k - 1))) == 0 if k <= 64 else np.zeros(len(rolled), bool)
                ends, rolled = ends[keep], rolled[keep]
            low, high = np.searchsorted(ends, begin), np.searchsorted(ends, stop)
            # What follows the last trigger is a chunk too.
            rest = (size > 0) & ((high == low) | (ends[np.maximum(high - 1, 0)] != stop - 1)) if len(ends) else size > 0
            chunks = high - low + rest
            done = chunks[open_] <= LONGEST
            firsts, open_ = open_[done], open_[~done]
            self.level[firsts] = k
            for row, part, which in ((0, firsts, self.first), (1, seconds, self.second)):
                self.lengths[row, part] = chunks[part]
                self._fill(which, part, ends, low, high, rest, begin, stop)
            seconds, k = firsts, k + 1

    def _fill(self, out: np.ndarray, part: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rest: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> None:
        """The characters of the texts ``part``: a chunk runs from behind one end up to the next."""
        count = (high - low + rest)[part]
        text = np.repeat(part, count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        own = low[text] + at
        last = at == high[text] - low[text]
        to = np.where(last, stop[text] - 1, ends[np.minimum(own, len(ends) - 1)] if len(ends) else stop[text] - 1) + 1
        start = np.concatenate([begin[text[:1]], to[:-1]])
        start[at == 0] = begin[text[at == 0]]
        value = mix((self._sum[to] - self._sum[start]) * self._inverse[start])
        out[text, at] = ALPHABET[value >> np.uint64(58)]

    def texts(self) -> list[str]:
        """The fingerprints as text."""
        parts = [[row.tobytes()[:n].decode() for row, n in zip(rows, lengths, strict=True)] for rows, lengths in ((self.first, self.lengths[0].tolist()), (self.second, self.lengths[1].tolist()))]
        return [f"{1 << k}:{a}:{b}" for k, a, b in zip(self.level.tolist(), *parts, strict=True)]


_table = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _table
    if len(_table[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        _table = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, _ROUND)))
    return _table[0][:n], _table[1]


def alike(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """1 less the edit distance of each row of ``a`` and the same row of ``b`` over the characters of both; 0 where they
    have no run of characters in common that is long enough. Bit-parallel: a word for each pair, a bit for each character
    of ``a``."""
    n = len(a)
    one = np.uint64(1)
    rest, runs = np.full(n, ~np.uint64(0)), [np.zeros(n, np.uint64) for _ in range(RUN)]
    seen = np.zeros((RUN, n), bool)
    a = np.where(np.arange(LONGEST) < a_size[:, None], a, 0)
    for j in range(int(b_size.max(initial=0))):
        same = (a == np.where(j < b_size, b[:, j], 255)[:, None]) if n else np.zeros((0, LONGEST), bool)
        hit = np.packbits(same, axis=1, bitorder="little").view("<u8")[:, 0]
        both = rest & hit
        rest = (rest + both) | (rest - both)
        for r in range(RUN - 1, -1, -1):
            runs[r] = hit & (runs[r - 1] << one) if r else hit
            seen[r] |= runs[r] != 0
    common = np.bitwise_count(~rest).astype(np.float64)
    need = np.clip((np.minimum(a_size, b_size) + 1) // 2, 1, RUN)
    return np.where(seen[need - 1, np.arange(n)], 2 * common / np.maximum(a_size + b_size, 1), 0.0)


def likeness(a: Signatures, i: np.ndarray, b: Signatures, j: np.ndarray) -> np.ndarray:
    """Likeness of text ``i`` of ``a`` and text ``j`` of ``b``, 0 to 1, 1 for equal fingerprints."""
    out = np.zeros(len(i))
    for x, y, gap in ((0, 0, 0), (1, 1, 0), (1, 0, 1), (0, 1, -1)):
        at = np.flatnonzero(b.level[j] - a.level[i] == gap)
        p, q = i[at], j[at]
        out[at] = np.maximum(out[at], alike((a.first, a.second)[x][p], a.lengths[x, p], (b.first, b.second)[y][q], b.lengths[y, q]))
    empty = (a.lengths[0, i] == 0) & (b.lengths[0, j] == 0)
    return np.where(empty, 1.0, out)


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to CHUNK_BYTES together; a longer text is alone."""
    begin, held = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and held + size > CHUNK_BYTES:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with ``fingerprint``. Null text: as empty, ``1::``. Equal texts have
    equal fingerprints, whatever rows they are in. A column of that name is replaced."""
    out = docs.drop("fingerprint")

    def work(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            found = [f for b, e in _parts([len(t) for t in texts]) for f in Signatures(texts[b:e]).texts()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "fingerprint"])

    return out.mapInArrow(work, T.StructType([*out.schema, T.StructField("fingerprint", T.StringType())]))


def edited(text: str, after: str, share: int = 4) -> str:
    """``text`` with its last floor(length / share) code points replaced by the first as many, or all, of ``after``."""
    gone = len(text) // share
    return text[: len(text) - gone] + after[:gone]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(names: list, texts: list[str], afters: list[int], n: int) -> pa.RecordBatch:
    """Rows for the first ``n`` texts; ``afters`` are the places of the documents that follow them."""
    edits = [edited(texts[i], texts[j]) for i, j in zip(range(n), afters, strict=True)]
    raw, raw_edits = [t.encode() for t in texts], [t.encode() for t in edits]
    own, new = Signatures(raw), Signatures(raw_edits)
    i = np.arange(n)
    columns = [
        pa.array(names[:n], pa.int64()),
        pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in raw_edits]),
        pa.array(own.texts()[:n]),
        pa.array(new.texts()),
        pa.array(likeness(own, i, new, i)),
        pa.array(likeness(own, i, own, np.array(afters, np.int64))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of ``docs``
    (doc_id, text; other columns are ignored): its own fingerprint, that of its text with the last quarter replaced by
    the beginning of the next document's, and the likeness of its own to that and to the next document's.

    Null text: empty. The next row is that of the next larger doc_id, nulls last; rows of one doc_id follow each other in
    the order of their texts; after the last row comes the first, for a single row itself. An empty table gives no rows.
    Rows of one doc_id are in one of ``parts`` ranges (four for each shuffle partition unless given).
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "doc_id", parts)
    ranged = ranged.withColumn("_block", F.coalesce("_block", F.lit(parts + 1)))
    # One row for each range.
    firsts = sorted(ranged.groupBy("_block").agg(F.min("doc_id")).collect())
    if not firsts:
        return spark.createDataFrame([], RESULT)
    before = [(b, firsts[k - 1][0]) for k, (b, _) in enumerate(firsts)]
    heads = spark.createDataFrame([(f, b) for (_, f), (_, b) in zip(firsts, before, strict=True)], "_first long, _before int")
    both = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_block").alias("to"), F.lit(False).alias("helper"))))
    both = both.otherwise(F.array(F.struct(F.col("_block").alias("to"), F.lit(False).alias("helper")), F.struct(F.col("_before").alias("to"), F.lit(True).alias("helper"))))
    sent = ranged.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_first")), "left").select("doc_id", "text", F.explode(both).alias("_sent"))
    sent = sent.select("doc_id", "text", F.col("_sent.to").alias("to"), F.col("_sent.helper").alias("helper"))
    placed = sent.repartition("to").sortWithinPartitions("to", "helper", F.col("doc_id").asc_nulls_last(), "text")

    def work(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "to", "helper")), strict=True)
            for b, e in _parts([len(r[1]) for r in held[:-1]]):
                # The row behind the last one of the part is there, as what follows.
                rows = held[b : e + 1]
                own = [k for k in range(len(rows) - 1) if not rows[k][3]]
                order = [*own, *(k for k in range(len(rows)) if k == len(rows) - 1 or rows[k][3])]
                place = {k: at for at, k in enumerate(order)}
                if own:
                    yield _pairs([rows[k][0] for k in order], [rows[k][1] for k in order], [place[k + 1] for k in own], len(own))
            held = held[-1:]

    return placed.mapInArrow(work, RESULT)
