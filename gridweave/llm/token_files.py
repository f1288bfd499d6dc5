"""Token ids in compressed shards, each document readable on its own.

A folder holds ``dictionary`` (sha256, content: one zstandard dictionary trained on serialized id arrays) and
``shards``, binary blobs kept as Parquet rows so that any store Spark can write will do. A shard is

    magic "IDS1", id width (uint8), SHA-256 of the dictionary (32 bytes), documents n (uint32),
    doc_ids (n int64), named (n uint8: 0 where doc_id is null),
    byte offsets of the frames (n + 1 uint64), token offsets (n + 1 uint64), frames

all little-endian. Each frame is one document's ids, compressed apart with the shared dictionary. Shards are in
ascending order of (part, number), documents in ascending doc_id order, nulls first.

Scale: one shuffle by ranges of doc_id. Token offsets of parts come from one row per part; offsets within a part are
counted as it is written.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.shared import shared_dir, values
from gridweave.llm.tokens import encoder

MAGIC = b"IDS1"
_HEAD = struct.Struct("<4sB32sI")
#: A shard is closed at so many bytes of ids or so many documents.
SHARD_BYTES, SHARD_DOCS = 1 << 22, 4096


def train_dictionary(docs: DataFrame, path: str, sample: int = 2000, longest: int = 8192, size: int = 1 << 16) -> bytes:
    """A zstandard dictionary from the id arrays of at most ``sample`` whole documents: those of up to ``longest``
    characters whose hash is smallest. It changes the size of files only. Where there are too few for the trainer, the
    arrays themselves are the dictionary's content; without any document there is none (b"")."""
    chosen = F.xxhash64("doc_id", "text")
    short = docs.select("doc_id", "text", chosen.alias("_order")).where(F.char_length("text").between(1, longest))
    order = [r[0] for r in short.select("_order").distinct().orderBy("_order").limit(sample).collect()]
    if not order:
        return b""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(encoder(path).encode(values(batch["text"]))), pa.binary())], ["ids"])

    picked = short.where(F.col("_order") <= order[-1]).dropDuplicates(["_order"])
    samples = sorted(bytes(r[0]) for r in picked.select("text").mapInArrow(work, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_shard(ids: list[bytes], doc_ids: list[int | None], width: int, dictionary: bytes, pack: zstandard.ZstdCompressor) -> bytes:
    """One shard of the documents whose serialized ids are given."""
    frames = [pack.compress(x) for x in ids]
    return b"".join([
        _HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest(), len(ids)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], "<u1").tobytes(),
        np.cumsum([0, *map(len, frames)], dtype="<u8").tobytes(),
        np.cumsum([0, *[len(x) // width for x in ids]], dtype="<u8").tobytes(),
        *frames,
    ])


class Shard:
    """A shard's index; ``ids(k)`` reads one document without the others."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, self.width, digest, n = _HEAD.unpack_from(blob)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard, or one of another dictionary")
        at = _HEAD.size
        doc_ids, at = np.frombuffer(blob, "<i8", n, at), at + 8 * n
        named, at = np.frombuffer(blob, "<u1", n, at), at + n
        self.doc_ids = [int(d) if ok else None for d, ok in zip(doc_ids, named, strict=True)]
        self.bytes, at = np.frombuffer(blob, "<u8", n + 1, at), at + 8 * (n + 1)
        self.starts, at = np.frombuffer(blob, "<u8", n + 1, at), at + 8 * (n + 1)
        self.blob, self.body = blob, at
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        frame = self.blob[self.body + int(self.bytes[k]) : self.body + int(self.bytes[k + 1])]
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.width}")


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int | None = 2) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) with the vocabulary at ``path`` and write them to the
    folder ``out``. Null text: empty. ``end_id`` ends each document. Rows of one doc_id follow each other in the order
    of a hash of their texts, so that very many of them are spread over tasks. Each document is held whole; a task holds one shard."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path)
    # As literals: rows of a Python list would start a second daemon with workers of its own on each executor.
    spark.range(1).select(F.lit(hashlib.sha256(dictionary).hexdigest()).alias("sha256"), F.lit(dictionary).alias("content")).write.mode("overwrite").parquet(f"{out}/dictionary")

    def work(batches):
        coder, pack, part = encoder(path), _packer(dictionary), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], f"<u{coder.width}").tobytes()
        ids, names, size, number, before = [], [], 0, 0, 0

        def closed():
            tokens = sum(map(len, ids)) // coder.width
            row = [part, number, before, len(ids), tokens, names[0], names[-1], write_shard(ids, names, coder.width, dictionary, pack)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(),) * 7 + (pa.binary(),), strict=True)], names=["part", "number", "before", "n_docs", "n_tokens", "first_id", "last_id", "shard"]), tokens

        for batch in batches:
            for name, got in zip(values(batch["doc_id"]), coder.encode(values(batch["text"])), strict=True):
                ids.append(got + end)
                names.append(name)
                size += len(got)
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    row, tokens = closed()
                    yield row
                    ids, names, size, number, before = [], [], 0, number + 1, before + tokens
        if ids:
            yield closed()[0]

    ordered = docs.select("doc_id", "text").withColumn("_order", F.xxhash64("text")).repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order", "text").select("doc_id", "text")
    shards = ordered.mapInArrow(work, "part long, number long, before long, n_docs long, n_tokens long, first_id long, last_id long, shard binary")
    shards.write.mode("overwrite").option("compression", "uncompressed").parquet(f"{out}/shards")


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first()["content"])


def read_tokens(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """Each document of a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian uint32) and, with ``keep_ids``, ids."""
    dictionary = _dictionary(spark, folder)
    shards = spark.read.parquet(f"{folder}/shards")
    # One row per part, and so no more than the tasks that wrote them.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    offsets = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("offset"))

    def work(batches):
        for batch in batches:
            for offset, before, blob in zip(*(batch[c].to_pylist() for c in ("offset", "before", "shard")), strict=True):
                shard = Shard(blob, dictionary)
                ids = [shard.ids(k) for k in range(len(shard.doc_ids))]
                columns = [
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array(shard.starts[:-1].astype(np.int64) + (offset + before)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    *[pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] * keep_ids,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = shards.select("part", "before", "shard").join(F.broadcast(offsets), "part").select("offset", "before", "shard")
    return rows.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def lookup_tokens(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the documents named. Only shards whose range holds one of them are read, and of those only
    their own frames are decompressed."""
    dictionary, wanted = _dictionary(spark, folder), set(doc_ids)
    near = None
    for d in sorted(wanted):
        here = (F.col("first_id") <= d) & (F.col("last_id") >= d)
        near = here if near is None else near | here
    shards = spark.read.parquet(f"{folder}/shards").where(F.lit(False) if near is None else near | F.col("first_id").isNull())

    def work(batches):
        for batch in batches:
            for blob in batch["shard"].to_pylist():
                shard = Shard(blob, dictionary)
                own = [k for k, d in enumerate(shard.doc_ids) if d in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[k] for k in own], pa.int64()), pa.array([shard.ids(k).astype(np.int32) for k in own], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return shards.select("shard").mapInArrow(work, "doc_id long, ids array<int>")


def token_files(docs: DataFrame, path: str, end_id: int | None = 2) -> DataFrame:
    """``docs`` written to files in the shared folder and read back, without the ids themselves."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(docs, folder, path, end_id)
    return read_tokens(spark, folder, keep_ids=False)
