"""Word positions and hashes of many texts at once, with numpy and Arrow over their UTF-8 bytes.

A word is a longest run of characters other than space and ``\\x09-\\x0D``. Within a chunk words are told apart by their
bytes. Hashes that are compared between chunks are one-to-one for words of at most seven bytes and 64 bits of BLAKE2b for
longer ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Texts are handled together up to this many bytes; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each ``data[start:end]``, equal where the bytes are and only there, and the bytes of each number.
    The spans are not empty, in order, and do not overlap."""
    size = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=size[1:])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] = 1
    edge[end] -= 1
    inside = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(size), pa.py_buffer(inside)]).dictionary_encode()
    if not len(found):
        return np.zeros(0, np.int32), []
    _, cut, raw = found.dictionary.buffers()
    cut, raw = np.frombuffer(cut, np.int32)[: len(found.dictionary) + 1].tolist(), raw.to_pybytes()
    return found.indices.to_numpy(), [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def hashes(values: list[bytes]) -> np.ndarray:
    """64 bits of BLAKE2b of each value."""
    return np.frombuffer(b"".join([blake2b(v, digest_size=8).digest() for v in values]), "<u8").astype(np.uint64)


_SHORT = 7
_LOW = (np.uint64(1) << (np.uint64(8) * np.arange(_SHORT + 1, dtype=np.uint64))) - np.uint64(1)
_LONG = np.uint64(0xFF << 56)


class Chunk:
    """Words of several texts. ``data`` holds the texts' bytes, a newline after each.

    ``doc`` gives each word's text; ``start`` and ``end`` its bytes; ``id`` a number that equal words of the chunk have
    in common; ``hash`` a value that equal words have in common anywhere; ``first[i]`` the first word of text i and
    ``first[i + 1]`` the end of its words; ``begin[i]`` the first byte of text i. With ``bare``, ASCII punctuation parts
    words as white space does.
    """

    def __init__(self, texts: list[str], bare: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        whole = b"\n".join(raw) + b"\n" + bytes(8)
        self.data = np.frombuffer(whole, np.uint8)[:-8]
        gap = np.concatenate([[True], (SPACE | PUNCTUATION if bare else SPACE)[self.data]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        size = self.end - self.start
        eight = np.ndarray((len(self.data),), "<u8", whole, strides=(1,))
        self.id = eight[self.start] & _LOW[np.minimum(size, _SHORT)] | size.astype(np.uint64) << np.uint64(56)
        self.hash = mix(self.id)
        long = np.flatnonzero(size > _SHORT)
        number, different = spans(self.data, self.start[long], self.end[long])
        self.id[long] = _LONG | number.astype(np.uint64)
        self.hash[long] = hashes(different)[number]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows that lie in one text, and the index of each one's first word."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            value = mix(value * np.uint64(_BASE) + self.hash[at + k] + np.uint64(k + 1))
        return value, at


def chunks(texts: Iterable[str | None], bare: bool = False) -> Iterator[tuple[int, Chunk]]:
    """Chunks over the texts (null: empty) in order, with the place of each chunk's first text."""
    begin, size, part = 0, 0, []
    for text in texts:
        text = text or ""
        if part and size + len(text) > CHUNK_BYTES:
            yield begin, Chunk(part, bare)
            begin, size, part = begin + len(part), 0, []
        part.append(text)
        size += len(text) + 1
    if part:
        yield begin, Chunk(part, bare)
