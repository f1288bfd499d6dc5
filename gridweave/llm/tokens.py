"""Encoding of whole texts with a public byte-level BPE vocabulary, and exact token counts at every prefix.

A single space between two characters that are no white space always begins a new pre-token, so what lies between such
spaces ("units") encodes on its own; the ids of a text are those of its units, one after another. Workers keep what
they have met, up to a bound.

Prefix counts come from dynamic programming over prefixes. Within a pre-token, the last token of a prefix is the one
vocabulary entry that ends there and may follow the last token of the prefix before it, so each prefix's count is that
of a shorter one plus one. Across units the counts add up. They are kept as differences between neighbouring prefixes,
a signed byte for each code point, which depend on the unit alone.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.words import spans

#: White space other than single spaces between words and runs of newlines.
_ODD = re.compile(r"[^\S \n]|  | \n|\n ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK = re.compile(r"[^\S\x1c-\x1f]+")
#: Letters, digits and punctuation without apostrophes, one newline at most between them; and their pre-tokens.
_PLAIN = re.compile(r"(?: ?(?:[^\W\d_]++|[0-9]++|(?:[^\w\s']|_)++)|(?<=\S)\n(?=\S))++")
_PIECE = re.compile(r" ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s']|_)+|\n")
_ONE = re.compile(r" ?(?:[^\W\d_]+|[0-9]+|(?:[^\w\s']|_)+)")
#: Characters whose kind every reader agrees on: assigned long ago, and no numbers other than ASCII digits.
_KNOWN = re.compile("[" + "".join(f"\\U{k:08x}" for k in range(0x80, 0x10000) if (c := unicodedata.ucd_3_2_0.category(chr(k)))[0] in "LMPSZ" and c == unicodedata.category(chr(k))) + "\\x00-\\x7f]*+")
#: Bytes at which texts may be cut, and those that tell whether they are.
_BLANK_BYTE, _GAP, _MARK, _ALNUM = (np.zeros(256, bool) for _ in range(4))
_BLANK_BYTE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_GAP[[0x20, 0x0A]] = True
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
_ALNUM[[b for b in range(0x80) if chr(b).isalnum()]] = True
#: Pieces kept by an encoder; units kept by a counter of prefixes, where longer ones are not kept.
KEEP, UNITS, LONG = 300_000, 500_000, 80
#: Texts are encoded together up to this many characters, or for ids alone up to this many bytes.
TOGETHER, TOGETHER_BYTES = 1 << 19, 1 << 20
#: Bytes of the longest pre-tokens that are handled together with others: of words, and of texts without spaces.
_NARROW, _WIDE = 48, 240
#: Pre-tokens of more bytes are searched for tokens as a whole, so many bytes at a time.
_SEARCHED, _STRETCH = 240, 1 << 15
_ODD_NUMBER = np.uint64(0x9E3779B97F4A7C15)


def public_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def units(text: str) -> list[str]:
    """The units of a text, in order; joined, they are the text."""
    parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def atoms(unit: str, special: list[str]) -> list[str]:
    """Smaller pieces of a unit that encode on their own too: its pre-tokens, where it is plain enough to see them."""
    if unit and (unit.isascii() or _KNOWN.fullmatch(unit)) and _PLAIN.fullmatch(unit) and not any(x in unit for x in special):
        return _PIECE.findall(unit)
    return [unit]


def grouped(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """Units of each text (null: empty), for texts of about TOGETHER characters at a time."""
    part, size = [], 0
    for text in texts:
        part.append(units(text or ""))
        size += len(text or "")
        if size > TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def pieces(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of several texts begin and end. ``data`` holds the texts' bytes in UTF-8, a newline before, between
    and after them; ``begin`` and ``stop`` are each text's bytes.

    Pieces are cut where the vocabulary's pattern always parts pre-tokens: before a single space and before and after a
    single newline between characters that are no white space, and before ASCII punctuation other than an apostrophe
    that follows a letter or digit. Characters that may be white space for some reader part nothing.
    """
    mark = np.zeros(len(data) + 1, bool)
    mark[begin] = mark[stop] = True
    at = np.flatnonzero(_GAP[data])
    at = at[(at > 2) & (at < len(data) - 1)]
    far, two, before, after = data[at - 3], data[at - 2], data[at - 1], data[at + 1]
    # White space beyond ASCII begins with C2 (two bytes) or E1 to E3 (three).
    doubtful = (before >= 0x80) & ((two == 0xC2) | (far >= 0xE1) & (far <= 0xE3)) | (after == 0xC2) | (after >= 0xE1) & (after <= 0xE3)
    at = at[~_BLANK_BYTE[before] & ~_BLANK_BYTE[after] & ~doubtful]
    mark[at] = True
    mark[at[data[at] == 10] + 1] = True
    at = np.flatnonzero(_MARK[data])
    at = at[at > 1]
    before = data[at - 1]
    # C3 is followed by letters but for the signs of multiplication and division.
    mark[at[_ALNUM[before] | (data[at - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]] = True
    cut = np.flatnonzero(mark)
    between = np.zeros(len(data) + 1, bool)
    between[stop] = True
    start, end = cut[:-1], cut[1:]
    own = ~between[start] & (start >= begin[0])
    return start[own], end[own]


def byte_level(library) -> bool:
    """Whether a vocabulary parts texts as :func:`pieces` and :class:`PrefixCounter` take for granted: byte-level BPE
    with the usual pattern, no normalizer and no space put before a text."""
    state = json.loads(library.to_str())
    cut = state["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
    return bool(plain and state["normalizer"] is None and state["model"]["type"] == "BPE" and not state["model"].get("dropout"))


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without added special tokens.

    Texts are taken apart by :func:`pieces`; of each different piece the library is asked once as long as a worker keeps
    its ids by the piece's bytes, which it does up to a bound; beyond it those stay that were met again. New pieces that
    are plainly one pre-token go to the library's model, others through its pre-tokenizer too. Texts for a vocabulary of
    another kind go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.parted = byte_level(self.library)
        self.model = self.library.model
        self.shown = {b: c for b, c in enumerate(_byte_characters()) if b != 10}
        self._forget()

    def _forget(self) -> None:
        """Kept pieces: the number of each, where in ``pool`` the ids of each begin, how many there are, and how often the
        piece was met."""
        self.number: dict[bytes, int] = {}
        self.at, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, f"<u{self.width}")

    def _full(self) -> bool:
        return len(self.number) > KEEP or len(self.pool) > 16 * KEEP

    def _thin(self) -> None:
        """Forget pieces that were not met again, and of the others those met least beyond half the bound."""
        often = np.flatnonzero(self.met > 1)
        if len(often) > KEEP // 2:
            often = np.sort(often[np.argpartition(-self.met[often], KEEP // 2)[: KEEP // 2]])
        names, at, size, met, pool = list(self.number), self.at[often], self.size[often], self.met[often] // 2, self.pool
        self._forget()
        self.number = {names[k]: n for n, k in enumerate(often.tolist())}
        end = np.cumsum(size, dtype=np.int64)
        self.at, self.size, self.met = end - size, size, met
        self.pool = pool[np.repeat(at - self.at, size) + np.arange(int(size.sum()))]
        if self._full():
            self._forget()

    def _keep(self, new: list[bytes]) -> list[int]:
        """Keep the ids of pieces that are not kept so far; the number of each."""
        own, others = [], []
        for piece in new:
            word = piece.decode()
            (own if _ONE.fullmatch(word) and (word.isascii() or _KNOWN.fullmatch(word)) else others).append(piece)
        # Newlines are in none of these, so each byte gets its character in all of them at once.
        shown = b"\n".join(own).decode("latin-1").translate(self.shown)
        ids, size, tokenize = [], [], self.model.tokenize
        for word in shown.split("\n") if own else ():
            found = tokenize(word)
            size.append(len(found))
            ids += [t.id for t in found]
        if others:
            got = self.library.encode([piece.decode() for piece in others], is_pretokenized=True, add_special_tokens=False)
            size += np.bincount(np.array(got.word_ids, np.int64), minlength=len(others)).tolist()
            ids += got.ids
        self.number.update(zip(own + others, range(len(self.number), len(self.number) + len(new)), strict=True))
        size = np.array(size, np.int32)
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size, dtype=np.int64) - size])
        self.size, self.met = np.concatenate([self.size, size]), np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.pool = np.concatenate([self.pool, np.array(ids, self.pool.dtype)])
        return [self.number[piece] for piece in new]

    def _together(self, raw: list[bytes]) -> list[bytes]:
        """The ids of some texts without special strings."""
        joined = b"\n\n\n" + b"\n".join(raw) + b"\n\n"
        data, length = np.frombuffer(joined, np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        stop = 2 + np.cumsum(length + 1)
        begin = stop - length
        start, end = pieces(data, begin, stop)
        if not len(start):
            return [b""] * len(raw)
        back, different = spans(data, start, end)
        if self._full():
            self._thin()
        entry = np.fromiter(map(self.number.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = self._keep([different[k] for k in new.tolist()])
        self.met[entry] += 1
        size = self.size[entry][back].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.at[entry][back] - total[:-1], size) + np.arange(total[-1])]
        edge = total[np.searchsorted(start, np.append(begin, len(data)))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def _apart(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.pool.dtype).tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids (null: none) as little-endian integers of ``width`` bytes."""
        part, size, odd = [], 0, {}

        def done() -> Iterator[bytes]:
            for k, got in enumerate(self._together(part)):
                yield self._apart(odd[k]) if k in odd else got

        for text in texts:
            text = text or ""
            special = not self.parted or any(s in text for s in self.special)
            raw = b"" if special else text.encode()
            if part and size + len(raw) > TOGETHER_BYTES:
                yield from done()
                part, size, odd = [], 0, {}
            if special:
                odd[len(part)] = text
            part.append(raw)
            size += len(raw) + 1
        if part:
            yield from done()


def _byte_characters() -> list[str]:
    """The characters that stand for the 256 bytes in a byte-level vocabulary: printable Latin-1 ones for themselves,
    the others from U+0100 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


@lru_cache(maxsize=4)
def _table(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return _table(int(_ODD_NUMBER), _WIDE if n <= _WIDE else _STRETCH + _WIDE)[:n]


def _inverses(n: int) -> np.ndarray:
    return _table(pow(int(_ODD_NUMBER), -1, 1 << 64), _WIDE if n <= _WIDE else _STRETCH + _WIDE)[: n + 1]


def _prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Sums by which the hash of any part of each row is found."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * _powers(rows.shape[1]) * np.uint64(0xD6E8FEB86659FD93), axis=1, out=out[:, 1:])
    return out


#: Pre-tokens in one table of the recurrence.
_AT_ONCE = 50_000


def _small(steps: np.ndarray) -> np.ndarray:
    """Steps as signed bytes; one that does not fit is an error."""
    if len(steps) and np.abs(steps).max(initial=0) > 127:
        raise OverflowError("the count of tokens changes by more than 127 at one character")
    return steps.astype(np.int8)


class PrefixCounter:
    """Token counts of every prefix of a text, as differences between neighbouring prefixes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if not byte_level(self.library):
            raise ValueError(f"prefix counts are for byte-level BPE; {path} is of another kind")
        self.model, self.before = self.library.model, self.library.pre_tokenizer
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.vocab = set(self.library.get_vocab(with_added_tokens=False))
        self.longest = max(map(len, self.vocab))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.kept: dict[str, bytes] = {}
        # For batches: tokens that stand alone by the hash of their bytes, a sieve on it, and pairs met, by a slot.
        place = {c: b for b, c in enumerate(_byte_characters())}
        self.place = {ord(c): b for c, b in place.items()}
        self.met: dict[int, bool] = {}
        self.begun: dict[tuple[str, str], list[int]] = {}
        tokens = [t for t in self.vocab if len(t) <= _WIDE and self._is_alone(t)]
        width = np.array([len(t) for t in tokens])
        rows = np.zeros((len(tokens), int(width.max())), np.uint8)
        for k, t in enumerate(tokens):
            rows[k, : len(t)] = [place[c] for c in t]
        value = _prefix_hashes(rows)[np.arange(len(tokens)), width]
        order = np.argsort(value)
        self.values, self.tokens, self.widest = value[order], [tokens[k] for k in order], int(width.max())
        if (self.values[1:] == self.values[:-1]).any():
            raise ValueError("two tokens share a hash")
        self.spelled = rows[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.values >> np.uint64(44)).astype(np.int64)] = True
        self.slots, self.slot_ok = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)

    def _is_alone(self, token: str) -> bool:
        if (got := self.alone.get(token)) is None:
            got = self.alone[token] = token in self.vocab and len(self.model.tokenize(token)) == 1
        return got

    def _follows(self, a: str, b: str) -> bool:
        return [t.value for t in self.model.tokenize(a + b)] == [a, b]

    def _may_follow(self, a: str, b: str) -> bool:
        if (got := self.pairs.get((a, b))) is None:
            if len(self.pairs) > UNITS:
                self.pairs.clear()
            got = self.pairs[a, b] = self._follows(a, b)
        return got

    def piece(self, piece: str) -> list[int]:
        """Counts of all prefixes of a pre-token of byte characters: entry i is that of its first i + 1 bytes."""
        if len(piece) > _SEARCHED and self.longest <= _WIDE:
            return self._long_piece(piece)
        count, last, longest = [0], [""], self.longest
        for end in range(1, len(piece) + 1):
            for begin in range(max(0, end - longest), end):
                token = piece[begin:end]
                if self._is_alone(token) and (not begin or self._may_follow(last[begin], token)):
                    count.append(count[begin] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends at {end} in {piece!r}")
        return count[1:]

    def _ending(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens in some bytes, by their end: end, length and number in ``tokens``, those of three bytes first."""
        value = _prefix_hashes(data[None, :])[0]
        inverse = _inverses(len(data))
        ends, sizes, numbers = [], [], []
        for size in sorted(range(1, min(len(data), self.widest) + 1), key=lambda n: (abs(n - 3), n)):
            h = (value[size:] - value[:-size]) * inverse[: len(data) - size + 1]
            begin = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.values, h[begin]), len(self.values) - 1)
            real = self.values[k] == h[begin]
            begin, k = begin[real], k[real]
            if len(begin):
                real = (self.spelled[k, :size] == data[begin[:, None] + np.arange(size)]).all(axis=1)
                begin, k = begin[real], k[real]
            ends.append(begin + size)
            sizes.append(np.full(len(begin), size))
            numbers.append(k)
        ends, sizes, numbers = map(np.concatenate, (ends, sizes, numbers))
        order = np.argsort(ends, kind="stable")
        return ends[order], sizes[order], numbers[order]

    def _long_piece(self, piece: str) -> list[int]:
        """:meth:`piece` for many bytes: the tokens that end at each place are found for a stretch at a time, and what is
        left for each place is to look up which of a handful may follow."""
        data = np.frombuffer(piece.translate(self.place).encode("latin-1"), np.uint8)
        count, last, met, tokens = [0] * (len(data) + 1), [-1] * (len(data) + 1), self.met, self.tokens
        for begin in range(0, len(data), _STRETCH):
            back = max(0, begin - self.widest)
            ends, sizes, numbers = self._ending(data[back : begin + _STRETCH])
            own = ends + back > begin
            if len(met) > 4 * UNITS:
                met.clear()
            done = begin
            for end, size, k in zip((ends[own] + back).tolist(), sizes[own].tolist(), numbers[own].tolist(), strict=True):
                if end == done:
                    continue
                before = last[end - size]
                if end > size:
                    pair = before << 20 | k
                    ok = met.get(pair)
                    if ok is None:
                        ok = met[pair] = self._follows(tokens[before], tokens[k])
                    if not ok:
                        continue
                if end != done + 1:
                    break
                done, count[end], last[end] = end, count[end - size] + 1, k
            if done != min(len(data), begin + _STRETCH):
                raise ValueError(f"no token of the vocabulary ends at {done + 1} in {piece!r}")
        return count[1:]

    def _pairs_ok(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which tokens b may follow tokens a (numbers in ``tokens``)."""
        key = a << 20 | b
        slot = ((key.astype(np.uint64) * _ODD_NUMBER) >> np.uint64(43)).astype(np.int64)
        ok, late = self.slot_ok[slot], np.flatnonzero(self.slots[slot] != key)
        if len(late):
            new, back = np.unique(key[late], return_inverse=True)
            found = np.array([self._follows(self.tokens[k >> 20], self.tokens[k & 0xFFFFF]) for k in new.tolist()])
            ok[late] = found[back]
            self.slots[slot[late]], self.slot_ok[slot[late]] = key[late], ok[late]
        return ok

    def batch(self, pieces: list[str]) -> list[bytes]:
        """Steps of many pre-tokens (of at most _WIDE bytes) at once: the recurrence of :meth:`piece`, for each end and
        each length of the last token over all pieces together."""
        raw = [p.encode() for p in pieces]
        width = np.fromiter(map(len, raw), np.int64, len(raw))
        most = int(width.max(initial=0))
        rows = np.frombuffer(b"".join([r.ljust(most, b"\0") for r in raw]), np.uint8).reshape(len(raw), most)
        value, inverse = _prefix_hashes(rows), _inverses(most)
        count, last = np.zeros((len(raw), most + 1), np.int16), np.full((len(raw), most + 1), -1, np.int64)
        for end in range(1, most + 1):
            open_ = np.flatnonzero(width >= end)
            for size in sorted(range(1, min(end, self.widest) + 1), key=lambda n: (abs(n - 3), n)):
                if not len(open_):
                    break
                begin = end - size
                h = (value[open_, end] - value[open_, begin]) * inverse[begin]
                some = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.values, h[some]), len(self.values) - 1)
                real = (self.values[k] == h[some]) & (self.spelled[k, :size] == rows[open_[some], begin:end]).all(axis=1)
                some, k = some[real], k[real]
                if begin and len(some):
                    fit = self._pairs_ok(last[open_[some], begin], k)
                    some, k = some[fit], k[fit]
                own = open_[some]
                last[own, end], count[own, end] = k, count[own, begin] + 1
                open_ = np.delete(open_, some)
            if len(open_):
                raise ValueError(f"no token of the vocabulary ends at {end} in {pieces[int(open_[0])]!r}")
        # Of all pieces at once: the bytes at which a code point ends, and the steps from one such byte to the next.
        at = np.arange(most)
        ends = at < width[:, None]
        ends[:, :-1] &= ((rows[:, 1:] & 0xC0) != 0x80) | (at[:-1] == width[:, None] - 1)
        some = count[:, 1:][ends].astype(np.int64)
        steps, size = np.diff(some, prepend=0), ends.sum(axis=1)
        edge = np.concatenate([[0], np.cumsum(size)])
        first = edge[:-1][size > 0]
        steps[first] = some[first]
        small = _small(steps).tobytes()
        return [small[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def _plain(self, text: str) -> list[int]:
        """Counts of all prefixes, by code point, of a text without special strings."""
        out: list[int] = []
        for mapped, (begin, end) in self.before.pre_tokenize_str(text):
            own, base, at = self.piece(mapped), out[-1] if out else 0, 0
            for ch in text[begin:end]:
                at += len(ch.encode())
                out.append(base + own[at - 1])
            if mapped in ("'re", "'ve", "'ll"):  # cut after its second character, it is no contraction
                out[-2] = base + 2
        for run in _BLANK.finditer(text) if len(text) > 1 else ():
            if len(run[0]) > 1:  # cut at its end, a run of white space is one pre-token
                pieces = self.before.pre_tokenize_str(run[0])
                out[run.end() - 1] = (out[run.start() - 1] if run.start() else 0) + sum(self.piece(p)[-1] for p, _ in pieces)
        return out

    def _begun(self, head: str, special: str) -> list[int]:
        """Counts of ``head`` with the beginnings of a special string, short of the whole."""
        if (got := self.begun.get((head, special))) is None:
            got = [len(self.library.encode(head + special[:k], add_special_tokens=False).ids) for k in range(1, len(special))]
            if len(head) <= LONG and len(self.begun) < UNITS // 16:
                self.begun[head, special] = got
        return got

    def counts(self, text: str) -> list[int]:
        """Counts of all prefixes, by code point. Special strings part the text; a prefix that ends within one has its
        beginning as plain text."""
        out: list[int] = []
        at = 0
        for found in self.specials.finditer(text) if self.special else ():
            base, head = out[-1] if out else 0, text[at : found.start()]
            out += [base + n for n in self._plain(head)]
            out += [base + n for n in self._begun(head, found[0])]
            out.append((out[found.start() - 1] if found.start() else 0) + 1)
            at = found.end()
        base = out[-1] if out else 0
        return out + [base + n for n in self._plain(text[at:])]

    def _steps(self, unit: str) -> bytes:
        return _small(np.diff(np.array(self.counts(unit), np.int64), prepend=0)).tobytes()

    def steps(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text an int8 for each code point: by how much the count of the prefix that ends there differs from the one before."""
        for part in grouped(texts):
            if len(self.kept) > UNITS:
                self.kept.clear()
            kept, late = self.kept, {}
            new = {unit: atoms(unit, self.special) for unit in set().union(*part).difference(kept)}
            fresh = {a for own in new.values() for a in own if a not in kept}
            sized = {a: len(a.encode()) for a in fresh if 0 < len(a) <= _WIDE and a != "\n" and (a.isascii() or _KNOWN.fullmatch(a)) and _ONE.fullmatch(a)}
            plain = [[a for a, n in sized.items() if low < n <= high] for low, high in ((0, _NARROW), (_NARROW, _WIDE))]
            for some in plain:
                for at in range(0, len(some), _AT_ONCE):
                    own = some[at : at + _AT_ONCE]
                    for a, steps in zip(own, self.batch(own), strict=True):
                        (kept if len(a) <= LONG else late)[a] = steps
            for atom in fresh.difference(*plain):
                (kept if len(atom) <= LONG else late)[atom] = self._steps(atom)
            for unit, own in new.items():
                if len(own) > 1:
                    (kept if len(unit) <= LONG else late)[unit] = b"".join([kept[a] if a in kept else late[a] for a in own])
            for own in part:
                yield np.frombuffer(b"".join([kept[u] if u in kept else late[u] for u in own]) if late else b"".join(map(kept.__getitem__, own)), np.int8)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's own encoder, kept between tasks."""
    return Encoder(path)


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """A worker's own counter, kept between tasks."""
    return PrefixCounter(path)


def _within(steps: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    fit = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ``steps`` (zstandard of a signed byte for each code point) of each row of ``docs``
    (doc_id, text; other columns are ignored). Null text: empty. A row for each row, repeated ones too."""

    def work(batches):
        counter, pack = prefix_counter(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            steps = list(counter.steps(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([int(s.sum(dtype=np.int64)) for s in steps], pa.int64()), pa.array([pack.compress(s.tobytes()) for s in steps], pa.binary())],
                ["doc_id", "n_tokens", "steps"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, steps binary")


def tokens_at(steps: Column, n_chars: Column) -> Column:
    """Exact token count of the first ``n_chars`` code points, from a prefix table."""

    @F.pandas_udf("long")
    def at(steps, n):
        import pandas as pd

        unpack = zstandard.ZstdDecompressor()
        return pd.Series([int(np.frombuffer(unpack.decompress(s), np.int8)[: max(0, int(k))].sum(dtype=np.int64)) for s, k in zip(steps, n, strict=True)])

    return at(steps, n_chars)


def chars_within(steps: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from a prefix table."""

    @F.pandas_udf("long")
    def within(steps, budget):
        import pandas as pd

        unpack = zstandard.ZstdDecompressor()
        return pd.Series([_within(np.frombuffer(unpack.decompress(s), np.int8), int(b)) for s, b in zip(steps, budget, strict=True)])

    return within(steps, budget)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit``) and limit_chars (code points of the longest prefix
    within the limit) of each row of ``docs`` (doc_id, text; other columns are ignored), all from prefix counts.

    Null text: empty, no tokens. A row for each row, repeated ones too. Nothing is shuffled; a worker holds one batch
    and a bounded number of units.
    """

    def work(batches):
        counter = prefix_counter(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            total, chars = [], []
            for steps in counter.steps(texts):
                total.append(n := int(steps.sum(dtype=np.int64)))
                chars.append(len(steps) if n <= limit else _within(steps, limit))
            total = pa.array(total, pa.int64())
            over = pa.array([n > limit for n in total.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], total, over, pa.array(chars, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")
