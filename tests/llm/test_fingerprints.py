"""Fingerprints against a plain version that goes byte by byte."""

import hashlib
import random

import numpy as np
import pytest

from gridweave.llm import fingerprints as P
from gridweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def signature(data, k):
    out, value, power = "", 0, 1
    for at, byte in enumerate(data):
        value, power = (value + (byte + 1) * power) & MASK, power * 0x100000001B3 & MASK
        window = int.from_bytes(data[max(0, at - 6) : at + 1].rjust(7, b"\0"), "little")
        if mix(window ^ 0x9E3779B97F4A7C15) % (1 << k) == 0 or at == len(data) - 1:
            out += chr(P.ALPHABET[mix(value) >> 58])
            value, power = 0, 1
    return out


def fingerprint(text):
    data, k = text.encode(), 0
    while len(first := signature(data, k)) > 64:
        k += 1
    return f"{1 << k}:{first}:{signature(data, k + 1)}"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else 2))
    return row[-1]


def alike(a, b):
    need = min(4, max(1, (min(len(a), len(b)) + 1) // 2))
    if not any(a[i : i + need] in b for i in range(len(a) - need + 1)):
        return 0.0
    return 1 - distance(a, b) / (len(a) + len(b))


def likeness(x, y):
    if x == y:
        return 1.0
    (k, *a), (m, *b) = x.split(":"), y.split(":")
    sizes = lambda k, parts: {int(k): parts[0], 2 * int(k): parts[1]}
    a, b = sizes(k, a), sizes(m, b)
    return max([alike(a[s], b[s]) for s in a.keys() & b.keys()], default=0.0)


def plain(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        gone = len(t) // 4
        new = t[: len(t) - gone] + after[:gone]
        own = fingerprint(t)
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), own, fingerprint(new), likeness(own, fingerprint(new)), likeness(own, fingerprint(after))))
    return out


def rounded(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def odd_texts():
    rng = random.Random(5)
    words = ["a", "of", "règle", "数据", "\U0001f600", "\0", "token", "\n", "\t"]
    texts = ["", None, "a", "ab", "abcd", "a" * 3000, "ab" * 2000, "\0" * 300, "x" * 64, "x" * 65]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 300, 1500]))) for _ in range(30)]
    return texts


def test_texts_against_plain(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(3, "b"), (3, "ab"), (None, "none"), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, "f") for d, t in rows], "doc_id long, text string, to int, fingerprint string").repartition(5)
    got = P.edited_fingerprints(docs, parts=6)
    assert rounded(map(tuple, got.collect())) == rounded(plain(rows))
    assert rounded(map(tuple, P.edited_fingerprints(docs, parts=1).collect())) == rounded(plain(rows))
    kept = P.fingerprints(docs)
    assert kept.columns == ["doc_id", "text", "to", "fingerprint"]
    assert all(r["fingerprint"] == fingerprint(r["text"] or "") for r in kept.collect())


@pytest.mark.parametrize("rows", [[], [(1, "one text")], [(None, None)], [(1, None), (2, "")], [(7, "same text"), (7, "same text")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rounded(map(tuple, P.edited_fingerprints(docs).collect())) == rounded(plain(rows))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_fingerprints"](spark, SF)
    assert rounded(map(tuple, got.collect())) == rounded(plain(rows))


def test_edits_stay_alike():
    """An edit in the middle of a long text changes what stands around it only; other texts are not alike."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    words = [word() for _ in range(3000)]
    texts = [" ".join(words), " ".join(words[:1500] + [word() for _ in range(40)] + words[1500:]), " ".join(rng.sample(words, len(words)))]
    found = P.Signatures([t.encode() for t in texts])
    near, far = P.likeness(found, np.array([0, 0]), found, np.array([1, 2]))
    assert near > 0.9 and far < 0.3


def test_one_text_longer_than_a_chunk():
    text = "".join(random.Random(2).choice("abc ") for _ in range(20_000)).encode()
    whole = P.Signatures([b"short", text, b""])
    assert whole.texts() == [fingerprint("short"), fingerprint(text.decode()), "1::"]
