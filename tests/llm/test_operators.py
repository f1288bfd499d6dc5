"""Each operator against a brute-force version, and on nulls, empty and very long texts, repeated rows, empty tables and
columns whose names clash with its own."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import decontamination, html_text, mixing, ngram_join, quality_rules, token_files, tokens, toxicity, warc
from gridweave.llm.components import connected_components
from gridweave.llm.line_dedup import line_dedup
from gridweave.llm.shared import stored

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_dropped string, score string, tokens string, size string"
PATH = tokens.public_path("byte_bpe_50k.json")


def made(seed=1, n=60):
    """Documents with shared lines, exact and near copies, odd white space, a very long one, nulls and empty ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [line(12) for _ in range(4)]
    texts = []
    for k in range(n):
        own = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))] + [s for s in shared if rng.random() < 0.2]
        if k % 7 == 0:
            own.append("\t" + shared[0].upper() + " \r")
        rng.shuffle(own)
        texts.append("\n".join(own))
    for k in range(0, n, 9):
        words = texts[k].split(" ")
        texts.append(texts[k])
        texts.append(" ".join(w if j != len(words) // 2 else "zzz" for j, w in enumerate(words)))
    texts += [None, "", " \n\t ", "a", "one two", "x" * 70_000 + " " + line(3000), "déjà  vu\n\n  naïve 日本語 <|endoftext|> don't\xa0stop", "…"]
    return list(enumerate(texts))


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "d", "s", "t", "z") for i, t in data], DOCS)


@pytest.fixture(scope="module")
def data():
    return made()


@pytest.fixture(scope="module")
def docs(spark, data):
    return frame(spark, data).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_line_dedup(docs, data, empty):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(SPACE))
    for least in (2, 3):
        holders = collections.defaultdict(set)
        for i, t in data:
            for s in (t or "").split("\n"):
                if len(key(s)) >= 10:
                    holders[key(s)].add(i)
        want = {}
        for i, t in data:
            lines = (t or "").split("\n")
            kept = [s for s in lines if not (len(holders.get(key(s), ())) >= least and i != min(holders[key(s)]))]
            want[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs, least).collect()}
        assert got == want
    assert line_dedup(empty).count() == 0


def test_line_dedup_keys_that_collide_in_xxhash64(spark):
    """Two different lines with the same two values of a 64-bit hash under two seeds are different lines."""
    x = "x" * 24
    lines = ["]>.c$#$\"" + x + "y}w/pw{/" + x, "k<q$~=sz" + x + ")!,8>$9v" + x]
    seeds = spark.createDataFrame([(v,) for v in lines], "v string").select(F.xxhash64(F.lit(1), "v"), F.xxhash64(F.lit(2), "v"))
    assert seeds.distinct().count() == 1
    docs = spark.createDataFrame([(1, lines[0]), (2, lines[1]), (3, lines[1])], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup(docs).collect()}
    assert got == {1: (lines[0], 0), 2: (lines[1], 0), 3: ("", 1)}


def test_line_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a shared long line\nx"), (1, "a shared long line\nx"), (None, "A SHARED long line \ny"), (None, "another line of null\n"), (None, "another line of null")]
    got = sorted((r.doc_id is None, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, "a shared long line\nx")] * 2 + [(True, "another line of null"), (True, "another line of null\n"), (True, "y")]


def test_warc(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 50_000, "<p>é</p>"]
    pages = spark.createDataFrame([(10 + k, f"http://e.com/{k}\r\nEvil: 1" if k else None, h, "clash") for k, h in enumerate(html)] + [(None, "u", "x" * 50_000, "clash")], "page_id long, url string, html string, sha256 string")
    for least in (0, 100):
        got = {r.page_id: r for r in warc.archived(pages, least).collect()}
        first = {}
        for k, h in enumerate(html):
            body = (h or "").encode()
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            again = body in first and len(body) >= least
            first.setdefault(body, 10 + k)
            r = got[10 + k]
            assert (r.record_type, r.refers_to, r.payload_digest, bytes(r.payload)) == (("revisit", first[body]) if again else ("response", None)) + (digest, body)
            assert bytes(r.record) == bytes(r.header) + (b"" if again else body) + b"\r\n\r\n"
            assert b"\r\nEvil" not in bytes(r.header)
        assert got[None].record_type == "revisit" and got[None].refers_to == 14
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_query_over_a_whole_table(spark):
    from gridweave.llm.queries import op3_warc, table

    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "html").collect()
    holder = {}
    for r in pages:
        holder[r.html or ""] = min(r.page_id, holder.get(r.html or "", r.page_id))
    want = set()
    for r in pages:
        body, first = (r.html or "").encode(), holder[r.html or ""]
        want.add((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if r.page_id == first else "revisit", None if r.page_id == first else first))
    got = [tuple(r) for r in op3_warc(spark, "/root/testdata/sf0.1").collect()]
    assert set(got) == want and len(got) == len(pages)


@pytest.mark.parametrize("part", ["payload", "header"])
def test_damaged_archives_fail(spark, tmp_path, part):
    """Also for the columns of the query alone."""
    pages = spark.createDataFrame([(1, "u", "one page"), (2, "u", "one page"), (2, "v", "one page"), (3, "w", "another page")], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/sound")
    sound = warc.read_archive(spark, f"{tmp_path}/sound").collect()
    assert len({bytes(r.record) for r in sound}) == 4 and [r.refers_to for r in sound if r.page_id == 2] == [1, 1]
    for name in ("payloads", "headers"):
        rows = spark.read.parquet(f"{tmp_path}/sound/{name}")
        if part == "payload" and name == "payloads":
            rows = rows.withColumn("payload", F.when(F.decode("payload", "UTF-8") == "one page", F.lit(b"one pagf")).otherwise(F.col("payload")))
        if part == "header" and name == "headers":
            rows = rows.withColumn("header", F.encode(F.replace(F.decode("header", "UTF-8"), F.lit("Content-Length: 12"), F.lit("Content-Length: 13")), "UTF-8"))
        rows.write.parquet(f"{tmp_path}/damaged/{name}")
    with pytest.raises(Exception, match="is not that of|does not state"):
        warc.read_archive(spark, f"{tmp_path}/damaged").select("page_id", F.octet_length("payload"), "payload_digest", "record_type", "refers_to").collect()


def test_prefix_counts_and_encoding(data):
    from tokenizers import Tokenizer

    library, counter, coder = Tokenizer.from_file(PATH), tokens.PrefixCounter(PATH), tokens.Encoder(PATH)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", " \n", "'s", "'re", "'ll", "'", "é", "日本", "1", "23", "!", "..", "\t", "\xa0", "😀", "<|endoftext|>", "<|end", "ing", "don't", "\r\n", ",", "x.\nY", "\n\n", "\x1c", "²", "ⅷ", "слово", "Ωμέγα", "한국어", "ไทย", "हिन्दी", "漢字かな交じり文", "עברית", "١٢", "。", "\u0378", "\u0301", "𐐷"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [t for _, t in data if t is not None and len(t) < 800][:20]
    for text, ids, steps in zip(texts, coder.encode(texts), counter.steps(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
        assert np.cumsum(steps, dtype=int).tolist() == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


def test_encoding_keeps_pieces_met_again(monkeypatch):
    """Beyond the bound of kept pieces those met again stay; ids are the library's throughout."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KEEP", 100)
    coder, library, asked, most = tokens.Encoder(PATH), Tokenizer.from_file(PATH), collections.Counter(), 0
    keep = coder._keep
    monkeypatch.setattr(coder, "_keep", lambda new: asked.update(new) or keep(new))
    rng = random.Random(5)
    for _ in range(60):
        text = "met again, isn't it? déjà  vu " + " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(40))
        (ids,) = coder.encode([text])
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
        most = max(most, len(coder.number))
    assert asked[b" again"] == asked[" déjà  vu".encode()] == 1 and len(asked) > 2000 and most < 200
    # More pieces met again than the bound has room for, and one with more ids than all kept ones may have.
    many = [" ".join(f"{chr(97 + k)}{chr(97 + j)}x" for j in range(26)) for k in range(12)] * 3 + ["ab" * 20_000, *made()[0][1].split("\n")]
    for text, ids in zip(many, [x for t in many for x in coder.encode([t])], strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_plain_pieces_go_to_the_model():
    """What is plainly one pre-token passes by the library's pre-tokenizer, which takes most of its time."""
    from tokenizers import Tokenizer

    coder, library, sent = tokens.Encoder(PATH), Tokenizer.from_file(PATH), []

    class Library:
        def encode(self, some, **how):
            sent.extend(some)
            return library.encode(some, **how)

    coder.library = Library()
    text = "Plain words, 42 of them; déjà vu (слово) 漢字! But isn't  this\n\n²?"
    (ids,) = coder.encode([text])
    assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sent and not {"Plain", " words", ",", " 42", " déjà"}.intersection(sent)


def test_prefix_counts_of_long_words():
    """Words far beyond those handled together, with and without special strings, against the library at many prefixes."""
    from tokenizers import Tokenizer

    library, counter, rng = Tokenizer.from_file(PATH), tokens.PrefixCounter(PATH), random.Random(4)
    drawn = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base64_letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    chinese, kana = "".join(map(chr, range(0x4E00, 0x9FA5))), "".join(map(chr, range(0x3041, 0x3096)))
    texts = [drawn(letters, n) for letters in ("acgt", base64_letters, chinese, kana, "a", "=-", "é", "ab1") for n in (33, 300, 2000)]
    texts += [drawn("acgt", tokens._STRETCH - 2) + drawn(base64_letters, 300), "don't" * 100 + drawn(kana, 400) + "'re"]
    texts += ["ab<|endoftext|>" * 40 + drawn("acgt", 300) + "<|endoftext|><|endof" + drawn(chinese, 100), "<|endoftext|>" * 50]
    for text, steps in zip(texts, counter.steps(texts), strict=True):
        places = range(1, len(text) + 1) if len(text) < 400 else sorted({*rng.sample(range(1, len(text)), 60), len(text)})
        count = np.cumsum(steps, dtype=int)
        assert len(steps) == len(text)
        assert [count[k - 1] for k in places] == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in places]


def test_many_special_strings():
    text = "<|endoftext|>" * 100_000
    (steps,) = tokens.PrefixCounter(PATH).steps([text])
    assert steps.sum(dtype=int) == 100_000


def test_token_counts(docs, data, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in tokens.token_counts(docs, PATH, 50).collect()}
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for i, t in data:
        n = size(t or "")
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50)
        if n > 50 and len(t) < 5000:
            k = got[i].limit_chars
            assert size(t[:k]) <= 50 and all(size(t[:j]) > 50 for j in range(k + 1, len(t) + 1))
    table = tokens.prefix_table(docs, PATH)
    at = {r[0]: r[1:] for r in table.select("doc_id", tokens.tokens_at(F.col("steps"), F.lit(7)), tokens.chars_within(F.col("steps"), F.lit(3))).collect()}
    assert all(at[i][0] == size((t or "")[:7]) for i, t in data)
    assert tokens.token_counts(empty, PATH).count() == 0


def test_token_files(spark, docs, data, empty, tmp_path):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in token_files.token_files(docs, PATH).collect()}
    for i, t in data:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(empty, PATH).count() == 0
    folder = f"file://{tmp_path}/ids"
    token_files.write_tokens(docs.unionByName(frame(spark, [(None, "no name"), (3, "again")])), folder, PATH)
    found = {r.doc_id: r.ids for r in token_files.lookup_tokens(spark, folder, [5, 7]).collect()}
    assert set(found) == {5, 7} and found[5] == library.encode(dict(data)[5], add_special_tokens=False).ids + [2]
    everything = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert everything[0].doc_id is None and [r.doc_id for r in everything].count(3) == 2


def test_shards_and_dictionaries_of_few_documents(spark, monkeypatch, tmp_path):
    """Several shards in a part, ids of one doc_id in several parts, short documents."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    monkeypatch.setattr(token_files, "SHARD_DOCS", 3)
    rows = [(k, f"short {k}") for k in range(20)] + [(7, f"again {k}") for k in range(20)]
    folder = f"file://{tmp_path}/ids"
    token_files.write_tokens(frame(spark, rows), folder, PATH)
    shards = spark.read.parquet(f"{folder}/shards")
    assert shards.agg(F.max("number")).first()[0] > 0 and shards.agg(F.max("n_docs")).first()[0] <= 3
    assert len(spark.read.parquet(f"{folder}/dictionary").first().content) > 0
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((d, (*library.encode(t, add_special_tokens=False).ids, 2)) for d, t in rows)


def test_quality_rules(docs, data, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in data:
        w = split_words(t)
        lines = [s for s in (t or "").split("\n") if split_words(s)]
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        raw, upper, lower = (t or "").encode(), sum("A" <= c <= "Z" for c in t or ""), sum("a" <= c <= "z" for c in t or "")
        rules = [
            100 * r.n_symbols > 10 * len(w), r.n_dup_lines > 3 and 2 * r.n_dup_lines > len(lines), not 2 * len(w) <= r.word_chars <= 15 * len(w), 10 * sum(a == b for a, b in zip(w, w[1:])) > 3 * len(w),
            10 * upper > 3 * (upper + lower), len(w) > 0 and 10 * max(collections.Counter(w).values()) > 3 * len(w), len(raw) + 1 >= 400 and 8 * len(zlib.compress(raw + b"\n", 1)) < len(raw) + 1,
        ]
        assert r.kept == (not r.base_failed and not any(rules)), i
        assert r.kept == (r.rejected_by is None)
    assert quality_rules.quality_rules(empty).count() == 0
    backwards = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, quality_rules.RULES[::-1]).collect()}
    assert backwards == {i: r.kept for i, r in got.items()}


def jaccard_truth(data, n=5):
    sets = {}
    for i, t in data:
        w = split_words((t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else None
    links, parent = collections.Counter(), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i, s in sets.items() if s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in sets}


def test_ngram_join(docs, data, empty):
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()}
    assert got == jaccard_truth(data)
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_in_blocks(spark, monkeypatch):
    """A group of near copies far larger than a block, beside one of exact copies; repeated rows and null ids."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(80)]
    data = []
    for k in range(45):
        words = list(base)
        for _ in range(k % 3):
            words[rng.randrange(80)] = f"e{k}"
        data.append((k, " ".join(words)))
    data += [(100 + k, "the same words in every one of these texts") for k in range(20)]
    frame_ = spark.createDataFrame([*data, data[3], (None, data[0][1])], "doc_id long, text string")
    got = [(r.doc_id, (r.class_id, r.n_links)) for r in ngram_join.ngram_join(frame_).collect()]
    assert sorted(got) == sorted([*jaccard_truth(data).items(), (3, jaccard_truth(data)[3])])


def test_near_duplicates_of_rows_with_one_doc_id(spark):
    """A doc_id's texts are compared apart; each class keeps one row, whatever shares its doc_id."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (4, c), (4, c), (5, None), (5, ""), (6, " "), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, k1 string, class_key long")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0), (4, 4, 0), (5, 5, 0), (5, 5, 0), (6, 6, 0)]
    kept = ngram_join.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "").strip()) for r in kept.collect())) == sorted([(False, 1, a), (False, 1, b), (False, 4, c), (False, 5, ""), (False, 6, ""), (True, 0, a), (True, 0, a)])
    assert ngram_join.without_near_duplicates(docs.limit(0)).count() == 0


def test_ngram_join_of_a_whole_table(spark):
    from gridweave.llm.queries import op8_ngram_join, table

    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in op8_ngram_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == jaccard_truth(docs)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_behind_open_elements():
    """What is dropped ends where it must, and tags of any length are tags."""
    cases = {
        "<head><title>x</title><meta a><body><article>shown": ["shown"],
        "<head><link a><p>shown": ["shown"],
        "<div><svg width=1/>shown</div><svg><path d=''/></svg>after": ["shown", "after"],
        "<div><svg><title>t</title><g></div>shown": ["shown"],
        "<div><svg><g><p>shown</div>": ["shown"],
        "<div><button>gone</div><p>shown": ["shown"],
        "<div><option>gone</div>shown": ["shown"],
        "<div><select><option>gone<option>gone</select>shown": ["shown"],
        "<div><button><div>gone</div>gone</button>shown": ["shown"],
        f"<img src=data:{'x' * 20_000} alt='a>b'>shown": ["shown"],
        '<a "open>shown</a> after': ["shown after"],
        "a < b <script>gone<p></script>shown<script>gone": ["a < b shown"],
    }
    for page, want in cases.items():
        assert [b.text for b in html_text.blocks(page)] == want, page
    start = time.process_time()
    for part in ('<a ">" ', '<a "', "<svg>", "<div><svg>", "</script ", "<option>"):
        html_text.blocks("<p>" + part * 30_000 + "'")
    assert time.process_time() - start < 20


def plain_alignment(item, text):
    best, row = 0, [0] * (len(text) + 1)
    for w in item:
        now = [0]
        for j, v in enumerate(text, 1):
            now.append(max(0, row[j - 1] + (2 if v == w else -1), row[j] - 1, now[j - 1] - 1))
        row = now
        best = max(best, *row)
    return best / (2 * len(item))


def bare(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", (text or "").lower()).split()


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_decontamination(spark, docs, data, empty, block):
    rng = random.Random(8)
    vocabulary = [f"b{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40)))) for k in range(6)] + [(6, None), (7, "too short"), (0, None)]
    clean = [(i, t) for i, t in data]
    planted = []
    for k in range(6):
        words = items[k][1].split()
        edited = [w if rng.random() > 0.12 else "new" for w in words]
        for body in (words, edited, words[: len(words) // 3], [w.upper() + "," for w in words], words[::-1]):
            planted.append((1000 + len(planted), "some text before it " + " ".join(body) + " and after"))
    frame_ = frame(spark, clean + planted)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items + items[:1]], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(frame_, benchmark, block_words=block).collect()}
    for i, t in clean + planted:
        for k, x in items[:6]:
            score = plain_alignment(bare(x), bare(t)) if len(t or "") < 5000 else 0
            grams = {tuple(bare(x)[j : j + 4]) for j in range(len(bare(x)) - 3)} & {tuple(bare(t)[j : j + 4]) for j in range(len(bare(t)) - 3)}
            if score >= 0.5 and grams:
                assert got.pop((i, k)) == pytest.approx(score)
    assert not got
    kept = {r.doc_id for r in decontamination.without_contaminated(frame_, benchmark, block_words=block).collect()}
    found = {r.doc_id for r in decontamination.contaminated(frame_, benchmark, block_words=block).collect()}
    assert kept == {i for i, _ in clean + planted} - found
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("stem", [0, 9])
def test_decontamination_of_edited_copies(spark, stem):
    """Held against alignment of every pair; with ``stem``, 40 items begin with the same words, as do 60 documents."""
    rng = random.Random(9)
    vocabulary = [f"e{k}" for k in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(stem)]
    items = [(k, shared + [rng.choice(vocabulary) for _ in range(rng.randint(6, 16))]) for k in range(40)]
    texts = [shared + [rng.choice(vocabulary) for _ in range(20)] for _ in range(60)]
    for _, words in items[:8]:
        texts.append([w if j % 4 < 3 else "new" for j, w in enumerate(words)])
        texts.append([x for j, w in enumerate(words) for x in ([w, "new"] if j % 3 == 2 else [w])])
        texts.append([x for w in words for x in (w, "new")])
        texts.append([w for j, w in enumerate(words) if j % 4 < 3])
        texts.append(words[: len(words) // 2 + 2] + [w if j % 3 < 2 else "new" for j, w in enumerate(words[len(words) // 2 + 2 :])])
    texts.append([w for t in texts for w in t] * 2)
    docs = frame(spark, [(k, "before " + " ".join(t) + " after") for k, t in enumerate(texts)])
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, benchmark).collect()}
    want = {(d, k): plain_alignment(w, t) for d, t in enumerate(texts) for k, w in items}
    want = {k: v for k, v in want.items() if v >= 0.5}
    assert got == pytest.approx(want) and len(want) > 40


def test_toxicity(spark, empty):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioubcdfgt") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    bad = ["horrorword", "nastyterm", "vilephrase"]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "x" * 60_000), (None, "horrorword " * 5)]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, labels[0], (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {k for k in got if k is not None and got[k].held_out and k < 600} == set(held)
    assert sum(got[k].predicted == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score and got[900].predicted == 0 and 0 <= got[902].score <= 1
    assert {r.doc_id for r in toxicity.keep_ordinary(docs, model).collect()} == {k for k, r in got.items() if r.predicted == 0}
    assert toxicity.toxicity(empty, model).count() == 0
    both = docs.unionByName(frame(spark, [(k, "another text of this document") for k in range(0, 600, 7)])).repartition(5)
    again = [toxicity.fit_toxicity(d, marks.unionByName(spark.createDataFrame([(1, 1, 1), (1, 1, 0)], marks.schema))) for d in (both, both.repartition(3, "text"))]
    assert again[0] == again[1]
    few = toxicity.fit_toxicity(docs.where("doc_id % 2 = 0"), marks, most_toxic=40, most_ordinary=80)
    assert few.toxic != few.ordinary
    none = toxicity.fit_toxicity(empty, marks)
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs.limit(5), none).collect())


def test_mixing(spark, empty):
    rng = random.Random(6)
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno"}
    rows, marks = [], []
    for k in range(240):
        d = ["aa", "aa", "aa", "bb", "bb", "cc"][k % 6]
        rows.append((k, " ".join("".join(rng.choice(letters[d]) for _ in range(4)) for _ in range(rng.randint(5, 60)))))
        marks.append((k, d))
    docs = frame(spark, [*rows, (500, None), (501, ""), (None, "abcd abcd")])
    model = mixing.fit_domains(docs, spark.createDataFrame([*marks, marks[0], (9, None), (None, "aa")], "doc_id long, domain string"))
    for least, targets in ((0.0, {"aa": 0.2, "bb": 0.2, "cc": 0.6}), (1.0, {"aa": 0.4, "bb": 0.3, "cc": 0.3}), (0.0, {"aa": 1.0, "bb": 0.0})):
        out = mixing.mix_sources(docs, model, targets, least=least).collect()
        assert len(out) == 243
        p, w, r = np.array([x.posteriors for x in out]), np.array([x.tokens for x in out]), np.array([x.rate for x in out])
        sums = (p * (w * r)[:, None]).sum(axis=0)
        assert np.allclose(sums / sums.sum(), [targets.get(d, 0) / sum(targets.values()) for d in model.domains], atol=5e-3)
        assert r.min() >= least - 1e-9 and all(x.copies in (int(np.floor(x.rate)), int(np.floor(x.rate)) + 1) for x in out)
        if least:
            assert min(x.copies for x in out) >= 1
    assert {x.doc_id: x.tokens for x in out}[3] == len(split_words(rows[3][1]))
    assert mixing.mix_sources(empty, model, {"aa": 1.0}).count() == 0
    with pytest.raises(ValueError, match="targets"):
        mixing.mix_sources(docs, model, {"zz": 1.0})
    with pytest.raises(Exception, match="too rare"):
        mixing.mix_sources(docs, model, {"aa": 0.01, "cc": 0.99}, least=1.0, most_rate=5.0).collect()


def test_mixing_against_plain_least_squares(spark):
    """Rates are those of a projected gradient of tiny steps over all documents in one place; targets out of reach are told."""
    rng = np.random.default_rng(4)
    words = {"aa": "abcd bcde cdef", "bb": "wxyz vwxy zyxw", "cc": "klmn mnop opqr"}
    texts = [" ".join(rng.choice(words[d].split(), rng.integers(3, 40))) for d in rng.choice(list(words), 150, p=[0.6, 0.3, 0.1])]
    texts += [texts[0] + " " + texts[1], "long " * 30_000]
    docs = frame(spark, list(enumerate(texts)))
    marks = [(k, "aa" if "abcd" in t or "cdef" in t else "bb" if "wxyz" in t or "zyxw" in t else "cc") for k, t in enumerate(texts[:100])]
    model = mixing.fit_domains(docs, spark.createDataFrame(marks, "doc_id long, domain string"))
    for targets, least in (({"aa": 0.3, "bb": 0.3, "cc": 0.4}, 0.0), ({"aa": 0.2, "bb": 0.4, "cc": 0.4}, 1.0)):
        out = sorted(mixing.mix_sources(docs, model, targets, least=least, most_steps=400, close=1e-9).collect(), key=lambda r: r.doc_id)
        p, w = np.array([r.posteriors for r in out]), np.array([r.tokens for r in out], float)
        total, share = w.sum(), np.array([targets[d] for d in model.domains])
        m = (p * w[:, None]).T @ p
        budget = total if not least else max(m.sum(axis=0) / share)
        inverse, r = np.linalg.pinv(m / total + 1e-9 * np.eye(3)), np.full(len(w), max(1.0, least))
        for _ in range(40_000):
            r = np.maximum(least, r - 0.2 * (p @ (inverse @ (((p * (w * r)[:, None]).sum(axis=0) - budget * share) / total)) + 1e-3 * (r - 1)))
        assert np.allclose([x.rate for x in out], r, atol=2e-3) and {x.miss for x in out} == {out[0].miss} and out[0].miss < 0.01
    one = mixing.fit_domains(docs, spark.createDataFrame([], "doc_id long, domain string"), ("aa", "bb"))
    out = mixing.mix_sources(docs, one, {"aa": 0.9, "bb": 0.1}).collect()
    assert len(out) == len(texts) and all(abs(x.posteriors[0] - 0.5) < 1e-9 for x in out) and out[0].miss > 0.3
    none = docs.limit(0)
    assert mixing.mix_sources(none, mixing.fit_domains(none, none.select("doc_id", F.col("lang").alias("domain")), ("aa", "bb")), {"aa": 1.0}).count() == 0
    some = mixing.fit_domains(docs, spark.createDataFrame([(k, d) for k, d in marks if d != "cc"], "doc_id long, domain string"), ("cc",))
    assert some.domains == ("aa", "bb", "cc")


def test_steps_of_mixing_do_not_go_to_all_shuffle_partitions(spark):
    """A step sends one row of each task to one last task, however many shuffle partitions there are."""
    docs = frame(spark, [(k, ["abcd bcde cdef", "wxyz vwxy zyxw"][k % 2] + f" {k}") for k in range(40)])
    model = mixing.fit_domains(docs, spark.createDataFrame([(k, "ab"[k % 2]) for k in range(40)], "doc_id long, domain string"))
    width, before = len(model.domains), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    featured = docs.select("text").mapInPandas(lambda parts: (d.assign(posteriors=[[0.25, 0.75]] * len(d), tokens=3)[["posteriors", "tokens"]] for d in parts), "posteriors array<double>, tokens long")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("one step of mixing", "")
        sums = mixing._sums(featured, width, [], 1.0, 1e-3, 0.0)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert np.allclose(sums, [30.0, 90.0])
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("one step of mixing") for s in status.getJobInfo(j).stageIds}
    assert 0 < sum(status.getStageInfo(s).numTasks for s in stages) <= 2 * docs.rdd.getNumPartitions() + 1
    assert not mixing._sums(featured.limit(0), width, [], 1.0, 1e-3, 0.0).any()


def test_html_text(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now this thing</div>'
        "<article><h1>A &amp; B</h1><p><b>One\n two   three<br>four.<p>Short.</p><!-- c --><p>5 &lt; 6 &eacute; and so on with more words than a few in it</p></article><footer>&copy; me</footer></body>"
    )
    pages = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "just text", "t"), (4, "u", "just text", "t"), (5, "u", "<p>" + "word " * 40_000, "t")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == "A & B\n\nOne two three four.\n\nShort.\n\n5 < 6 é and so on with more words than a few in it"
    assert by[1].n_chars == len(by[1].text) and by[2].text == by[3].text == "" and by[4].text == "just text" and len(got) == 6
    assert by[5].n_chars == 40_000 * 5 - 1
    assert html_text.extract_text(pages.limit(0)).count() == 0


def mirrored(size):
    """Two strings of a and b that every polynomial hash modulo a power of two takes for one."""
    out = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
    return out, out.translate(str.maketrans("ab", "ba"))


def test_equality_is_that_of_bytes(spark, monkeypatch):
    from tokenizers import Tokenizer

    one, other = mirrored(4096)
    spelled = [" ".join(x) for x in (one, other)]
    data = list(enumerate([f"{one}\n{other}", one, other, one, *spelled, " ".join(spelled)]))
    docs = frame(spark, data).coalesce(1)
    for _ in range(2):
        got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
        for i, t in data:
            w = split_words(t)
            windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            assert got[i].n_dup_lines == 0
            assert got[i].n_repeat_words == len({j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
        chunk = quality_rules.Chunk([t for _, t in data])
        held = sorted(quality_rules.repeated_windows(chunk, 5))
        monkeypatch.setattr(quality_rules, "mix", lambda h: h & np.uint64(0))
        assert sorted(quality_rules.repeated_windows(chunk, 5)) == held
    library = Tokenizer.from_file(PATH)
    ids = {r.doc_id: r.ids_crc32 for r in token_files.token_files(docs, PATH).collect()}
    for i, t in data:
        assert ids[i] == zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()} == jaccard_truth(data)
    benchmark = spark.createDataFrame([(1, f"{one} {one} {one} {one}")], "item_id long, text string")
    texts = frame(spark, [(1, f"{other} {other} {other} {other}"), (2, f"{one} {one} {one} {one}")])
    assert [r.doc_id for r in decontamination.contaminated(texts, benchmark).collect()] == [2]


def test_vocabularies_of_other_kinds():
    path = tokens.public_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    coder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = ["Two words, don't  stop\n\nhere", None, "", "x" * 300]
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError, match="byte-level"):
        tokens.PrefixCounter(path)


def test_stored_tables_are_read_back(spark, docs):
    assert stored(docs, "t").count() == docs.count()
