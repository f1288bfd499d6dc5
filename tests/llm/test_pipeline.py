"""The pipeline's stages against plain versions over the smallest tables, and on nulls, repeated rows, very long texts and
columns whose names clash with theirs."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridweave.llm import mixing, shared, token_files, toxicity
from gridweave.llm.queries import MIXTURE, table
from gridweave.llm.shared import stored
from gridweave.llm.tokens import public_path
from tests.llm.test_operators import bare, jaccard_truth

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_columns_and_rows(spark, results):
    docs = table(spark, SF, "documents")
    known = {tuple(r) for r in docs.collect()}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert results[name].columns == docs.columns
        assert {tuple(r) for r in results[name].collect()} <= known


def test_toxicity_stage(spark, results):
    """Each window compressed with both dictionaries, one text after another."""
    docs = table(spark, SF, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, SF, "labels"))
    ours, theirs = toxicity._compressor(model.toxic), toxicity._compressor(model.ordinary)
    kept = []
    for i, text in texts(docs).items():
        words = (text or "").lower().split()
        saved = [len(theirs.compress(w)) - len(ours.compress(w)) for w in (f" {' '.join(words[k : k + 4])} ".encode() for k in range(0, len(words), 4))] or [0]
        best = sorted(saved, reverse=True)
        x = [best[0], sum(best[:3]) / len(best[:3]), *[math.sqrt(sum(s >= t for s in saved) / len(saved)) for t in toxicity.THRESHOLDS], sum(min(8, max(0, s - 1)) for s in saved) / len(saved)]
        z = model.bias + sum(w * (v - c) / s for v, c, s, w in zip(x, model.center, model.scale, model.weights, strict=True))
        if z < 0:
            kept.append(i)
    assert ids(results["toxicity"]) == sorted(kept)


def test_near_duplicate_stage(results):
    truth = jaccard_truth(sorted(texts(results["toxicity"]).items()))
    assert ids(results["ngram_join"]) == sorted(i for i, (root, _) in truth.items() if i == root)


def best_alignment(item, text):
    """The score of the best local alignment, a row of the table at a time."""
    row, ramp = np.zeros(len(text) + 1), np.arange(len(text) + 1)
    best = 0.0
    for word in item:
        now = np.zeros(len(text) + 1)
        now[1:] = np.maximum(np.maximum(row[:-1] + np.where(text == word, 2, -1), row[1:] - 1), 0)
        row = np.maximum.accumulate(now + ramp) - ramp
        best = max(best, row.max())
    return best / (2 * len(item))


def test_decontamination_stage(spark, results):
    """All items against all texts."""
    items = [bare(r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = []
    for i, text in texts(results["ngram_join"]).items():
        words = np.array(bare(text), object)
        have = set(words)
        # A word is worth two at most, so items with too few words in the text need no alignment.
        if not any(len(item) >= 4 and 2 * sum(w in have for w in item) >= len(item) and best_alignment(item, words) >= 0.5 for item in items):
            kept.append(i)
    assert ids(results["decontamination"]) == sorted(kept)


def test_mixing_stage(spark, results):
    """Rates by a projected gradient of tiny steps in one place; each document is there as often, rounded up or down."""
    docs = results["decontamination"]
    usable = docs.where(F.col("lang").isin(list(MIXTURE)) & F.char_length("text").between(1, 16384))
    model = mixing.fit_domains(docs, usable.select("doc_id", F.col("lang").alias("domain")).join(table(spark, SF, "labels").select("doc_id"), "doc_id", "left_semi"))
    names, own = zip(*sorted(texts(docs).items()), strict=True)
    p, w = model.posteriors(list(own)), np.array([len((t or "").split()) for t in own], float)
    share = np.array([MIXTURE.get(d, 0) for d in model.domains])
    share = share / share.sum()
    m, total = (p * w[:, None]).T @ p, w.sum()
    budget = max(h / s for h, s in zip(m.sum(axis=0), share, strict=True) if s > 0)
    inverse, r = np.linalg.pinv(m / total + 1e-9 * np.eye(len(share))), np.ones(len(w))
    for _ in range(20_000):
        r = np.maximum(1.0, r - 0.2 * (p @ (inverse @ (((p * (w * r)[:, None]).sum(axis=0) - budget * share) / total)) + 1e-3 * (r - 1)))
    counts = {x.doc_id: x["count"] for x in results["mixing"].groupBy("doc_id").count().collect()}
    assert set(counts) == set(names)
    assert all(math.floor(rate - 0.02) <= counts[i] <= math.ceil(rate + 0.02) for i, rate in zip(names, r, strict=True))


def test_token_stage(results):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    own = sorted((r.doc_id, r.text) for r in results["mixing"].select("doc_id", "text").collect())
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in results["token_files"].collect())
    want, start = [], 0
    for i, text in own:
        tokens = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((start, i, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert got == want


def test_stages_take_empty_tables_and_nulls(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0
    some = table(spark, SF, "documents").limit(6).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id"))).withColumn("text", F.when(F.col("doc_id") != 3, F.col("text")))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        some = stored(stage(spark, some, SF), "some")
        assert some.where("doc_id is null").count() == 2


def test_stages_take_clashing_columns_and_long_texts(spark):
    docs = table(spark, SF, "documents").limit(20)
    extra = ["k1", "class_id", "_copies", "score", "rate", "tokens", "posteriors", "node", "_order", "copies", "n_links"]
    wide = docs.withColumns({c: F.lit(c) for c in extra})
    long = wide.limit(1).withColumns({"doc_id": F.lit(900_000).cast("long"), "text": F.repeat(F.lit("many words in one very long text "), 20_000)})
    wide = stored(wide.unionByName(long).unionByName(wide.limit(1)), "wide")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, wide, SF), name)
        assert out.columns == wide.columns and out.where("doc_id = 900000").count() >= 1
        assert {r.k1 for r in out.select("k1").collect()} == {"k1"}
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() == 22


def test_workers_get_small_batches(spark):
    """Every stage bounds what a worker gets at once, and a bound of the session's own stays."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.get_total_buffer_size()], pa.int64())], ["bytes"])

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    own = spark.newSession()
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(bound)
            stage(spark, table(spark, SF, "documents"), SF)
            assert int(spark.conf.get(bound)) == shared.BATCH_BYTES
        got = [r[0] for r in docs.select("text").mapInArrow(sizes, "bytes long").collect()]
        assert len(got) > 2 and max(got) < 3 * shared.BATCH_BYTES
        own.conf.set(bound, "1000000")
        shared.small_batches(own)
        assert own.conf.get(bound) == "1000000"
    finally:
        spark.conf.unset(bound)


def test_filters_return_some_rows_at_a_time():
    """What a filter keeps goes back in parts, and texts are made in parts."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([None, "a b"] * 500)], ["doc_id", "text"])
    got = list(shared.parts(batch))
    assert max(p.num_rows for p in got) == shared.SOME_ROWS and pa.Table.from_batches(got).to_pylist() == batch.to_pylist()
    assert list(shared.values(batch["text"])) == batch["text"].to_pylist()
    assert list(shared.parts(batch.slice(0, 0))) == [] == list(shared.values(batch["text"].slice(0, 0)))


def test_token_files_need_no_rows_of_python_lists(spark, monkeypatch):
    """Such rows start a second daemon with workers of its own on each executor."""
    docs = table(spark, SF, "documents").limit(20)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("rows of a Python list"))
    assert token_files.token_files(docs, public_path("byte_bpe_50k.json")).count() == 20
