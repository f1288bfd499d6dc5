"""A corpus pipeline of five stages over ``documents``: toxic documents go, one of each group of near duplicates stays,
copies of benchmark items go, languages are mixed to target weights, and what is left is written as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a caller writes it and gives it to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.decontamination import without_contaminated
from gridweave.llm.mixing import fit_domains, mix_sources
from gridweave.llm.ngram_join import without_near_duplicates
from gridweave.llm.queries import MIXTURE, table
from gridweave.llm.shared import drop_stored, small_batches, stored, unused
from gridweave.llm.token_files import token_files
from gridweave.llm.tokens import public_path
from gridweave.llm.toxicity import fit_toxicity, keep_ordinary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    small_batches(spark)
    return keep_ordinary(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest doc_id. Rows without words or without a doc_id
    have no near duplicates; of the former each doc_id and text stays once, of the latter every row."""
    small_batches(spark)
    return without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item."""
    small_batches(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


#: A language so rare that its documents were to be repeated more often is an error.
MOST_COPIES = 1000.0


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once and rarer languages more often, so that their expected words meet MIXTURE. Languages
    without labelled documents are left out of the targets; without any, all documents stay as they are, as do rows
    without a doc_id. All rows of a doc_id are repeated as often as the one of them that is to be most often."""
    small_batches(spark)
    usable = docs.where(F.col("lang").isin(list(MIXTURE)) & F.char_length("text").between(1, 16384))
    labelled = usable.select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    if labelled.isEmpty():
        return docs
    model = fit_domains(docs, labelled)
    targets = {k: v for k, v in MIXTURE.items() if k in model.domains}
    named = docs.where(F.col("doc_id").isNotNull())
    (copies,) = unused(docs.columns, "_copies")
    rates = mix_sources(named, model, targets, least=1.0, most_rate=MOST_COPIES).groupBy("doc_id").agg(F.max("copies").alias(copies))
    repeated = F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))
    mixed = named.join(rates, "doc_id").select(*docs.columns, repeated.alias(copies)).select(docs.columns)
    return mixed.unionByName(docs.where(F.col("doc_id").isNull()))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document as read back from the files."""
    small_batches(spark)
    return token_files(docs, public_path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_languages),
    ("token_files", write_token_ids),
]

#: The first stage cannot be said in SQL; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder before the next and deleted once that
    is written; the last one reads its own files."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop_stored(docs)
    return out
