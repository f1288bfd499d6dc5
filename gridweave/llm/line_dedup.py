"""Line deduplication across documents, with DataFrame functions only.

Lines are exploded with their positions, keyed by 128 bits of SHA-256 of their normalised form, and the documents of each
key counted; lines of keys over the threshold go, except in the first document, and the others are put back in order.

Scale: the aggregate over keys combines on the map side, so a line found in a third of all documents costs a row per
task. The join that marks lines has a plain exchange on either side, so adaptive execution splits such a key. Texts
are shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shared import stored

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, its ASCII letters in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def digest128(text: Column) -> Column:
    """16 bytes of SHA-256, which stand for the text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any other columns) with ``text`` rebuilt, ``n_lines`` and ``n_dropped``.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines but those of the
    smallest doc_id. Null or empty text: one empty line, result "". Rows with one doc_id are one document: none makes
    a line of another repeated, and each row keeps its own text. Rows with a null doc_id count together as one document
    after all others. A document whose lines all go has "". Columns named n_lines or n_dropped are replaced.
    """
    if min_docs < 2:
        raise ValueError("min_docs is at least 2")
    base = docs.drop("n_lines", "n_dropped").withColumn("text", F.coalesce("text", F.lit("")))
    lines = base.select("doc_id", digest128(F.col("text")).alias("_body"), F.posexplode(F.split("text", "\n", -1)).alias("_at", "_line"))
    keyed = lines.withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    keyed = keyed.select("doc_id", "_body", "_at", digest128(F.col("_key")).alias("_key"))

    unnamed = F.max(F.col("doc_id").isNull().cast("int"))
    if min_docs == 2:
        found = keyed.groupBy("_key").agg(F.min("doc_id").alias("_keep"), F.max("doc_id").alias("_last"), unnamed.alias("_unnamed"))
        found = found.where((F.col("_keep") < F.col("_last")) | (F.col("_keep").isNotNull() & (F.col("_unnamed") == 1)))
    else:
        per_doc = keyed.groupBy("_key", "doc_id").agg(F.lit(1).alias("_one"))
        found = per_doc.groupBy("_key").agg(F.min("doc_id").alias("_keep"), F.sum("_one").alias("_docs")).where(F.col("_docs") >= min_docs)
    repeated = stored(found.select("_key", "_keep"), "repeated_lines")

    marked = keyed.join(repeated, "_key").where(~F.col("doc_id").eqNullSafe(F.col("_keep")))
    dropped = marked.groupBy(F.col("doc_id").alias("_doc"), "_body").agg(F.sort_array(F.collect_set("_at")).alias("_gone"))
    whole = base.withColumn("_body", digest128(F.col("text")))
    joined = whole.join(dropped, whole["doc_id"].eqNullSafe(dropped["_doc"]) & (whole["_body"] == dropped["_body"]), "left").drop("_doc", "_body")
    # Split behind the join, so that texts and not arrays of lines are shuffled and sorted.
    joined = joined.withColumn("_lines", F.split("text", "\n", -1))

    none = F.array().cast("array<int>")
    gone, size = F.coalesce("_gone", none), F.size("_lines")
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(size)), lambda a, b: F.slice(F.col("_lines"), a + 2, b - a - 1))
    out = joined.withColumns({"text": F.concat_ws("\n", F.flatten(runs)), "n_lines": size.cast("long"), "n_dropped": F.size(gone).cast("long")})
    return out.select(*docs.drop("n_lines", "n_dropped").columns, "n_lines", "n_dropped")
