"""Exact duplicates by progressive refinement: length, then a prefix hash, then a hash of the whole content.

Only documents whose length and prefix hash another one shares have their whole
content hashed. All groups are summed up before the shuffle, so that a group of
a third of all rows costs each task one row; the joins back to the rows are
equality joins, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import squeezed
from tidemark.session import materialize

PREFIX_CHARS = 256


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, normalised content, its length in bytes and a 64-bit hash of its first ``PREFIX_CHARS`` characters."""
    content = docs.select(F.col(doc_id).alias("doc_id"), squeezed(F.col(text)).alias("content"))
    return content.select(
        "doc_id",
        "content",
        F.octet_length("content").cast("long").alias("length"),
        F.xxhash64(F.substring("content", 1, PREFIX_CHARS)).alias("prefix"),
    )


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys of two rows or more, as a table of its own, so that a join with it can split the rows of a hot key."""
    shared = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return materialize(shared)


def _refined(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that nothing shares length and prefix with; the others with a digest of their content; the groups of equal digests."""
    content = marked(docs, doc_id, text)
    # a few bytes stand for each text until a group survives
    marks = materialize(content.drop("content"))
    lengths = _shared(marks, "length")
    survivors = _shared(marks.join(lengths, "length", "left_semi"), "length", "prefix")
    alone = marks.join(survivors, ["length", "prefix"], "left_anti")
    hashed = materialize(
        content.join(survivors, ["length", "prefix"], "left_semi").select(
            "doc_id", "length", "prefix", F.unhex(F.sha2("content", 256)).alias("digest")
        )
    )
    groups = hashed.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # a table of its own, so that a join with it can split a digest that very many rows have
    return alone, hashed, materialize(groups)


def equal_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """digest (SHA-256 of the normalised text), keep_id and group_size of the texts that refinement had to read; all others are alone."""
    return _refined(docs, doc_id, text)[2]


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, length, prefix, digest, keep_id, group_size, kept.

    Texts are equal when identical after each run of ASCII white space became one
    space; null counts as empty. The row with the smallest doc_id of a group stays.
    Repeated rows each count in group_size, and all rows with the smallest doc_id
    are kept; rows that repeat a doc_id with another text are judged by their own. A null
    doc_id counts as larger than any other: it stays only where its group has no other.
    ``digest`` is null for a text that did not have to be read whole. An empty table gives
    no rows; other columns are ignored.
    """
    alone, hashed, groups = _refined(docs, doc_id, text)
    single = alone.select(
        "doc_id", "length", "prefix", F.lit(None).cast("binary").alias("digest"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    copies = hashed.join(groups, "digest").select("doc_id", "length", "prefix", "digest", "keep_id", "group_size")
    return single.unionByName(copies).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
