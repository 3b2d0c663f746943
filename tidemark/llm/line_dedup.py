"""Lines that many documents share, as compressed keep bitmaps per document.

Hashes of the long lines are range-partitioned by (hash, document) and sorted by
(hash, document, position), so that a line which a third of all documents hold spans
many partitions. A window that needs no further shuffle streams over that order and marks
the first position of a hash in each document; holders are counted from those marks alone,
summed up in each partition first. What comes back per document is not text but a run-length bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import WHITE, ascii_lower
from tidemark.session import materialize

MIN_CHARS = 40
MIN_DOCS = 5
OPEN_END = 2147483647


def lines_of(text: Column) -> Column:
    """Lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: 128-bit hash of the key, document, position."""
    lines = docs.select(
        F.col(doc_id).alias("doc"), _row_mark(F.col(text)).alias("mark"), F.posexplode(lines_of(F.col(text))).alias("pos", "line")
    )
    keys = lines.select("doc", "mark", "pos", F.btrim("line", F.lit(WHITE)).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc", "mark", "pos", ascii_lower(F.col("key")).alias("key")).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "mark", "pos"
    )


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Documents that lose lines: doc, mark, n_dropped, and keep, the kept runs as (start, length).

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of ``min_chars`` code points or more that ``min_docs``
    documents or more hold lose all their lines but those of the largest doc_id.
    Null doc_ids are one document, smaller than any other. Rows that repeat a
    doc_id are one document in the counts; ``mark``, a hash of the text, tells
    their bitmaps apart. The last run is open-ended. No document: no row.
    """
    lines = line_hashes(docs, doc_id, text, min_chars)
    # rows without an id may be very many: their texts part them
    lines = lines.withColumn("own", F.when(F.col("doc").isNull(), F.col("mark")))
    unit = ["h1", "h2", "doc", "own"]
    ranged = lines.repartitionByRange(*unit).sortWithinPartitions(*unit, "mark", "pos")
    first = F.row_number().over(Window.partitionBy(*unit).orderBy("mark", "pos")) == 1
    # the order is written with the marks, for the count and for the join
    ranged = materialize(ranged.withColumn("first", first).drop("own"))
    holders = F.count("doc") + F.max(F.col("doc").isNull().cast("long"))  # those without an id are one document
    counted = ranged.where("first").groupBy("h1", "h2").agg(holders.alias("n_docs"), F.max("doc").alias("keeper"))
    # a table of its own, so that the join below can split the rows of a line that very many documents hold
    shared = materialize(counted.where(F.col("n_docs") >= min_docs).drop("n_docs"))
    dropped = ranged.join(shared, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    bits = dropped.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    bounds = F.concat(F.array(F.lit(-1)), F.col("gone"))
    runs = F.transform(
        bounds,
        lambda b, i: F.struct(
            (b + 1).alias("start"), (F.coalesce(F.get(F.col("gone"), i), F.lit(OPEN_END)) - b - 1).alias("length")
        ),
    )
    return bits.select("doc", "mark", F.size("gone").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The given rows with kept_text, n_lines and n_dropped added (they replace columns of these names)."""
    given = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    # the row is one column, so that no name of it can clash
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in dict.fromkeys((*given, doc_id, text))]).alias("row"))
    row = F.col("row")
    marks = bitmaps.select("doc", "mark", "n_dropped", "keep")
    same = row[doc_id].eqNullSafe(marks["doc"]) & (_row_mark(row[text]) == marks["mark"])
    split = rows.join(marks, same, "left").select("row", "n_dropped", "keep", lines_of(row[text]).alias("lines"))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice("lines", r["start"] + 1, r["length"]))), "\n")
    return split.select(
        *[row[c].alias(c) for c in given],
        F.when(F.col("keep").isNull(), F.coalesce(row[text], F.lit(""))).otherwise(kept).alias("kept_text"),
        # the second use of lines keeps Spark from splitting the text again for every run
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The given rows with kept_text, n_lines and n_dropped: see keep_bitmaps. Every row stays."""
    return apply_bitmaps(docs, keep_bitmaps(docs, doc_id, text, **limits), doc_id, text)
