"""A corpus from raw documents in five stages, each written as a table before the next one reads it.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the
last adds where each kept document goes in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, simhash
from tidemark.llm.components import connected_components
from tidemark.llm.decontamination import benchmark_matches
from tidemark.llm.line_dedup import drop_shared_lines
from tidemark.llm.mixing import mix
from tidemark.llm.quality_crf import score_documents, train
from tidemark.session import materialize

# No SQL: the chain of the first stage is fitted, and SQL has neither MinHash nor edit distances over words.
# tests/llm compares every stage with a plain version of it.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of doc_id (null last) and a hash of the text, so that rows without an id or with a repeated one stay apart."""
    return docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark")))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose key is not among the rejected (in column doc_id)."""
    gone = rejected.select(F.col("doc_id").alias("_key")).distinct()
    return _keyed(docs).join(gone, "_key", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject.

    A null or empty text is one empty line and is scored like any other; all lines of a very
    long text count. Rows that repeat an id are judged each by its text, equal rows alike. Without any
    labelled document every score is 1/2 and nothing goes; an empty table stays empty. Further columns stay.
    """
    params = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, score_documents(_keyed(docs), params, doc_id="_key").where("NOT good"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows the text.

    A row that loses nothing stays as it is, null text included; one that loses every line has an
    empty text. The largest doc_id keeps a shared line, in every row that repeats it; rows
    without an id are one document, smaller than any other. Texts of any length are split whole. Further columns stay, whatever their names.
    """
    kept = drop_shared_lines(docs)
    # a document that loses nothing keeps its row as it is, null text included
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def _near_groups(keyed: DataFrame) -> DataFrame:
    """doc_id and component_id of every row: components of the links of fingerprints and of those of sets, taken together."""
    by_bits = simhash.near_duplicates(keyed, doc_id="_key").select("doc_id", F.col("component_id").alias("bits")).distinct()
    by_sets = jaccard.near_duplicates(keyed, doc_id="_key").select("doc_id", "set_id", F.col("component_id").alias("sets"))
    rows = materialize(by_sets.join(by_bits, "doc_id"))  # rows of one key have one text, and so one fingerprint and one set
    # a component of either kind is a star around its smallest set
    stars = []
    for kind in ("bits", "sets"):
        centres = materialize(rows.groupBy(kind).agg(F.min("set_id").alias("v"), F.max("set_id").alias("_last")).where("v <> _last").drop("_last"))
        stars.append(rows.join(centres, kind).select(F.col("set_id").alias("u"), "v").where("u <> v").distinct())
    roots = materialize(connected_components(stars[0].unionByName(stars[1])))
    placed = rows.join(roots, F.col("set_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "set_id").alias("root"))
    # a table of its own, so that the join can split a component that very many rows are in
    lows = materialize(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return placed.join(lows, "root").select("doc_id", "component_id")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that with the smallest doc_id; of rows that repeat it, one.

    Texts whose SimHash fingerprints differ in at most op8's number of bits are near copies, and so are texts of a 5-word
    Jaccard similarity of 0.8 or more, most of which the bits alone miss; groups are what links of both kinds reach.
    Texts without words (null, empty) are copies of each other. A null id stays only where its group has no other; very long
    texts are compared whole. An empty table stays empty; further columns stay.
    """
    found = materialize(_near_groups(_keyed(docs)))
    kept = _without(docs, found.where("doc_id <> component_id"))
    repeated = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.take(1):
        return kept
    keys = repeated.select(F.col("doc_id").alias("_key"))
    once = _keyed(kept).join(keys, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
    return _keyed(kept).join(keys, "_key", "left_anti").select(*docs.columns).unionByName(once)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; very long ones are searched whole. Rows that repeat an id are judged each by its text.
    Without items every document stays; an empty table stays empty. Further columns stay.
    """
    return _without(docs, benchmark_matches(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="_key"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's target, the shards that take a copy of it, and the words taken.

    A null or empty text has size 0 and nothing is taken of it; a null source is a source, the last. Rows that repeat an id are
    documents of their own, ties are ordered by id and text hash. An empty table gives no rows; further columns go.
    """
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "shards", "taken", "order_key")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", shared_lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_free),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
