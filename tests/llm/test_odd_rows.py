"""Rows that once went wrong: wide shards, repeated ids, clashing names, short and unspaced items, long labelled documents."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, quality_crf, substring_dedup
from tidemark.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def test_more_words_than_letters(monkeypatch):
    words = [f"w{i}".encode() for i in range(120)]
    units = [(1, 1, 0, b" ".join(words[:60])), (2, 2, 7, b" ".join(words[30:90])), (3, 3, 0, b" ".join(words[90:]))]
    plain = substring_dedup.locate(units, 13)
    assert plain == [(2, 2, 7, 37)]
    monkeypatch.setattr(substring_dedup, "LETTERS", 50)
    assert substring_dedup.locate(units, 13) == plain


def test_letters_beyond_the_surrogates():
    words = [b"%d" % i for i in range(0x11000)]
    units = [(1, 1, 0, b" ".join(words)), (2, 2, 0, b" ".join(words[0xD7F0:0xD810]))]
    assert substring_dedup.locate(units, 13) == [(2, 2, 0, 32)]


def test_repeated_ids_are_judged_by_their_texts(spark, tmp_path):
    long = "a" * 300
    rows = [(1, long + "x"), (1, long + "y"), (2, long + "y"), (None, long + "x"), (3, None), (4, ""), (3, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op9_exact_dedup"](spark, str(tmp_path)).collect()}
    sha = {t: hashlib.sha256((long + t if t else t).encode()).hexdigest() for t in ("x", "y", "")}
    assert found == {
        (1, 1, 2, True, sha["x"]), (None, 1, 2, False, sha["x"]), (1, 1, 2, True, sha["y"]), (2, 1, 2, False, sha["y"]),
        (3, 3, 3, True, sha[""]), (4, 3, 3, False, sha[""]),
    }


def test_clashing_names_and_rows_without_id(spark):
    line = "a line of more than forty code points that is shared by many"
    rows = [(d, f"{line}\nown {d}") for d in range(6)] + [(None, f"{line}\nno id {k % 3}") for k in range(9)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], DOCS + ", _keep int, _lines int, _n_dropped int, row int, own int")
    kept = line_dedup.drop_shared_lines(docs)
    assert kept.columns == ["doc_id", "text", "_keep", "_lines", "_n_dropped", "row", "own", "kept_text", "n_lines", "n_dropped"]
    got = sorted((str(r.doc_id), r.kept_text, r.n_dropped, r._keep, r.own) for r in kept.collect())
    want = [(str(d), t if d == 5 else t.split("\n")[1], int(d != 5), 1, 5) for d, t in rows]
    assert got == sorted(want)
    # five rows without an id are one document: too few holders
    few = spark.createDataFrame([(1, line), (2, line), (3, line), *[(None, f"{line}\n{k}") for k in range(5)]], DOCS)
    assert line_dedup.drop_shared_lines(few).agg(F.sum("n_dropped")).first()[0] == 0


def test_sorted_lines_need_no_second_shuffle(spark):
    docs = spark.createDataFrame([(d, "line " * 20 + str(d % 3)) for d in range(50)], DOCS)
    lines = line_dedup.line_hashes(docs, "doc_id", "text", 40).withColumn("own", F.when(F.col("doc").isNull(), F.col("mark")))
    unit = ["h1", "h2", "doc", "own"]
    over = line_dedup.Window.partitionBy(*unit).orderBy("mark", "pos")
    plan = lines.repartitionByRange(*unit).sortWithinPartitions(*unit, "mark", "pos").withColumn("first", F.row_number().over(over) == 1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1


def items_found(spark, docs, items):
    found = decontamination.benchmark_matches(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    )
    return sorted((r.doc_id, r.item_id, r.distance, r.budget) for r in found.collect())


def test_short_unspaced_and_repeated_items(spark):
    chinese = "今天天气很好我们一起去公园散步然后回家吃饭"
    edited = chinese.replace("公园", "海边")
    docs = [(1, f"前言{chinese}后记"), (2, f"x {edited} y"), (3, "He said four score and."), (4, "four score or"), (5, None), (6, "今天")]
    items = [(10, chinese), (11, "Four score and"), (12, None), (13, "?!"), (14, chinese), (15, "")]
    assert items_found(spark, docs, items) == [(1, 10, 0, 4), (1, 14, 0, 4), (2, 10, 2, 4), (2, 14, 2, 4), (3, 11, 0, 0)]


def test_many_equal_items_are_searched_once(spark):
    assert len(items_found(spark, [(1, "the very same words of an item")], [(i, "the very same words of an item") for i in range(300)])) == 300


def test_long_labelled_documents_teach(spark):
    good = "\n".join(["A sentence of plain words that ends well, as it should."] * 90)
    bad = "\n".join(["BUY NOW!!! $$$ ||| 99999 !!!"] * 90)
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)] + [(100, good[:40]), (101, bad[:20])], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 0) for i in range(1000, 1100)], "doc_id long, quality int")
    params = quality_crf.train(docs, labels)
    assert any(params)
    scored = {r.doc_id: r.score for r in quality_crf.score_documents(docs, params).collect()}
    assert scored[100] > 0.8 and scored[101] < 0.2 and scored[1] > 0.8 and scored[0] < 0.2
    assert len(quality_crf.sample_window(good.encode()).split(b"\n")) == quality_crf.SAMPLE_LINES


@pytest.mark.parametrize("name", ["op10_quality_classifier"])
def test_held_out_accuracy(spark, name):
    folder = "/root/testdata/sf0.1"
    found = QUERIES[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id")
    rows = [(r.predicted, r.quality) for r in found.where("quality IS NOT NULL").collect()]
    assert np.mean([p == q for p, q in rows]) > 0.98
