"""Every stage of the corpus pipeline against a plain version of it, each on the rows that the stage before kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_jaccard import smallest_by_hand
from test_native import lines_by_hand, targets_by_hand

import corpus_pipeline
from tidemark.llm import decontamination, jaccard, quality_crf
from tidemark.session import materialize

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], FOLDER)))
    return [t.toPandas() for t in tables]


def test_stages_are_named_and_keep_the_columns(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing",
    ]
    assert all(list(t.columns) == COLUMNS for t in kept[:-1])


def test_quality_rejects_what_scores_low(spark, kept):
    params = quality_crf.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    low = quality_crf.scores([t.encode() for t in kept[0].text], np.array(params)) < quality_crf.THRESHOLD
    assert set(kept[1].doc_id) == set(kept[0].doc_id[~low]) and low.any() and not low.all()


def test_shared_lines_go(kept):
    want = lines_by_hand(list(zip(kept[1].doc_id, kept[1].text)))
    assert dict(zip(kept[2].doc_id, kept[2].text)) == {doc: text for doc, _, _, text in want}
    assert (kept[2].n_chars == kept[2].text.str.len()).all()


def test_one_document_of_each_near_group_stays(kept):
    low = smallest_by_hand(list(zip(kept[2].doc_id, kept[2].text)))
    assert sorted(kept[3].doc_id) == sorted(set(low.values()))


def test_benchmark_passages_go(spark, kept):
    items = [decontamination.words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = set()
    for doc, text in zip(kept[3].doc_id, kept[3].text):
        words = decontamination.words_of(text)
        if words and any(min(decontamination.edit_profile(p, words)) <= int(0.2 * len(p)) for p in items if p):
            dirty.add(doc)
    assert set(kept[4].doc_id) == set(kept[3].doc_id) - dirty


def test_all_that_is_left_is_mixed(kept):
    last = kept[5]
    sizes = {d: len(t.encode().split()) for d, t in zip(kept[4].doc_id, kept[4].text)}
    assert dict(zip(last.doc_id, last["size"])) == sizes
    want = targets_by_hand(last.groupby("source")["size"].sum().to_dict())
    assert all(t == pytest.approx(want[s]) for s, t in zip(last.source, last.target))
    assert (last.taken == last["size"] * last.shards.map(len)).all() and (last.taken <= 3 * last["size"]).all()


def test_odd_rows_and_empty_tables_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c", "en", None, 5), (1, "a b c", "en", None, 5), (None, "other words", "en", "a", 5), (None, None, None, None, None)]
    for given, count in ((rows, 3), ([], 0)):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, FOLDER))
        assert docs.count() == count
        assert docs.where(F.col("taken").isNull()).count() == 0


def test_near_copies_by_fingerprint_are_one_group_with_those_by_sets(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    tail = [" ".join(f"{mark}{i}" for i in range(12)) for mark in "abc"]
    mostly_one_word = ["go " * 200 + t for t in tail[:2]]  # one fingerprint, sets far apart
    long_text = " ".join(f"w{i}" for i in range(100))
    texts = [mostly_one_word[0], mostly_one_word[1], mostly_one_word[1].upper(), tail[2], long_text, long_text.replace("w50", "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts, 1)] + [(None, texts[0], "en", "s", 1)], schema)
    assert jaccard.SIMILARITY > 0.5 > len(set(jaccard.shingle_set(texts[0].encode())) & set(jaccard.shingle_set(texts[1].encode()))) / 20
    kept = corpus_pipeline.near_copies(spark, docs, FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]
