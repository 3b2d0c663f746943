"""Packing: every document's ids come back whole, sequences have no gaps, neighbours on the curve are alike."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def whole(model, text):
    return [*model.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_between_safe_cuts_have_the_ids_of_the_whole_text(model, monkeypatch):
    draw = random.Random(1)
    signs = [" ", " ", " ", "\n", "\t", "a", "Bc", "'s", "'", "1", "é", "中", "　", "\x1c", ".", "!?", "\x85", "\xa0", "<|endoftext|>"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(3000)]
    tokens = packing.WordTokens(PATH)
    monkeypatch.setattr(packing, "TEXT_BLOCK", 9)
    monkeypatch.setattr(packing, "CACHE_WORDS", 500)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert [np.frombuffer(i, "<u4").tolist() for i in tokens.ids(some)] == [whole(model, t)[:-1] for t in some]


def test_hilbert_keys_are_a_path():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_powers():
    assert all(sum(packing._powers(n)) == n and all(p & p - 1 == 0 for p in packing._powers(n)) for n in range(1024))


def checked(model, docs, pieces, length=1024):
    """``docs``: (doc_id, text) with repeats; ``pieces``: rows of the operator."""
    by_sequence = defaultdict(list)
    by_document = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_document[p.doc_id].append(p)
    for spans in by_sequence.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at and size > 0
            at += size
        assert at == length or at & at - 1 == 0 and at < length
    expected = defaultdict(list)
    for doc_id, text in docs:
        expected[doc_id].append(whole(model, text))
    assert by_document.keys() == expected.keys()
    for doc_id, several in expected.items():
        if len(several) == 1:
            ids, at = several[0], 0
            for p in sorted(by_document[doc_id], key=lambda p: p.start):
                part = np.array(ids[at : at + p.length], "<u4").tobytes()
                assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(part), len(ids))
                at += p.length
            assert at == len(ids)
        else:  # rows that share an id: the same pieces are there, whichever row they are of
            assert sum(p.length for p in by_document[doc_id]) == sum(map(len, several))
            assert sum(p.start == 0 for p in by_document[doc_id]) == len(several)


def test_odd_documents(spark, model):
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "中文" * 5_000), (6, "a"), (None, "no id"), (None, "no id"), (7, "twice"), (7, "another"), (8, "é" * 1023), (9, "<|endoftext|> said")]
    docs += [(100 + i, "the same text in very many documents") for i in range(500)]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, curve int, ids string, start int")
    found = packing.pack(frame, PATH).collect()
    checked(model, docs, found)
    assert all(np.frombuffer(p.ids, "<u4").size == p.length and zlib.crc32(p.ids) == p.ids_crc32 for p in found)
    small = packing.pack(frame, PATH, length=16).collect()
    checked(model, docs, small, 16)
    assert packing.pack(frame.where("false"), PATH).collect() == []


def test_query(spark, model):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    query = QUERIES["op13_packing"]
    found = query(spark, folder).collect()
    checked(model, docs, found)
    assert sorted(map(tuple, found)) == sorted(map(tuple, query(spark, folder).collect()))


def test_neighbours_on_the_curve_are_alike(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    vectors = np.array([packing.hashed_vector(t) for t in texts])
    vectors = vectors - vectors.mean(axis=0)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12
    order = np.argsort(packing.curve_keys(texts), kind="stable")
    along = (vectors[order][1:] * vectors[order][:-1]).sum(axis=1).mean()
    assert along > (vectors[1:] * vectors[:-1]).sum(axis=1).mean() + 0.2
