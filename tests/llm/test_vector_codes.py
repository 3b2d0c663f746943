"""Vector codes against a plain version with Python integers."""

import hashlib
import math

import numpy as np

from tidemark.llm import vector_codes
from tidemark.llm.queries import QUERIES


def plainly(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error) of the kept rows and the codebooks, from (vec_id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) if abs(x) < 2**53 else int(x) * 4096 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    size = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * size : (p + 1) * size] for _, v, _ in first] for p in range(parts)]

    def nearest(p, piece):
        return min((sum((a - b) ** 2 for a, b in zip(piece, entry)), k) for k, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            pieces = [v[p * size : (p + 1) * size] for _, v, _ in kept]
            owners = [nearest(p, piece)[1] for piece in pieces]
            for k in set(owners):
                mine = [piece for piece, o in zip(pieces, owners) if o == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for i, v, label in kept:
        best = [nearest(p, v[p * size : (p + 1) * size]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), 2**63 - 1), label))
    return out, books


def order(rows):
    return sorted(rows, key=repr)


def compared(spark, rows, kind="float"):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code int, small string").repartition(3)
    codes, books = vector_codes.compress(frame)
    expected, expected_books = plainly([(r.vec_id, r.embedding, r.label) for r in frame.collect()])
    assert books == expected_books
    assert order((r.vec_id, r.code, r.error, r.label) for r in codes.collect()) == order(expected)


def test_random_vectors_with_faults_ties_and_repeats(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in draw.normal(0, 0.3, 24)], int(i) % 3 if i % 5 else None) for i in range(300)]
    rows += [rows[7]] * 40 + [(7, rows[9][1], 1), (None, rows[3][1], 2), (400, None, 1), (401, [None] + [0.5] * 23, 1), (402, [math.nan] * 24, 1)]
    rows += [(403, [math.inf] * 30, 1), (404, [], 1), (405, [0.25] * 5, 1), (406, [-1.0 / 4096 / 2] * 24, 1), (0, [0.0] * 24, 0)]
    compared(spark, rows)


def test_few_rows_and_huge_components(spark):
    compared(spark, [(1, [1.0] * 8, 1), (2, [2.0] * 8, 1)])
    draw = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in draw.normal(0, 10.0 ** (i % 40), 16)], 1) for i in range(60)]
    compared(spark, rows, "double")
    compared(spark, [(1, [1e300] * 9, 1), (2, [-1e300, 5.0], 1), (3, [1e308] * 9, 2)], "double")


def test_empty(spark):
    codes, books = vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert codes.collect() == [] and books == []
    codes, books = vector_codes.compress(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int"))
    assert codes.collect() == [] and books == []


def test_search_sees_all_ties_and_few_entries():
    draw = np.random.default_rng(3)
    entries = draw.integers(-20, 20, (64, 4))
    entries[40] = entries[3]
    parts = draw.integers(-25, 25, (5000, 4))
    index = vector_codes.EqualAverageIndex(entries)
    nearest, distance = index.nearest(parts)
    full = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (nearest == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert index.measured < full.size / 2


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    given = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected, books = plainly(given)
    totals = {}
    for _, _, error, label in expected:
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = QUERIES["op12_vector_codes"](spark, folder).collect()
    rows = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found]
    assert order(rows) == order((i, c, e, totals[label], digest) for i, c, e, label in expected)
