import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import resampling as rs


def test_gaps_come_back_and_a_draw_travels_in_about_a_byte():
    rng = np.random.default_rng(2)
    for kind, gaps in ((np.uint8, rng.geometric(1 / 80, 20_000) - 1), (np.uint16, np.array([0, 65_534, 65_535, 200_000, 0]))):
        packed, ends = rs._pack_gaps(gaps, kind)
        assert (rs._unpack_gaps(packed.tobytes(), np.dtype(kind).str) == np.cumsum(gaps)).all()
        assert ends[-1] == len(packed)
        if kind is np.uint8:
            assert packed.nbytes < 1.1 * len(gaps)


def test_draws_of_persons_travel_packed(spark):
    people = spark.range(3000).select(F.col("id").alias("person_id"), (F.col("id") % 2).cast("int").alias("y"), F.lit(0).alias("arm"), F.lit(0.5).alias("value"))
    ranked = rs.ranked_persons(people, [], 3)
    draws = rs._draws(ranked, [], rs._in_blocks(100), 3).toPandas()
    assert draws["_gaps"].map(len).sum() < 2 * 3000 * 100  # four bytes a draw before
    counts = sum(int(rs._drawn_counts(part, 1, 100).sum()) for _, part in draws.groupby(["stratum", "_block"]))
    assert counts == 3000 * 100


def test_a_block_of_persons_returns_sums_per_score_not_a_weight_per_entry():
    n, width = 5000, 50
    rng = np.random.default_rng(4)
    value, arm, y = rng.integers(0, 10, n) / 10, rng.integers(0, 2, n), rng.integers(0, 2, n)
    place, times = rng.integers(0, 200, n), rng.integers(1, 3, n)
    weights = rng.poisson(1, (200, width)).astype(np.uint16)
    held = pd.DataFrame({"_range": (value > 0.4).astype(np.int64), "value": value, "arm": arm, "y": y, "_place": place, "times": times})
    rows = list(rs._block_sums(held, [], [(1, width)], lambda first, last: weights))
    assert [row[0] for row in rows] == [0, 1]
    got = {}
    for _, _, values, arms, ys, totals, sums, kind in rows:
        keys = zip(np.frombuffer(values), np.frombuffer(arms, np.uint8), np.frombuffer(ys), np.frombuffer(totals, np.int64))
        got |= {(v, a, o): (t, s) for (v, a, o, t), s in zip(keys, rs._unpacked_sums(kind, sums, width))}
    assert len(got) == 40
    for (v, a, o), (total, sums) in got.items():
        here = (value == v) & (arm == a) & (y == o)
        assert total == times[here].sum()
        assert (sums == (weights[place[here]] * times[here, None]).sum(axis=0)).all()
    assert sum(len(row[6]) for row in rows) <= 40 * width * 2  # 2 * n * width bytes before


def test_small_sums_are_compressed_and_large_ones_whole():
    rng = np.random.default_rng(5)
    for sums in (rng.poisson(1, (300, 50)), rng.integers(0, 1 << 40, (3, 50)), np.zeros((2, 50), np.int64)):
        kind, raw = rs._packed_sums(sums)
        assert (rs._unpacked_sums(kind, raw, 50) == sums).all()


def test_draws_travel_in_less_than_five_bits(spark):
    people = spark.range(40_000).select(F.col("id").alias("person_id"), F.lit(1).alias("y"))
    ranked = rs.ranked_persons(people, [], 3)
    draws = rs._draws(ranked, [], rs._in_blocks(200), 3).toPandas()
    assert draws["_gaps"].map(len).sum() < 40_000 * 200 * 5 / 8  # eight bits a draw before
    counts = [rs._drawn_counts(part, 1, 200) for _, part in draws.groupby("_block")]
    assert sum(int(c.sum(dtype=np.int64)) for c in counts) == 40_000 * 200


def test_a_draw_takes_two_bits_in_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(rs, "_CELLS", 400_000)  # a task draws for the whole of the larger group, in few replicates at once
    bits = []
    for size in (10_000, 150_000):
        ranked = rs.ranked_persons(spark.range(size).select(F.col("id").alias("person_id"), F.lit(1).alias("y")), [], 3)
        draws = rs._draws(ranked, [], rs._in_blocks(20), 3).toPandas()
        bits.append(draws["_gaps"].map(len).sum() * 8 / (size * 20))
        hits = [rs._drawn_counts(part, 1, 20).sum(axis=0, dtype=np.int64) for _, part in draws.groupby("_block")]
        assert (np.sum(hits, axis=0) == size).all()
    assert max(bits) < 2.2, bits  # a bit more for every doubling of the group before


def test_draws_of_a_group_larger_than_a_task_are_the_same(spark, monkeypatch):
    people = spark.range(9000).select(F.col("id").alias("person_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    ranked = rs.ranked_persons(people, [], 3)

    def counted():
        parts = rs._draws(ranked, [], [(1, 30), (31, 35)], 3).toPandas().groupby(["stratum", "_block"])
        return {(k, first): rs._drawn_counts(p, first, last) for k, p in parts for first, last in ((1, 30), (31, 35))}

    whole = counted()
    monkeypatch.setattr(rs, "_CELLS", 1000)
    cut = counted()
    assert whole.keys() == cut.keys() and len(whole) == 6
    assert all((whole[k] == cut[k]).all() for k in whole)
    drawn = rs.below(*rs.draw62_numpy(np.arange(1, 3001) * 2 + 1, np.arange(31, 36), 3), 3000)
    assert (whole[(1, 0), 31][:3000] == np.stack([np.bincount(c, minlength=3000) for c in drawn.T], axis=1)).all()


def test_checks_join_the_large_tables_once(spark):
    from tidemark.plans import metric_queries, region_queries, summary_queries
    from tidemark.sources.binding import Bound

    r = Bound(spark, "/root/testdata/sf0.001")
    whole = metric_queries.scores(r).where("split = 'valid'")
    rows = metric_queries.scored(r, "valid")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.drop("sample_id").collect()))
    tables = [rows, metric_queries.dataset_entries(r, "valid"), region_queries.checked_scores(r), summary_queries.task_rows(r)]
    assert not any("lineitem" in file for table in tables for file in table.inputFiles())
    assert {row.split for row in tables[3].select("split").distinct().collect()} == {"valid", "test"}
