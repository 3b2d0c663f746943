import duckdb
import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import ranking
from tidemark.functions import expressions as ex
from tidemark.functions.expressions import hash32, mix, mix_numpy


def test_hash_rank_is_dense_and_complete(spark):
    df = spark.range(500).select(F.col("id").alias("person_id"), (F.col("id") % 7 == 0).cast("string").alias("g"))
    out = ranking.hash_rank(df, ["person_id"], by=["g"], seed=3, buckets=16).toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert set(part["group_size"]) == {len(part)}


def test_hash_rank_does_not_depend_on_buckets(spark):
    df = spark.range(300).withColumnRenamed("id", "person_id")
    few = ranking.hash_rank(df, ["person_id"], seed=1, buckets=2).toPandas().set_index("person_id")["rank"]
    many = ranking.hash_rank(df, ["person_id"], seed=1, buckets=64).toPandas().set_index("person_id")["rank"]
    assert few.sort_index().equals(many.sort_index())


def test_running_sums_in_ranges_equal_one_window(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "x": rng.normal(size=400).round(3), "n": rng.integers(1, 9, 400)})
    pdf = pdf.groupby(["g", "x"], as_index=False)["n"].sum()
    df = spark.createDataFrame(pdf)
    key = ["g", "x"]
    whole = ranking.running_sums(df, "x", ["n"], ["g"]).toPandas().sort_values(key).reset_index(drop=True)
    parts = ranking.running_sums(df, "x", ["n"], ["g"], rows_per_range=20).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, parts[whole.columns], check_dtype=False)
    expected = whole.groupby("g")["n"].cumsum() - whole["n"]
    assert (whole["n_below"] == expected).all()


def test_null_groups_stay_together(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 4)], "g string, x double, n int")
    for rows in (None, 1):
        out = ranking.running_sums(df, "x", ["n"], ["g"], rows_per_range=rows).toPandas()
        assert out[out["g"].isna()].sort_values("x")["n_below"].tolist() == [0, 2]


def test_string_date_and_null_keys_are_ranked(spark):
    for kind, values in (("string", ["b", None, "a10", "a9"]), ("date", ["2001-01-02", "1999-05-05", None]), ("boolean", [True, False])):
        df = spark.createDataFrame([(v if v is None else str(v),) for v in values], "x string").select(F.col("x").cast(kind), F.lit(2).alias("n"))
        for rows in (None, 1):
            out = ranking.running_sums(df, "x", ["n"], rows_per_range=rows).orderBy(F.col("x").asc_nulls_first()).collect()
            assert [r.n_below for r in out] == [2 * i for i in range(len(values))]


def test_ordered_index_follows_key_order(spark):
    df = spark.createDataFrame([(5, 2), (1, 9), (5, 1), (3, 4)], "person_id int, end_date int")
    out = ranking.ordered_index(df, "person_id", ["end_date"]).orderBy("example_id").collect()
    assert [(r.person_id, r.end_date) for r in out] == [(1, 9), (3, 4), (5, 1), (5, 2)]
    assert [r.example_id for r in out] == [0, 1, 2, 3]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40))
def test_exact_percentiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    out = ranking.exact_percentiles(df, "x", [0.0, 0.2, 0.5, 0.8, 1.0]).toPandas().sort_values("probability")
    np.testing.assert_allclose(out["percentile"], np.percentile(values, [0, 20, 50, 80, 100]))


def test_mix_is_the_same_in_spark_and_numpy(spark):
    rows = spark.range(1, 200).select((hash32(4, "id") % 2147483647).alias("k"), "id")
    drawn = rows.select("k", "id", mix(F.col("k"), F.col("id"), 9).alias("m")).toPandas()
    for k, r, m in drawn.itertuples(index=False):
        assert mix_numpy(np.array([k]), np.array([r]), 9)[0, 0] == m
    coins = (mix_numpy(np.arange(1, 2000), np.arange(1, 50), 9) >> 9) & 1
    assert abs(coins.mean() - 0.5) < 0.01


def test_draws_are_the_same_in_spark_numpy_and_sql(spark):
    keys = spark.range(300).select("id", ex.key62(5, "id").alias("k"), (F.col("id") % 7 + 1).alias("r"))
    rows = keys.select("id", "k", "r", *[c.alias(n) for c, n in zip(ex.draw62(F.col("k"), F.col("r"), 9), ("a", "b"))]).toPandas()
    db = duckdb.connect()
    db.register("given", rows[["id", "r"]])
    table = f"(SELECT *, {ex.key62_sql(5, 'id')} AS k FROM given)"
    found = db.execute(f"SELECT id, k, draw_1 AS a, draw_2 AS b, {ex.below_sql('1000003')} AS n FROM {ex.draw62_sql(table, 'k', 'r', 9)} ORDER BY id").df()
    assert (found[["k", "a", "b"]].to_numpy() == rows.sort_values("id")[["k", "a", "b"]].to_numpy()).all()
    for k, r, a, b, n in zip(rows.k, rows.r, rows.a, rows.b, found.n):
        first, second = ex.draw62_numpy(np.array([k]), np.array([r]), 9)
        assert (first[0, 0], second[0, 0]) == (a, b)
        assert ex.below(int(a), int(b), 1000003) == n == (int(a) * 2**31 + int(b)) * 1000003 >> 62


def test_no_two_of_a_million_keys_share_their_draws(spark):
    keys = spark.range(1_000_000).select(ex.key62(3, "id").alias("k")).toPandas()["k"].to_numpy()
    assert len(np.unique(keys)) == len(keys)
    first, second = ex.draw62_numpy(keys, np.arange(1, 2), 11)
    whole = first[:, 0] * 2**31 + second[:, 0]
    assert len(np.unique(whole)) == len(whole)
    coins = ex.coin(ex.draw62_numpy(keys[:20000], np.arange(1, 65), 11)[1])
    assert abs(coins.mean() - 0.5) < 0.002 and len(np.unique(coins, axis=0)) == 20000
    drawn = np.bincount(ex.below(first, second, 10).ravel(), minlength=10)
    assert abs(drawn / len(keys) - 0.1).max() < 0.002
