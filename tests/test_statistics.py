import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hypothesis as hy
from tidemark.operators import metrics, regions, shift
from tidemark.operators import resampling as rs


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 240
    y = rng.integers(0, 2, n)
    curr = (y * 0.4 + rng.random(n)).round(2)
    prev = (y * 0.1 + rng.random(n)).round(2)
    curr[:90] = 0.5  # a score that many samples share
    pdf = pd.DataFrame({"sample_id": range(n), "person_id": rng.integers(0, 60, n), "year": 2020, "y": y, "s_curr": curr, "s_prev": prev})
    return pdf, spark.createDataFrame(pdf).cache()


def test_auc_matches_pairs_and_flips(frame):
    pdf, df = frame
    got = metrics.auc(df, "s_curr", ["year"]).first()["auc"]
    assert got == pytest.approx(brute_auc(pdf["y"].to_numpy(), pdf["s_curr"].to_numpy()))
    flipped = metrics.auc(df.withColumn("n", -F.col("s_curr")), "n").first()["auc"]
    assert got + flipped == pytest.approx(1)


def test_auc_of_ranks_is_auc_of_scores(frame):
    _, df = frame
    ranked = metrics.normalized_ranks(df, "s_curr", ["year"])
    assert metrics.auc(ranked, "normalized_rank").first()["auc"] == pytest.approx(metrics.auc(df, "s_curr").first()["auc"])


def test_auc_is_null_for_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")
    assert metrics.auc(df).first()["auc"] is None


def test_permutations_by_brute_force_and_in_small_ranges(frame):
    pdf, df = frame
    entries = rs.two_models(df, ["year"])
    whole = rs.permutation_aucs(entries, ["year"], 30, 5).toPandas().set_index("replicate")["auc_diff"].sort_index()
    cut = rs.permutation_aucs(entries, ["year"], 30, 5, rows_per_task=25).toPandas().set_index("replicate")["auc_diff"].sort_index()
    np.testing.assert_allclose(whole, cut)
    from tidemark.functions.expressions import coin, draw62_numpy

    keys = df.select("sample_id", rs.person_key(5).alias("k")).toPandas().set_index("sample_id")["k"].sort_index().to_numpy()
    assert (keys < 1 << 62).all()
    y, a, b = (pdf[c].to_numpy() for c in ("y", "s_curr", "s_prev"))
    for r in (1, 17, 30):
        swap = coin(draw62_numpy(keys, np.array([r]), 5)[1][:, 0]) == 1
        expected = brute_auc(y, np.where(swap, b, a)) - brute_auc(y, np.where(swap, a, b))
        assert whole[r] == pytest.approx(expected)


def test_bootstrap_draws_keep_stratum_sizes(frame):
    _, df = frame
    entries = rs.two_models(df, ["year"])
    draws = rs.bootstrap_draws(rs.ranked_persons(entries, ["year"], 3), ["year"], 1, 50, 3).toPandas()
    strata = entries.groupBy("person_id").agg(F.max("y").alias("s")).toPandas().set_index("person_id")["s"]
    counts = pd.DataFrame([np.frombuffer(w, dtype=np.uint16) for w in draws["weights"]], index=draws["person_id"])
    for s, size in strata.value_counts().items():
        assert (counts[counts.index.map(strata) == s].sum() == size).all()


def test_bootstrap_by_brute_force_and_in_small_ranges(frame, monkeypatch):
    pdf, df = frame
    entries = rs.two_models(df, ["year"])
    whole = rs.bootstrap_aucs(entries, ["year"], 20, 3).toPandas().set_index("replicate").sort_index()
    cut = rs.bootstrap_aucs(entries, ["year"], 20, 3, rows_per_task=30).toPandas().set_index("replicate").sort_index()
    np.testing.assert_allclose(whole["auc_diff"], cut["auc_diff"])
    monkeypatch.setattr(rs, "REPLICATE_BLOCK", 7)
    blocks = rs.bootstrap_aucs(entries, ["year"], 20, 3).toPandas().set_index("replicate").sort_index()
    np.testing.assert_allclose(whole["auc_diff"], blocks["auc_diff"])
    draws = rs.bootstrap_draws(rs.ranked_persons(entries, ["year"], 3), ["year"], 1, 20, 3).toPandas().set_index("person_id")["weights"]
    weights = {p: np.frombuffer(w, dtype=np.uint16) for p, w in draws.items()}
    for r in (1, 20):
        times = pdf["person_id"].map(lambda p: int(weights[p][r - 1]) if p in weights else 0).to_numpy()
        rows = pdf.loc[pdf.index.repeat(times)]
        assert whole.loc[r, "auc_1"] == pytest.approx(brute_auc(rows["y"].to_numpy(), rows["s_curr"].to_numpy()))


def test_p_value_counts_ties_and_adds_one(spark):
    reps = spark.createDataFrame([(2020, i, d) for i, d in enumerate([0.1, 0.2, 0.3, -0.1])], "year int, replicate int, auc_diff double")
    actual = spark.createDataFrame([(2020, 0.2)], "year int, actual_diff double")
    assert rs.permutation_p_value(reps, actual, ["year"]).first()["p_value"] == pytest.approx(3 / 5)


def brute_bh(p, fdr):
    rank = np.array([1 + sum(q < x for q in p) for x in p])
    critical = rank / len(p) * fdr
    passed = rank[p < critical]
    return (rank <= passed.max()).astype(int) if len(passed) else np.zeros(len(p), dtype=int)


@pytest.mark.parametrize("p", [[0.001, 0.02, 0.02, 0.5, 0.04], [0.9, 0.8], [0.01, 0.01, 0.01]])
def test_benjamini_hochberg(spark, p):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    out = hy.benjamini_hochberg(df).orderBy("i").toPandas()
    assert out["accepted"].tolist() == brute_bh(np.array(p), 0.05).tolist()


def test_chi2_with_yates(spark):
    df = spark.createDataFrame([(10, 20, 30, 5), (5, 5, 5, 5), (0, 0, 3, 4)], "a int, b int, c int, d int")
    out = hy.chi2_2x2(df, "a", "b", "c", "d").collect()
    n, gap = 65, abs(10 * 5 - 20 * 30)
    expected = n * (gap - n / 2) ** 2 / (30 * 35 * 40 * 25)
    assert out[0]["chi2"] == pytest.approx(expected)
    assert out[0]["chi2_p_value"] == pytest.approx(math.erfc(math.sqrt(expected / 2)))
    assert out[1]["chi2"] == 0 and out[1]["chi2_p_value"] == 1
    assert out[2]["chi2"] is None and out[2]["chi2_p_value"] is None


def test_check_names_the_first_failing_screen(spark, frame):
    _, df = frame
    rows = df.withColumn("split", F.when(F.col("person_id") % 2 == 0, "valid").otherwise("test"))
    both = rows.unionByName(rows.withColumn("year", F.lit(2021)))
    out = hy.nonstationarity_check(both, [], 10, 1, min_valid=1000).collect()
    assert [(r.year, r.status, r.p_value) for r in out] == [(2021, "few validation outcomes in previous year", None)]
    few_tests = hy.nonstationarity_check(both, [], 10, 1, min_valid=1, min_test=1000).collect()[0]
    assert few_tests.status in ("few test outcomes in current year", "interval not above 0")
    if few_tests.status.startswith("few test"):
        assert few_tests.p_value == 1.0


def test_empty_region_fails_the_size_screen(frame):
    _, df = frame
    rows = df.withColumn("split", F.lit("valid")).withColumn("region", F.lit(0))
    both = rows.unionByName(rows.withColumn("year", F.lit(2021)))
    out = regions.region_nonstationarity_check(both, [], 5, 1, min_valid=1, min_test=1).collect()
    assert [(r.status, r.p_value) for r in out] == [("region size", None)]


def test_best_threshold_falls_back(spark):
    curve = spark.createDataFrame([(0.2, 0.4, 1.0), (0.6, 0.5, 0.5)], "threshold double, precision double, recall double")
    assert metrics.best_threshold(curve, "fpr", 0.1).first()["threshold"] == 1.0
    assert metrics.best_threshold(curve, "fnr", 0.4).first()["threshold"] == 0.2
    assert metrics.best_threshold(curve, "f1").first()["threshold"] == 0.2


def test_recalibration_weight_for_empty_source(spark):
    rates = spark.createDataFrame([("a", 2019, 0.0), ("a", 2020, 0.1), ("b", 2020, 0.0), ("c", 2019, 0.2), ("c", 2020, 0.1)], "g string, year int, rate double")
    out = {r.g: r.weight for r in shift.recalibration_weight(rates, 2019, 2020, ["g"]).collect()}
    assert out == {"a": 2.0, "b": 1.0, "c": 0.5}


def test_correlated_pairs_are_those_of_all_pairs_and_few_are_counted(spark):
    rng = np.random.default_rng(2)
    rows = set()
    for year in (2020, 2021):
        people = np.arange(400)
        for family in range(12):
            base = set(rng.choice(people, rng.integers(2, 300), replace=False).tolist())
            for member in range(4):
                drop = set(rng.choice(sorted(base), rng.integers(0, 1 + len(base) // 20), replace=False).tolist())
                more = set(rng.choice(people, rng.integers(0, 4), replace=False).tolist())
                rows |= {(p, 0, year, f"f{family:02d}_{member}") for p in (base - drop) | more}
        rows |= {(p, 0, year, "all") for p in people.tolist()} | {(1, 0, year, "rare"), (1, 0, year, "rare too")}
    long = spark.createDataFrame(sorted(rows), "person_id int, end_date int, year int, feature string")
    samples = spark.createDataFrame([(p, 0, y) for p in range(400) for y in (2020, 2021)], "person_id int, end_date int, year int")
    names = long.select("feature").distinct()
    sets = {}
    for p, _, year, f in rows:
        sets.setdefault((year, f), set()).add(p)
    pairs = [(y, a, b) for (y, a) in sets for (z, b) in sets if y == z and a < b]

    def phi(y, a, b):
        f, g, common = len(sets[y, a]), len(sets[y, b]), len(sets[y, a] & sets[y, b])
        spread = f * (400 - f) * g * (400 - g)
        return (400 * common - f * g) / spread**0.5 if spread else 0

    for gap, r in ((100, 0.95), (3, 0.8), (1000, 0.5)):
        expected = {(y, a, b): len(sets[y, a] & sets[y, b]) for y, a, b in pairs if phi(y, a, b) > r and abs(len(sets[y, a]) - len(sets[y, b])) <= gap}
        found = shift.correlated_pairs(long, samples, names, gap, r).collect()
        assert {(x.year, *sorted((x.feature_1, x.feature_2))): x.n_both for x in found} == expected
        assert all((-len(sets[x.year, x.feature_1]), x.feature_1) < (-len(sets[x.year, x.feature_2]), x.feature_2) for x in found)
    sizes = samples.groupBy("year").count().withColumnRenamed("count", "n")
    counted = shift.candidate_pairs(shift.feature_prefixes(long, sizes, 100, 0.95, "year"), 100, 0.95, "year").count()
    assert counted < sum(bool(sets[y, a] & sets[y, b]) for y, a, b in pairs) / 4


def test_prune_keeps_a_feature_whose_better_partner_is_out(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "feature string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "feature_1 string, feature_2 string")
    sizes = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 7)], "feature string, f int")
    kept = {r.feature for r in shift.correlated_pairs_prune(names, pairs, sizes).collect()}
    assert kept == {"a", "c", "d"}


def test_prune_ends_when_the_order_of_two_features_flips_between_years(spark):
    names = spark.createDataFrame([("a",), ("b",)], "feature string")
    pairs = spark.createDataFrame([(1998, "a", "b"), (1999, "b", "a")], "year int, feature_1 string, feature_2 string")
    sizes = spark.createDataFrame([("a", 5), ("b", 7), ("a", 7), ("b", 6)], "feature string, f int")
    assert [r.feature for r in shift.correlated_pairs_prune(names, pairs, sizes).collect()] == ["b"]


def test_chi2_tail_is_accurate_and_needs_no_python(spark):
    xs = [0.0, 1e-6, 0.1, 1.0, 3.841458820694124, 10.0, 50.0, 300.0, 1200.0]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").withColumn("p", hy.chi2_p_value("x"))
    got = {r.x: r.p for r in df.collect()}
    for x in xs:
        assert math.isclose(got[x], math.erfc(math.sqrt(x / 2)), rel_tol=1e-10, abs_tol=1e-250)
    assert got[None] is None
    assert "Python" not in df._jdf.queryExecution().toString()


def test_appearing_coefficients_by_prefix_and_word(spark):
    before = spark.createDataFrame([("1 - condition - Asthma severe - 30 days", 0.2), ("9 - drug - metformin 5 mg tablet - 30 days", 0.3)], "feature string, coefficient double")
    after = spark.createDataFrame(
        [
            ("1 - condition - Asthma severe - 365 days", 0.9),
            ("2 - condition - Gout - 30 days", 0.8),
            ("3 - drug - metformin oral - 30 days", 0.7),
            ("4 - drug - insulin tablet - 30 days", 0.6),
            ("5 - condition - Rash - 30 days", 0.0005),
        ],
        "feature string, coefficient double",
    )
    out = {r.name for r in shift.appearing_coefficients(before, after, 10).collect()}
    assert out == {"gout", "insulin tablet"}
