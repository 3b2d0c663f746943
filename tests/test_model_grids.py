"""The queries fit the whole grids of the library."""

import pytest
from pyspark.ml.linalg import Vectors

import tidemark.plans as plans
from tidemark.operators import models
from tidemark.plans import model_queries
from tidemark.plans.registry import QUERIES

ROWS = [(i, year, split, i % 2, Vectors.dense([float(i)])) for i, (year, split) in enumerate((y, s) for y in (1997, 1998, 1999) for s in ("train", "valid", "test") for _ in (0, 1))]


class Asked(Exception):
    pass


@pytest.fixture
def asked(spark, monkeypatch):
    """Candidates of the first fit of a query."""
    plans.load_all()
    data = spark.createDataFrame(ROWS, ["person_id", "year", "split", "y", "features"])

    def stop(estimators, *_):
        raise Asked(estimators)

    monkeypatch.setattr(models, "choose", stop)
    monkeypatch.setattr(model_queries, "assembled", lambda r, **_: (data, ["a"], None))

    def first(name):
        with pytest.raises(Asked) as seen:
            QUERIES[name](None)
        return seen.value.args[0]

    return first


def test_trees_forests_and_boosted_trees(asked):
    trees = asked("m02_train_decision_tree")
    assert [(e.getMinInstancesPerNode(), e.getMaxDepth()) for e in trees] == [(n, 30) for n in (10, 25, 100)]
    forests = asked("m03_train_forest")
    assert [(e.getNumTrees(), e.getMinInstancesPerNode(), e.getMaxDepth()) for e in forests] == [(t, n, 30) for t in (10, 25, 100) for n in (10, 25, 100)]


def test_boosted_trees_try_every_prefix_of_three_fits(spark, monkeypatch):
    plans.load_all()
    data = spark.createDataFrame(ROWS, ["person_id", "year", "split", "y", "features"])
    monkeypatch.setattr(model_queries, "assembled", lambda r, **_: (data, ["a"], None))
    asked = []
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda e, rows: asked.append((e.getMaxIter(), e.getMaxDepth())) or e)
    monkeypatch.setattr(models, "first_trees", lambda model, count: (count, model.getMaxDepth()))

    def stop(candidates, *_):
        raise Asked(candidates)

    monkeypatch.setattr(models, "best_of", stop)
    with pytest.raises(Asked) as seen:
        QUERIES["m04_train_boosted"](None)
    assert set(asked) == {(100, d) for d in (3, 6, 10)}
    assert seen.value.args[0] == [(t, d) for t in (10, 25, 100) for d in (3, 6, 10)]


def test_domain_classifier_tries_every_c(asked):
    assert len(asked("x02_domain_classifier")) == len(models.CS)


def test_every_year_has_leaves_coefficients_and_regions(spark, monkeypatch):
    plans.load_all()
    rows = [
        (i, i, year, split, y, (0.2 if i % 3 else 0.8), 0.5, Vectors.dense([float(i % 7), float(i % 5)]))
        for i, (year, split, y, _) in enumerate(
            (year, split, y, k) for year in (1997, 1998, 1999, 2000) for split in ("train", "valid", "test") for y in (0, 1) for k in range(60)
        )
    ]
    data = spark.createDataFrame(rows, ["sample_id", "person_id", "year", "split", "y", "s_prev", "s_curr", "features"])
    monkeypatch.setattr(model_queries, "assembled", lambda r, **_: (data, ["a", "b"], None))
    monkeypatch.setattr(model_queries, "score_samples", lambda r: (data, ["a", "b"]))
    depths = []
    fit = models.train_decision_tree
    monkeypatch.setattr(models, "train_decision_tree", lambda t, v, **k: depths.append(k) or fit(t, v, **k))
    monkeypatch.setattr(model_queries.regions, "region_nonstationarity_check", lambda rows, by, *_: rows.select(*by).distinct())
    for name, column in (("m07_inferential_logreg", "year"), ("m18_tree_leaf_counts", "year"), ("r06_fit_regions", "year"), ("r17_subpopulation_scan", "region_year")):
        assert {r[column] for r in QUERIES[name](None).collect()} == {1997, 1998, 1999, 2000}, name
    assert depths and not any(depths)  # no grid or depth below the library's


def test_robust_features_for_every_two_years(spark, monkeypatch):
    plans.load_all()
    rows = [
        (i, 1, year, split, i % 2, Vectors.dense([float(i % 3)]))
        for i, (year, split, _) in enumerate((y, s, k) for y in (1997, 1998, 1999) for s in ("train", "valid", "test") for k in range(40))
    ]
    data = spark.createDataFrame(rows, ["person_id", "end_date", "year", "split", "y", "features"])
    long = data.select("person_id", "end_date").selectExpr("*", "'a' AS feature")
    monkeypatch.setattr(model_queries, "assembled", lambda r, **_: (data, ["a"], long))
    monkeypatch.setattr(models, "CS", (1.0,))
    found = QUERIES["x21_robust_feature_retrain"](None).collect()
    assert {(r.year, r.feature_set, r.pair) for r in found} == {
        (y, f, p) for y in (1998, 1999) for f in ("all", "stable") for p in ("old on old", "old on new", "new on new")
    }


def test_deep_trees_keep_the_node_of_each_row_and_are_the_same_trees(spark, asked):
    rows = [(float(i % 2 == 0 or i % 3 == 0 or i % 31 == 0), 1.0 + i % 2, Vectors.dense([float(i % k == 0) for k in (2, 3, 5, 7, 11)])) for i in range(800)]
    train = spark.createDataFrame(rows, ["y", "weight", "features"])
    for name in ("m02_train_decision_tree", "m18_tree_leaf_counts", "m03_train_forest"):
        candidates = asked(name)
        assert all(e.getCacheNodeIds() for e in candidates)
        first = candidates[0]
        kept, walked = first.fit(train), first.copy({first.cacheNodeIds: False}).fit(train)
        assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:] and "If" in kept.toDebugString


def test_all_years_are_fitted_side_by_side(spark):
    import threading

    years = spark.range(1996, 2001).selectExpr("CAST(id AS INT) AS year", "'train' AS split")
    together = threading.Barrier(5, timeout=60)

    def build(train, valid, test, year):
        together.wait()  # breaks unless all five are here at once
        return train

    assert model_queries.each_year(years, build).count() == 5


def test_models_and_regions_of_all_years_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    rows = [(year, split, i % 2) for year in (1997, 1998, 1999) for split in ("train", "valid") for i in range(40)] + [(2000, "valid", 0)] * 40
    data = spark.createDataFrame(rows, "year int, split string, y int")
    together = threading.Barrier(3, timeout=60)  # breaks unless all three are here at once

    def fit(train, valid):
        together.wait()
        return train.first()["year"], 0, 0.5

    # the last year has no positives and gets no model
    assert models.models_per_year(data, [1997, 1998, 1999, 2000], fit) == {1997: 1997, 1998: 1998, 1999: 1999}
    monkeypatch.setattr(model_queries, "region_pool", lambda rows, year: None if year == 2000 else rows.where(f"year = {year}"))
    monkeypatch.setattr(models, "train_decision_tree", fit)
    assert list(model_queries.fit_regions(data)) == [1997, 1998, 1999]
