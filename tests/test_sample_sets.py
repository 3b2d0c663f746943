"""Features of samples come as arrays: no row per date and feature travels, and a grid is scored in one scan."""

import datetime as dt
import random

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators import features, models
from tidemark.session import materialize


def test_sets_by_brute_force(spark):
    rng = random.Random(5)
    start = dt.date(2020, 1, 1)
    rows = [(rng.randrange(5), rng.choice(["a", "b", None]), start + dt.timedelta(rng.choice([rng.randrange(900), 31, 60]))) for _ in range(200)]
    dates = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(2, 30)]
    # person 9 has no events, person 4 no samples
    samples = [(p, d, d.year, "train", 0) for p in (0, 1, 2, 3, 9) for d in dates if p or d.month % 2]
    events = spark.createDataFrame(rows, "person_id int, feature string, event_date date")
    sampled = spark.createDataFrame(samples, "person_id int, end_date date, year int, split string, y int")
    sets = features.sample_sets(sampled, events, (30, 365))
    expected = {
        (p, d): sorted({f"{f} - {w} days" for q, f, e in rows for w in (30, 365) if q == p and f and 1 <= (d - e).days <= w}) for p, d, *_ in samples
    }
    got = sets.collect()
    assert len(got) == len(samples) and {(r["person_id"], r["end_date"]): sorted(r["present"]) for r in got} == expected
    long = features.one_per_feature(sets).select("person_id", "end_date", "feature").collect()
    assert sorted(map(tuple, long)) == sorted((*k, f) for k, names in expected.items() for f in names)
    # dates multiply no rows before the last step
    assert "Generate" not in sets._jdf.queryExecution().optimizedPlan().toString()


def test_a_grid_is_scored_in_one_scan(spark, monkeypatch):
    rows = [(i % 2, Vectors.dense([float(i % 5), float(i % 3)])) for i in range(60)]
    data = materialize(spark.createDataFrame(rows, ["y", "features"]))
    fitted = [LogisticRegression(labelCol="y", regParam=c, maxIter=5).fit(data) for c in (0.01, 1.0, 0.01)]
    plans = []
    exact = models.auc

    def seen(scores, *rest):
        plans.append(scores._jdf.queryExecution().optimizedPlan().toString())
        return exact(scores, *rest)

    monkeypatch.setattr(models, "auc", seen)
    best, position, found = models.best_of(fitted, data)
    alone = [exact(models.score(m, data), "score").first()["auc"] for m in fitted]
    assert found == max(alone) and position == alone.index(max(alone)) and best is fitted[position]
    assert plans[0].count("Relation [") == 1


def test_filed_rows_keep_their_columns_and_types(spark):
    df = spark.createDataFrame([(1, 1998, "train", 0), (2, 1999, "test", 1), (3, 1998, "test", 1)], "person_id int, year int, split string, y int")
    filed = materialize(df, by=("year", "split"))
    assert filed.schema == df.schema and sorted(filed.collect()) == sorted(df.collect())
    assert [r["person_id"] for r in filed.where(F.col("year") == 1999).collect()] == [2]


def test_pairs_of_all_features_need_no_join_of_samples_with_their_sizes(spark):
    from tidemark.operators import shift

    rows = [(p, 0, 2020, f) for p in range(40) for f in ("a", "b") if p % 2] + [(p, 0, 2020, "c") for p in range(1, 22)]
    long = materialize(spark.createDataFrame(rows, "person_id int, end_date int, year int, feature string"))
    samples = spark.createDataFrame([(p, 0, 2020) for p in range(40)], "person_id int, end_date int, year int")
    found = {tuple(r)[:4] for r in shift.correlated_pairs(long, samples, None).collect()}
    assert found == {tuple(r)[:4] for r in shift.correlated_pairs(long, samples, long.select("feature").distinct()).collect()} == {(2020, "a", "b", 20)}


def test_robust_sets_are_cut_from_the_vectors_and_every_year_is_inferred_once(spark, monkeypatch):
    from tidemark import plans
    from tidemark.plans import model_queries
    from tidemark.plans.registry import QUERIES

    plans.load_all()
    rows = [
        (i, 1, year, split, int(i % 2 == 0), Vectors.dense([float(i % 3), float(i % 2 == 0 and i % 5 > 0)]))
        for i, (year, split, _) in enumerate((y, s, k) for y in (1997, 1998, 1999) for s in ("train", "valid", "test") for k in range(40))
    ]
    data = spark.createDataFrame(rows, ["person_id", "end_date", "year", "split", "y", "features"])
    # features of the samples as rows are not needed: they would be grouped and joined again for every pair of years
    monkeypatch.setattr(model_queries, "assembled", lambda r, **_: (data, ["a", "b"], None))
    monkeypatch.setattr(models, "CS", (1.0,))
    inferred, seen = [], models.inferential_logreg
    monkeypatch.setattr(models, "inferential_logreg", lambda train, names: inferred.append(1) or seen(train, names))
    found = QUERIES["x21_robust_feature_retrain"](None).collect()
    assert len(inferred) == 3 and {r.year for r in found} == {1998, 1999} and {"all", "stable"} <= {r.feature_set for r in found}


def test_sets_of_persons_over_many_batches(spark):
    """Persons that fill several batches, rows without person or date, repeated samples, and keys of text."""
    start = dt.date(2020, 1, 1)
    events = [(p, f"f{k % 7}", start + dt.timedelta(k * 11 % 800)) for p in ("a", "b", "c") for k in range(90)]
    events += [(None, "f0", start), ("a", None, start), ("b", "f1", None)]
    dates = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(30)]
    samples = [(p, d, n) for p in ("a", "b", "z", None) for d in (*dates, None) for n in range(2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        sets = features.sample_sets(
            spark.createDataFrame(samples, "person_id string, end_date date, n int"), spark.createDataFrame(events, "person_id string, feature string, event_date date"), (365, 30)
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def expected(p, d):
        return sorted({f"{f} - {w} days" for q, f, e in events for w in (30, 365) if p and d and e and f and q == p and 1 <= (d - e).days <= w})

    assert sorted(map(str, ((r.person_id, r.end_date, r.n) for r in sets))) == sorted(map(str, samples))
    assert all(sorted(r.present) == expected(r.person_id, r.end_date) for r in sets)


def test_features_of_a_sample_are_picked_without_testing_all_events_of_the_person(spark):
    sampled = spark.createDataFrame([(1, dt.date(2020, 2, 1))], "person_id int, end_date date")
    events = spark.createDataFrame([(1, "a", dt.date(2020, 1, 5))], "person_id int, feature string, event_date date")
    plan = features.sample_sets(sampled, events, (30,))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Join" not in plan


def test_subpopulations_are_cut_from_the_arrays_of_the_samples(spark):
    from tidemark.operators import shift

    present = {0: [], 1: ["a"], 2: ["a", "b"], 3: ["b", "c"], 4: ["c", "b", "a"]}
    sets = spark.createDataFrame([(p, 0, f) for p, f in present.items()], "person_id int, end_date int, present array<string>")
    long = features.one_per_feature(sets)
    for asked in (("a", "b"), ("c",), ("a", "a"), ("x", "a")):
        for relation in ("AND", "OR"):
            for complement in (False, True):
                cut, joined = (
                    sorted(r.person_id for r in shift.subpopulation_filter(sets, rows, asked, relation, complement=complement).collect()) for rows in (None, long)
                )
                assert cut == joined
