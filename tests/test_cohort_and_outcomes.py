import datetime as dt

from tidemark.operators import cohort, features, outcomes, splits

D = dt.date
FIRST, LAST = D(2019, 1, 1), D(2020, 12, 1)


def test_index_dates_are_month_starts(spark):
    days = [r.index_date for r in cohort.index_dates(spark, D(2019, 11, 1), D(2020, 2, 1)).collect()]
    assert sorted(days) == [D(2019, 11, 1), D(2019, 12, 1), D(2020, 1, 1), D(2020, 2, 1)]


def test_observed_on_includes_both_ends(spark):
    periods = spark.createDataFrame([(1, D(2019, 2, 1), D(2019, 4, 1)), (2, D(2019, 2, 2), D(2019, 2, 27))], "person_id int, period_start date, period_end date")
    rows = {(r.person_id, r.end_date) for r in cohort.observed_on(periods, FIRST, LAST).collect()}
    assert rows == {(1, D(2019, 2, 1)), (1, D(2019, 3, 1)), (1, D(2019, 4, 1))}


def test_coverage_ignores_an_earlier_adjacent_period(spark):
    person = spark.createDataFrame([(1, None), (2, None)], "person_id int, death_date date")
    periods = spark.createDataFrame(
        [(1, D(2018, 1, 1), D(2020, 12, 31)), (2, D(2018, 1, 1), D(2019, 12, 31)), (2, D(2020, 1, 1), D(2020, 12, 31))],
        "person_id int, period_start date, period_end date",
    )
    out = cohort.monthly_eligibility(person, periods, D(2020, 6, 1), D(2020, 6, 1)).collect()
    assert [(r.person_id, r.num_days, r.y) for r in out] == [(1, 366, 0)]


def test_death_before_the_date_counts_and_survivors_need_follow_up(spark):
    person = spark.createDataFrame([(1, D(2020, 2, 1)), (2, None), (3, D(2020, 9, 1))], "person_id int, death_date date")
    periods = spark.createDataFrame(
        [(1, D(2018, 1, 1), D(2020, 3, 15)), (2, D(2018, 1, 1), D(2020, 3, 15)), (3, D(2018, 1, 1), D(2020, 6, 1))],
        "person_id int, period_start date, period_end date",
    )
    out = {r.person_id: (r.y, r.outcome_date) for r in cohort.monthly_eligibility(person, periods, D(2020, 3, 1), D(2020, 3, 1)).collect()}
    assert out == {1: (1, D(2020, 2, 1)), 3: (0, None)}


def _eligible(spark, *dates):
    return spark.createDataFrame([(1, d) for d in dates], "person_id int, end_date date")


def test_label_window_is_open_left_and_closed_right(spark):
    elig = _eligible(spark, D(2020, 1, 1), D(2020, 2, 1))
    for event, expected in ((D(2020, 1, 1), [0, 0]), (D(2020, 1, 2), [1, 0]), (D(2020, 4, 1), [1, 1]), (D(2020, 5, 1), [0, 1]), (D(2020, 5, 2), [0, 0])):
        events = spark.createDataFrame([(1, 7, event)], "person_id int, concept_id int, event_date date")
        rows = outcomes.recurrent_outcome(elig, elig, events, [7]).orderBy("end_date").collect()
        assert [r.y for r in rows] == expected, event


def test_first_diagnosis_drops_months_on_or_after_the_first_event(spark):
    elig = _eligible(spark, D(2020, 1, 1), D(2020, 2, 1), D(2020, 3, 1))
    events = spark.createDataFrame([(1, 7, D(2020, 2, 1)), (1, 7, D(2020, 5, 1))], "person_id int, concept_id int, event_date date")
    rows = outcomes.first_diagnosis_outcome(elig, None, events, [7]).collect()
    assert [(r.end_date, r.y, r.outcome_date) for r in rows] == [(D(2020, 1, 1), 1, D(2020, 2, 1))]


def test_discovery_window_is_closed_on_both_sides(spark):
    elig = _eligible(spark, D(2020, 1, 1))
    concept = spark.createDataFrame([(7, "x")], "concept_id int, concept_name string")
    for event, n in ((D(2020, 1, 1), 1), (D(2020, 4, 1), 1), (D(2020, 4, 2), 0), (D(2019, 12, 31), 0)):
        events = spark.createDataFrame([(1, 7, event)], "person_id int, concept_id int, event_date date")
        assert outcomes.procedure_cohort_counts(elig, events, concept).count() == n, event


def test_feature_window_excludes_the_index_day(spark):
    events = spark.createDataFrame(
        [(1, "on", D(2020, 1, 1)), (1, "before", D(2019, 12, 31)), (1, "edge", D(2019, 12, 2)), (1, "out", D(2019, 12, 1))],
        "person_id int, feature string, event_date date",
    )
    out = features.windowed_features(events, D(2020, 1, 1), D(2020, 1, 1), [30]).collect()
    assert {r.feature for r in out} == {"before", "edge"}


def test_leap_day_gap(spark):
    events = spark.createDataFrame([(1, "f", D(2020, 2, 29))], "person_id int, feature string, event_date date")
    out = features.windowed_features(events, FIRST, LAST, [1, 30]).collect()
    assert {(r.end_date, r.window_days) for r in out} == {(D(2020, 3, 1), 1), (D(2020, 3, 1), 30)}


def test_splits_cover_everybody_once_and_balance_folds(spark):
    rows = [(i, "2020-01-01" if i < 40 else "never") for i in range(140)] + [(1000 + i, "2020-02-01") for i in range(3)]
    strata = spark.createDataFrame(rows, "person_id int, stratum string")
    out = splits.split_people(strata, seed=2).toPandas()
    assert len(out) == 143 and out["person_id"].is_unique
    for stratum, n in (("2020-01-01", 40), ("never", 100)):
        part = out[out["stratum"] == stratum]
        assert part["is_test"].sum() == n // 5
        sizes = part[part["is_test"] == 0]["fold"].value_counts().sort_index().tolist()
        assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    tiny = out[out["stratum"] == "2020-02-01"]
    assert (tiny["is_test"] == 0).all() and (tiny["fold"] == -1).all()


def test_trend_orders_values_of_one_day(spark):
    columns = "example_id int, person_id int, concept_id int, concept_name string, unit string, value double, feature_start_date date, person_end_date date"
    end = D(2020, 12, 1)
    rows = [(0, 1, 5, "c", "u", v, d, end) for v, d in ((3.0, D(2020, 1, 1)), (2.0, D(2020, 1, 5)), (4.0, D(2020, 1, 5)), (None, D(2020, 1, 6)), (4.0, D(2020, 1, 7)))]
    out = features.lab_trend(spark.createDataFrame(rows, columns)).collect()
    assert {(r.concept_name.split(" - ")[-1], r.feature_start_date) for r in out} == {("increasing", D(2020, 1, 5)), ("decreasing", D(2020, 1, 5))}
