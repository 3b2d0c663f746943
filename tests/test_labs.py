import datetime as dt

from tidemark.operators import labs

D = dt.date(2020, 1, 1)
MEAS = "person_id int, concept_id bigint, event_date date, value double, unit string, range_low double, range_high double"


def test_mode_prefers_lowest_low_and_highest_high(spark):
    rows = [(1, 5, D, 1.0, "u", low, high) for low, high in ((2.0, 8.0), (2.0, 8.0), (3.0, 9.0), (3.0, 9.0), (4.0, 7.0))]
    df = spark.createDataFrame(rows, MEAS)
    low = labs.most_frequent_reference(labs.reference_counts(df, "low"), "low", min_count=2).first()
    high = labs.most_frequent_reference(labs.reference_counts(df, "high"), "high", min_count=2).first()
    assert (low.range_low, high.range_high) == (2.0, 9.0)


def test_zero_rule(spark):
    rows = [(1, 1, D, v, "u", None, None) for v in (0.0, 9.0)] + [(1, 2, D, v, "u", None, None) for v in (0.0, 9.0, -1.0)]
    rows += [(1, 3, D, v, "u", None, None) for v in (0.0, 9.0)]
    low = spark.createDataFrame([(3, 1.0)], "concept_id bigint, range_low double")
    df = spark.createDataFrame(rows, MEAS)
    flagged = labs.zero_is_missing(df, low)
    assert [r.concept_id for r in flagged.collect()] == [1]
    cleaned = labs.null_out_zeros(df, flagged).where("concept_id = 1").collect()
    assert sorted(str(r.value) for r in cleaned) == ["9.0", "None"]


def test_borrow_takes_the_best_near_donor(spark):
    need = spark.createDataFrame([(1, "Serum level one")], "concept_id bigint, concept_name string")
    donors = spark.createDataFrame(
        [(2, "serum LEVEL one b", 3.0, 10), (3, "Serum level one c", 4.0, 10), (4, "Serum level one d", 9.0, 99), (5, "Plasma level one", 1.0, 500)],
        "concept_id bigint, concept_name string, range_low double, reference_count bigint",
    )
    averages = spark.createDataFrame([(1, 20.0), (2, 24.0), (3, 15.0), (4, 26.0), (5, 20.0)], "concept_id bigint, avg_value double")
    out = labs.borrow_reference(need, donors, averages, "low").collect()
    assert [(r.concept_id, r.similar_concept_id, r.range_low) for r in out] == [(1, 2, 3.0)]


def test_null_units_never_match_but_stay_as_cells(spark):
    cells = spark.createDataFrame([(1, None, "range 1: <= 30", "M", "c"), (1, "u", "range 1: <= 30", "M", "c")], "concept_id bigint, unit string, age_range string, gender_source_value string, concept_name string")
    own = spark.createDataFrame([(1, "u", "range 1: <= 30", "M")], "concept_id bigint, unit string, age_range string, gender_source_value string")
    left = labs.without_reference(cells, own, labs.CELL).collect()
    assert [r.unit for r in left] == [None]


def test_adjacent_band_looks_down_first(spark):
    bands = ["range 1: <= 30", "range 2: 31 - 50", "range 3: 51 - 70", "range 4: > 70"]
    cells = spark.createDataFrame([(1, "u", b, "M", "c") for b in bands], "concept_id bigint, unit string, age_range string, gender_source_value string, concept_name string")
    found = spark.createDataFrame(
        [(1, "u", bands[1], "M", "c", -1, "", 2.0, 0), (1, "u", bands[3], "M", "c", -1, "", 4.0, 0)],
        "concept_id bigint, unit string, age_range string, gender_source_value string, concept_name string, "
        "similar_concept_id bigint, similar_concept_name string, range_low double, from_opposite_gender int",
    )
    out = {r.age_range: (r.range_low, r.from_different_age_range) for r in labs.fill_from_adjacent_band(cells, found, "low").collect()}
    assert out == {bands[0]: (2.0, 1), bands[1]: (2.0, 0), bands[2]: (2.0, 1), bands[3]: (4.0, 0)}


def test_out_of_range_bounds_are_open_and_units_must_match(spark):
    rows = [(1, 5, D, v, u, None, None) for v, u in ((2.0, "u"), (1.9, "u"), (45.1, "u"), (1.0, "w"), (None, "u"), (1.0, None))]
    bounds = spark.createDataFrame([(5, "u", 2.0, None)], "concept_id bigint, unit string, lower_bound double, upper_bound double")
    out = labs.drop_out_of_range(spark.createDataFrame(rows, MEAS), bounds).collect()
    assert sorted((str(r.value), str(r.unit)) for r in out) == sorted([("2.0", "u"), ("45.1", "u"), ("1.0", "w"), ("None", "u"), ("1.0", "None")])
