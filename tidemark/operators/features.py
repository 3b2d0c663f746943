"""Dated events, windowed binary features, and the feature catalogue.

A windowed feature is 1 at an index date d if any of its events lies in
[d - W, d). Each event is expanded to the month starts it can serve, and only
the smallest gap per (person, date, feature) is kept: all windows come from one
shuffle, and repeated events collapse before dates are multiplied.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import age_band, month_starts
from tidemark.functions.ranking import exact_percentiles, hash_rank
from tidemark.session import materialize

SEPARATOR = " - "

# The states of a measurement, as they appear in feature names.
QUARTILE_NAMES = ("below 25th percentile", "25th to 50th percentile", "50th to 75th percentile", "above 75th percentile")
TREND_NAMES = ("increasing", "decreasing")
RANGE_NAMES = ("below range", "in range", "above range")
ORDERED_NAME = "ordered"

_NO_DAY = -(1 << 30)  # days since 1970, earlier than any date


# ----------------------------------------------------------- dated events


def _event_name(kind: str) -> Column:
    return F.concat_ws(SEPARATOR, F.col("concept_id").cast("string"), F.lit(kind), F.col("concept_name"))


def dated_events(cohort: DataFrame, events: DataFrame, concept: DataFrame, kind: str) -> DataFrame:
    """Events of the cohort up to each person's end date, with a composed feature name."""
    people = cohort.select("example_id", "person_id", F.col("end_date").alias("person_end_date"))
    names = concept.select("concept_id", "concept_name")
    joined = events.select("person_id", "concept_id", F.col("event_date").alias("feature_start_date")).join(people, "person_id")
    return (
        joined.where(F.col("feature_start_date") <= F.col("person_end_date"))
        .join(names, "concept_id")
        .select("example_id", "person_id", _event_name(kind).alias("concept_name"), "feature_start_date", "person_end_date")
    )


def condition_events(cohort: DataFrame, events: DataFrame, concept: DataFrame) -> DataFrame:
    return dated_events(cohort, events, concept, "condition")


def drug_events(cohort: DataFrame, events: DataFrame, concept: DataFrame) -> DataFrame:
    return dated_events(cohort, events, concept, "drug")


def procedure_events(cohort: DataFrame, events: DataFrame, concept: DataFrame) -> DataFrame:
    return dated_events(cohort, events, concept, "procedure")


def specialty_events(cohort: DataFrame, visits: DataFrame, provider: DataFrame, concept: DataFrame) -> DataFrame:
    by_specialty = visits.join(provider, "provider_id").select(
        "person_id", F.col("specialty_concept_id").alias("concept_id"), F.col("visit_start_date").alias("event_date")
    )
    return dated_events(cohort, by_specialty, concept, "specialty")


def static_year_of_birth(cohort: DataFrame, person: DataFrame) -> DataFrame:
    people = person.select("person_id", "year_of_birth")
    return cohort.join(people, "person_id").select(
        "example_id", "person_id", F.col("year_of_birth").alias("ntmp_val"), F.lit("year_of_birth").alias("concept_name")
    )


def static_flags(cohort: DataFrame, person: DataFrame, column: str, labels: dict[str, object]) -> DataFrame:
    """One 0/1 row per label: whether the person's attribute equals the labelled value."""
    people = person.where(F.col(column).isNotNull()).select("person_id", column)
    flag = F.explode(
        F.array(
            *[
                F.struct((F.col(column) == value).cast("int").alias("ntmp_val"), F.lit(name).alias("concept_name"))
                for name, value in labels.items()
            ]
        )
    ).alias("flag")
    return cohort.join(people, "person_id").select("example_id", "person_id", flag).select("example_id", "person_id", "flag.*")


# ---------------------------------------------------------- measurements


def cohort_measurements(cohort: DataFrame, measurement: DataFrame, concept: DataFrame) -> DataFrame:
    people = cohort.select("example_id", "person_id", F.col("end_date").alias("person_end_date"))
    return (
        measurement.join(people, "person_id")
        .where(F.col("event_date") <= F.col("person_end_date"))
        .join(concept.select("concept_id", "concept_name"), "concept_id")
        .withColumnRenamed("event_date", "feature_start_date")
    )


def _lab_name(state: str | Column) -> Column:
    tail = F.lit(state) if isinstance(state, str) else state
    return F.concat_ws(SEPARATOR, F.col("concept_id").cast("string"), F.lit("lab"), F.col("concept_name"), tail)


LAB_EVENT = ("example_id", "person_id", "concept_name", "feature_start_date", "person_end_date")


def _lab_event(rows: DataFrame, state: str | Column) -> DataFrame:
    return rows.withColumn("concept_name", _lab_name(state)).select(*LAB_EVENT).distinct()


def lab_ordered(measured: DataFrame) -> DataFrame:
    return _lab_event(measured, ORDERED_NAME)


def lab_quartiles(measured: DataFrame) -> DataFrame:
    """Discrete quartiles per concept and unit, from counts of distinct values."""
    keys = ["concept_id", "unit"]
    long = exact_percentiles(measured, "value", [0.25, 0.5, 0.75], by=keys, discrete=True)
    return long.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("percentile"))).alias(f"p{round(p * 100)}")
            for p in (0.25, 0.5, 0.75)
        ]
    )


def quartile_state() -> Column:
    value = F.col("value")
    return (
        F.when(value < F.col("p25"), QUARTILE_NAMES[0])
        .when(value < F.col("p50"), QUARTILE_NAMES[1])
        .when(value < F.col("p75"), QUARTILE_NAMES[2])
        .when(value >= F.col("p75"), QUARTILE_NAMES[3])
    )


def with_quartiles(measured: DataFrame, quartiles: DataFrame, how: str = "inner") -> DataFrame:
    return measured.join(quartiles, ["concept_id", "unit"], how)


def lab_quartile_bucket(measured: DataFrame, quartiles: DataFrame) -> DataFrame:
    rows = with_quartiles(measured.where("value IS NOT NULL"), quartiles)
    return _lab_event(rows, quartile_state())


def lab_trend(measured: DataFrame) -> DataFrame:
    """Rising or falling against the previous value of the same example and concept.

    Values of one day are taken in ascending order, so a day is described by its
    smallest and largest value: rows shrink to one per day before the window, and
    a person with very many values has at most one row per day in it.
    """
    days = (
        measured.where("value IS NOT NULL")
        .groupBy("example_id", "person_id", "concept_id", "concept_name", "feature_start_date", "person_end_date")
        .agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
    )
    before = F.lag("highest").over(Window.partitionBy("example_id", "concept_id").orderBy("feature_start_date"))
    states = F.array(
        F.when((F.col("lowest") > F.col("before")) | (F.col("highest") > F.col("lowest")), TREND_NAMES[0]),
        F.when(F.col("lowest") < F.col("before"), TREND_NAMES[1]),
    )
    rows = days.withColumn("before", before).withColumn("state", F.explode(F.array_compact(states)))
    return rows.withColumn("concept_name", _lab_name(F.col("state"))).select(*LAB_EVENT)


def range_state() -> Column:
    """Below, in or above the range; with one bound missing only the other side can be left."""
    value, low, high = F.col("value"), F.col("range_low"), F.col("range_high")
    return F.when(value < low, RANGE_NAMES[0]).when(value > high, RANGE_NAMES[2]).when(
        low.isNotNull() | high.isNotNull(), RANGE_NAMES[1]
    )


def with_ranges(measured: DataFrame, person: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    cell = ["concept_id", "unit", "gender_source_value", "age_range"]
    people = person.select("person_id", "year_of_birth", "gender_source_value")
    rows = (
        measured.drop("range_low", "range_high")
        .join(people, "person_id")
        .withColumn("age_range", age_band("feature_start_date", "year_of_birth"))
    )
    # a cell has one low and one high bound, so the two tables meet first and the rows are joined once
    bounds = low.select(*cell, "range_low").distinct().join(high.select(*cell, "range_high").distinct(), cell, "full")
    return rows.join(bounds, cell, "left")


def lab_range_state(measured: DataFrame, person: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    rows = with_ranges(measured.where("value IS NOT NULL"), person, low, high)
    return _lab_event(rows.withColumn("state", range_state()).where("state IS NOT NULL"), F.col("state"))


def lab_features(
    measured: DataFrame, person: DataFrame, quartiles: DataFrame, low: DataFrame, high: DataFrame
) -> DataFrame:
    """All measurement features: one pass gives ordered, quartile and range states; trends follow."""
    rows = with_quartiles(with_ranges(measured, person, low, high), quartiles, "left")
    valued = F.col("value").isNotNull()
    states = F.array_compact(
        F.array(F.lit(ORDERED_NAME), F.when(valued, quartile_state()), F.when(valued, range_state()))
    )
    listed = _lab_event(rows.withColumn("state", F.explode(states)), F.col("state"))
    return listed.unionByName(lab_trend(measured))


# ------------------------------------------------------------- timelines


def event_timeline(parts: Sequence[DataFrame]) -> DataFrame:
    """All dated features in one long table."""
    timeline = parts[0]
    for part in parts[1:]:
        timeline = timeline.unionByName(part)
    return timeline


def name_part(position: int, name: str | Column = "concept_name") -> Column:
    return F.element_at(F.split(F.col(name) if isinstance(name, str) else name, SEPARATOR), position)


def feature_index(events: DataFrame, name: str = "concept_name", seed: int = 0) -> DataFrame:
    """Dense 0-based id per feature name, with the type parsed from the name."""
    names = events.select(F.col(name).alias("feature")).distinct()
    ranked = hash_rank(names, ["feature"], seed=seed)
    return ranked.select("feature", name_part(2, "feature").alias("type"), (F.col("rank") - 1).alias("feature_id"))


def coordinate_tensor(timeline: DataFrame, index: DataFrame) -> DataFrame:
    """Binary person x time x feature coordinates as long rows."""
    cells = timeline.select("person_id", "feature_start_date", F.col("concept_name").alias("feature")).distinct()
    return cells.join(index, "feature").select("person_id", F.col("feature_start_date").alias("event_date"), "feature_id")


def serving_events(events: DataFrame, max_days: int, keep: Sequence[str] = ("feature",)) -> DataFrame:
    """The latest event of each month, with the last date it serves: that of the next event of its feature, or ``max_days`` later."""
    latest = events.groupBy("person_id", *keep, F.trunc("event_date", "month").alias("_month")).agg(F.max("event_date").alias("event_date"))
    following = F.lead("event_date").over(Window.partitionBy("person_id", *keep).orderBy("event_date"))
    return latest.withColumn("until", F.least(F.date_add("event_date", max_days), following))  # least passes over null


def smallest_gaps(
    events: DataFrame, first: dt.date, last: dt.date, max_days: int, keep: Sequence[str] = ("feature",)
) -> DataFrame:
    """Days from the latest event of a feature to each index date within reach.

    Index dates are month starts, so of the events of one calendar month only the
    latest can be nearest to any of them: the others go before dates are multiplied.
    An event serves the dates up to the next event of its feature, so every date and
    feature comes out of one event and needs no second grouping.
    """
    latest = serving_events(events, max_days, keep)
    reach = month_starts(F.date_add("event_date", 1), F.col("until"), first, last)
    rows = latest.withColumn("_dates", reach).select("person_id", *keep, "event_date", F.explode("_dates").alias("end_date"))
    return rows.select("person_id", "end_date", *keep, F.datediff("end_date", "event_date").alias("gap"))


def windowed_features(
    events: DataFrame, first: dt.date, last: dt.date, windows: Sequence[int], keep: Sequence[str] = ("feature",)
) -> DataFrame:
    """Features present in [date - W, date) for each window length W in days."""
    gaps = smallest_gaps(events, first, last, max(windows), keep)
    fitting = F.array_compact(F.array(*[F.when(F.col("gap") <= w, F.lit(w)) for w in windows]))
    return gaps.select("person_id", "end_date", *keep, F.explode(fitting).alias("window_days"))


def age_at(index_date: str, year_of_birth: str) -> Column:
    return F.year(F.col(index_date)) - F.col(year_of_birth)


def month_one_hot(index_date: str) -> list[Column]:
    return [(F.month(F.col(index_date)) == m).cast("int").alias(f"month_{m}") for m in range(1, 13)]


def window_name(name: str = "feature", window: str = "window_days") -> Column:
    return F.concat(F.col(name), F.lit(SEPARATOR), F.col(window).cast("string"), F.lit(" days"))


def parse_feature_name(name: str = "feature") -> list[Column]:
    """id, type, concept name, measurement variant and window from a composed name."""
    parts = F.split(F.col(name), SEPARATOR)
    windowed = F.element_at(parts, -1).rlike(r"^\d+ days$")
    body = F.when(windowed, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    is_lab = F.element_at(parts, 2) == "lab"
    variant = F.when(is_lab & (F.size(body) > 3), F.element_at(body, -1))
    concept_end = F.when(variant.isNotNull(), F.size(body) - 3).otherwise(F.size(body) - 2)
    return [
        F.element_at(parts, 1).cast("bigint").alias("concept_id"),
        F.element_at(parts, 2).alias("type"),
        F.array_join(F.slice(body, F.lit(3), concept_end), SEPARATOR).alias("concept_name"),
        variant.alias("variant"),
        F.when(windowed, F.regexp_extract(F.element_at(parts, -1), r"^(\d+)", 1).cast("int")).alias("window_days"),
    ]


# ---------------------------------------------------------- sample features


def sample_features(samples: DataFrame, features: DataFrame) -> DataFrame:
    """Attach windowed features to samples, one row per present feature."""
    return samples.join(features, ["person_id", "end_date"])


def sample_sets(samples: DataFrame, events: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Samples with ``present``: an array of their windowed feature names.

    Samples and the latest event of each month and feature travel once, to their person, as plain
    rows. There an event finds the run of the person's dates it serves by two binary searches, so the
    work follows the features that are present, and names are composed once per block of rows.
    A person's rows are held together; they are bounded by the months and features of one person.
    """
    known = F.col("person_id").isNotNull() & F.col("feature").isNotNull() & F.col("event_date").isNotNull()
    latest = events.where(known).groupBy("person_id", "feature", F.trunc("event_date", "month").alias("_month")).agg(F.max("event_date").alias("_date"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in samples.schema.fields if f.name != "person_id"]
    dates = latest.select("person_id", *blank, F.unix_date("_date").alias("_day"), F.col("feature").alias("_feature"))
    asked = samples.withColumns({"_day": F.unix_date("end_date"), "_feature": F.lit(None).cast("string")})
    rows = asked.unionByName(dates).repartition("person_id").sortWithinPartitions("person_id")
    schema = T.StructType([*samples.schema.fields, T.StructField("present", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(functools.partial(_with_present, windows=tuple(windows), columns=tuple(samples.columns)), schema)


def _with_present(batches: Iterator[pa.RecordBatch], windows: Sequence[int], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by person: the samples of whole persons, a block at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        person = batch.column("person_id")
        if held and held[-1].column("person_id")[-1] != person[0]:
            yield from _block_present(held, windows, columns)
            held = []
        # the last person may go on in the next batch; rows without a person belong to none
        whole = pc.index(person, person[-1]).as_py() if person[-1].is_valid else batch.num_rows
        if whole:
            yield from _block_present([*held, batch.slice(0, whole)], windows, columns)
            held = []
        if whole < batch.num_rows:
            held.append(batch.slice(whole))
    if held:
        yield from _block_present(held, windows, columns)


def _block_present(batches: list[pa.RecordBatch], windows: Sequence[int], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The samples among the rows with the features of the events that serve their date."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    person, feature = (pc.cast(rows[name], rows[name].type).combine_chunks() for name in ("person_id", "_feature"))
    differs = pc.fill_null(pc.not_equal(person.slice(1), person.slice(0, len(person) - 1)), True)
    rank = np.concatenate(([0], np.cumsum(differs.to_numpy(zero_copy_only=False)))) << 32
    day = pc.fill_null(rows["_day"], _NO_DAY).to_numpy().astype(np.int64) - _NO_DAY  # a sample without a date comes before all events
    is_event = feature.is_valid().to_numpy(zero_copy_only=False)
    asked, served = np.flatnonzero(~is_event), np.flatnonzero(is_event)
    if not len(asked):
        return
    asked = asked[np.argsort(rank[asked] + day[asked], kind="stable")]
    dates = rank[asked] + day[asked]
    coded = feature.take(pa.array(served)).dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.lexsort((day[served], codes, rank[served]))
    start, code = (rank[served] + day[served])[order], codes[order]
    # an event serves the dates up to the next event of its feature
    following = np.full(len(start), np.iinfo(np.int64).max)
    again = (code[1:] == code[:-1]) & (start[1:] >> 32 == start[:-1] >> 32)
    following[:-1][again] = start[1:][again]
    first = np.searchsorted(dates, start, "right")
    places, found, names = [], [], []
    for i, days in enumerate(windows):
        runs = np.searchsorted(dates, np.minimum(start + days, following), "right") - first
        runs = np.maximum(runs, 0)
        ends = np.cumsum(runs)
        places.append(np.repeat(first - (ends - runs), runs) + np.arange(runs.sum()))
        found.append(np.repeat(code + i * len(coded.dictionary), runs))
        names.append(pc.binary_join_element_wise(coded.dictionary, f"{SEPARATOR}{days} days", ""))
    place = np.concatenate(places).astype(np.uint16 if len(asked) <= 1 << 16 else np.int64)  # short numbers are sorted by digits
    bounds = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(asked)))))
    listed = pa.concat_arrays(names).take(pa.array(np.concatenate(found)[np.argsort(place, kind="stable")]))
    present = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), listed)
    yield from rows.select(columns).take(pa.array(asked)).append_column("present", present).to_batches()


def one_per_feature(sets: DataFrame) -> DataFrame:
    """One row per sample and present feature."""
    return sets.withColumn("feature", F.explode("present")).drop("present")


def frequent_features(long: DataFrame, min_count: int) -> DataFrame:
    """Features with at least ``min_count`` training rows over all years."""
    counts = long.where("split = 'train'").groupBy("feature").agg(F.count(F.lit(1)).alias("train_count"))
    return counts.where(F.col("train_count") >= min_count)


def keep_features(long: DataFrame, features: DataFrame) -> DataFrame:
    """The rows of the given features; these are a table of their own, so that its size is known before the rows are joined."""
    return long.join(materialize(features.select("feature")), "feature", "left_semi")


def age_scaling(samples: DataFrame) -> DataFrame:
    """Mean and population deviation of age on the training rows: one row."""
    train = samples.where("split = 'train'")
    return materialize(train.agg(F.avg("age").alias("age_mean"), F.stddev_pop("age").alias("age_std")))


def standardize_age(samples: DataFrame, params: DataFrame) -> DataFrame:
    mean, std = params.select("age_mean").scalar(), params.select("age_std").scalar()
    return samples.withColumn("age_scaled", (F.col("age") - mean) / std)


def unstandardize_age(samples: DataFrame, params: DataFrame) -> DataFrame:
    mean, std = params.select("age_mean").scalar(), params.select("age_std").scalar()
    return samples.withColumn("age_restored", F.col("age_scaled") * std + mean)


def apply_fold_features(long: DataFrame, samples: DataFrame, features: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Another fold with the feature set and age scaling of the fold that was fitted; chosen by name."""
    return keep_features(long, features), standardize_age(samples, params)


# The feature types of each named feature set.
FEATURE_SETS = {
    "cond_proc": ("condition", "procedure"),
    "labs": ("lab",),
    "drugs": ("drug",),
    "all": ("condition", "procedure", "drug", "lab", "specialty"),
}


def feature_set(long: DataFrame, name: str) -> DataFrame:
    """Features of the set's types; age, month and attribute features have no type and always stay."""
    typed = F.col("feature").contains(SEPARATOR)
    return long.where(~typed | name_part(2, "feature").isin(*FEATURE_SETS[name]))


def assemble(
    samples: DataFrame,
    long: DataFrame,
    vocabulary: Sequence[str],
    numeric: Sequence[str] = (),
    keys: Sequence[str] = ("person_id", "end_date"),
) -> DataFrame:
    """One sparse vector per sample in a fixed column order: present features, then numeric columns.

    The vocabulary is the list of frequent features, as long as the model's own
    coefficient vector; features of one sample are bounded by it.
    """
    key = list(keys)
    present = long.where(F.col("feature").isNotNull()).groupBy(*key).agg(F.collect_set("feature").alias("present"))
    joined = samples.join(present, key, "left")
    return vectorize(joined.withColumn("present", F.coalesce("present", F.array().cast("array<string>"))), vocabulary, numeric)


def vectorize(sets: DataFrame, vocabulary: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """The array ``present`` and the numeric columns as one sparse vector; features outside the vocabulary are left out."""
    vectorizer = CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol="present", outputCol="sparse")
    vectorizer.setBinary(True)
    vectors = vectorizer.transform(sets).drop("present")
    assembler = VectorAssembler(inputCols=["sparse", *numeric], outputCol="features")
    return assembler.transform(vectors).drop("sparse")


def interaction_terms(long: DataFrame, outcome: str) -> DataFrame:
    """Each present feature becomes 'no outcome & feature' or 'outcome & feature' by the label."""
    head = F.when(F.col("y") == 1, F.lit(f"{outcome} (Y) & ")).otherwise(F.lit(f"no {outcome} (Y) & "))
    return long.withColumn("feature", F.concat(head, F.col("feature")))


# The race and ethnicity features, which are negated with "not".
GROUP_FEATURES = (
    "American Indian or Alaska Native",
    "Asian",
    "Black or African American",
    "Hispanic or Latino",
    "Native Hawaiian or Other Pacific Islander",
    "White",
)


def feature_catalog(features: DataFrame) -> DataFrame:
    """Distinct features with parsed parts, a short label and a file-safe key, both also for the negated side.

    The label keeps 25 characters of the concept name (with its variant) and the
    window; month and attribute features have labels of their own.
    """
    names = features.select("feature").distinct()
    parsed = names.select("feature", *parse_feature_name("feature"))
    feature = F.col("feature")
    concept = F.concat_ws(SEPARATOR, F.col("concept_name"), F.col("variant"))
    composed = F.concat_ws(" ", F.substring(concept, 1, 25), F.concat(F.col("window_days").cast("string"), F.lit(" days")))
    month = F.regexp_extract(feature, "^pred_in_(.*)$", 1)
    is_composed = feature.contains(SEPARATOR)
    label = (
        F.when(is_composed, composed)
        .when(feature == "Male", "male")
        .when(month != "", F.concat(F.lit("predict in "), month))
        .otherwise(feature)
    )
    negated = (
        F.when(is_composed, F.concat(F.lit("no "), composed))
        .when(feature == "Male", "female")
        .when(feature.isin(*GROUP_FEATURES), F.concat(F.lit("not "), feature))
        .when(month != "", F.concat(F.lit("predict not in "), month))
    )
    safe = F.regexp_replace(F.col("label"), "[ /]", "_")
    key = F.when(is_composed, F.concat_ws("_", F.col("concept_id").cast("string"), safe)).when(month != "", feature)
    labelled = parsed.withColumn("label", label).withColumn("negated_label", negated)
    keyed = labelled.withColumn("file_key", F.coalesce(key, safe))
    negated_key = (
        F.when(is_composed, F.concat(F.lit("no_"), F.col("file_key")))
        .when(month != "", F.concat(F.lit("pred_not_in_"), month))
        .otherwise(F.regexp_replace(F.col("negated_label"), "[ /]", "_"))
    )
    return keyed.withColumn("negated_file_key", negated_key)


def feature_statistics(catalog: DataFrame) -> DataFrame:
    lab = F.when(F.col("type") == "lab", F.col("concept_id"))
    return catalog.agg(F.count(F.lit(1)).alias("num_features"), F.countDistinct(lab).alias("num_lab_concepts"))
