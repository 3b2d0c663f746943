"""Outcome labels per person-month, and discovery of frequent outcomes.

An event is expanded to the three or four month starts whose outcome window it
falls into and reduced to the earliest date per (person, month) before it meets
the eligibility table: no interval join, and a person with very many events
brings at most one row per month into the join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import AGE_BANDS, any_phrase, label_months, ratio
from tidemark.functions.ranking import ordered_index
from tidemark.operators.cohort import LABEL_MONTHS, align_to_cohort, date_matrix
from tidemark.operators.labs import banded_measurements


def _person_months(eligibility: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Eligible person-months, of the cohort's persons if a cohort narrows them."""
    rows = eligibility.select("person_id", "end_date").distinct()
    return rows if cohort is None else rows.join(cohort.select("person_id"), "person_id", "left_semi")


def _labelled(rows: DataFrame, events: DataFrame, months: int) -> DataFrame:
    hits = (
        events.select("person_id", "event_date", F.explode(label_months(F.col("event_date"), months)).alias("end_date"))
        .groupBy("person_id", "end_date")
        .agg(F.min("event_date").alias("outcome_date"))
    )
    return rows.join(hits, ["person_id", "end_date"], "left").withColumn(
        "y", F.when(F.col("outcome_date").isNotNull(), 1).otherwise(0)
    )


def _numbered(rows: DataFrame) -> DataFrame:
    columns = ["example_id", "person_id", "end_date", "outcome_date", "y"]
    return ordered_index(rows, "person_id", within=["end_date"]).select(columns)


def recurrent_outcome(
    eligibility: DataFrame,
    cohort: DataFrame | None,
    events: DataFrame,
    concepts: Sequence[int] | None = None,
    months: int = LABEL_MONTHS,
    numbered: bool = True,
) -> DataFrame:
    """y = 1 where one of the concepts occurs in (date, date + months]; earlier events do not matter."""
    if concepts is not None:
        events = events.where(F.col("concept_id").isin(list(concepts)))
    rows = _labelled(_person_months(eligibility, cohort), events.select("person_id", "event_date"), months)
    return _numbered(rows) if numbered else rows


def first_diagnosis_outcome(
    eligibility: DataFrame,
    cohort: DataFrame | None,
    events: DataFrame,
    concepts: Sequence[int],
    months: int = LABEL_MONTHS,
    numbered: bool = True,
) -> DataFrame:
    """As above, without the person-months on or after the person's first occurrence."""
    events = events.where(F.col("concept_id").isin(list(concepts))).select("person_id", "event_date")
    first = events.groupBy("person_id").agg(F.min("event_date").alias("_first"))
    rows = _person_months(eligibility, cohort).join(first, "person_id", "left")
    rows = rows.where(F.col("_first").isNull() | (F.col("_first") > F.col("end_date"))).drop("_first")
    rows = _labelled(rows, events, months)
    return _numbered(rows) if numbered else rows


def _reference_columns(references: DataFrame, direction: str) -> DataFrame:
    return references.select("concept_id", "unit", "age_range", "gender_source_value", f"range_{direction}").distinct()


def abnormal_measurements(
    measurement: DataFrame,
    person: DataFrame,
    references: DataFrame,
    direction: str,
    concepts: Sequence[int] | None = None,
) -> DataFrame:
    """Measurements below (low) or above (high) the range of their concept, unit, band and gender."""
    if concepts is not None:
        measurement = measurement.where(F.col("concept_id").isin(list(concepts)))
    banded = banded_measurements(measurement.where("value IS NOT NULL"), person)
    joined = banded.join(
        _reference_columns(references, direction).withColumnRenamed(f"range_{direction}", "_bound"),
        ["concept_id", "unit", "age_range", "gender_source_value"],
    )
    beyond = F.col("value") < F.col("_bound") if direction == "low" else F.col("value") > F.col("_bound")
    return joined.where(beyond).select("person_id", "concept_id", "event_date")


def abnormal_lab_outcome(
    eligibility: DataFrame,
    cohort: DataFrame | None,
    measurement: DataFrame,
    person: DataFrame,
    references: DataFrame,
    concepts: Sequence[int],
    direction: str,
    months: int = LABEL_MONTHS,
) -> DataFrame:
    """y = 1 where a value of one of the concepts is out of range within the outcome window."""
    abnormal = abnormal_measurements(measurement, person, references, direction, concepts)
    return recurrent_outcome(eligibility, cohort, abnormal, months=months)


def mortality_outcome(eligibility: DataFrame) -> DataFrame:
    return eligibility.select("person_id", "end_date", "outcome_date", "y")


def outcome_matrix(outcomes: DataFrame, dates: Sequence[dt.date], cohort: DataFrame) -> DataFrame:
    return align_to_cohort(date_matrix(outcomes, dates, F.col("y")), cohort)


def _served(eligibility: DataFrame, events: DataFrame, months: int, keep: Sequence[str]) -> DataFrame:
    """Distinct (person, month, keep) for events in the closed window [date, date + months] of an eligible month."""
    expanded = events.select(
        "person_id", *keep, F.explode(label_months(F.col("event_date"), months, closed=True)).alias("end_date")
    ).distinct()
    eligible = eligibility.select("person_id", "end_date").distinct()
    return expanded.join(eligible, ["person_id", "end_date"], "left_semi")


def _named(counts: DataFrame, concept: DataFrame) -> DataFrame:
    return counts.join(concept.select("concept_id", "concept_name").distinct(), "concept_id")


def top_first_conditions(
    eligibility: DataFrame, events: DataFrame, concept: DataFrame, n: int, months: int = LABEL_MONTHS
) -> DataFrame:
    """The n concepts whose first occurrence falls into an eligible month for most persons."""
    first = events.groupBy("person_id", "concept_id").agg(F.min("event_date").alias("event_date"))
    people = _served(eligibility, first, months, ["concept_id"]).select("person_id", "concept_id").distinct()
    counts = people.groupBy("concept_id").agg(F.count(F.lit(1)).alias("concept_count"))
    top = _named(counts, concept).orderBy(F.desc("concept_count"), "concept_id").limit(n)
    return top.select("concept_id", "concept_name", "concept_count")


def procedure_cohort_counts(
    eligibility: DataFrame, events: DataFrame, concept: DataFrame, months: int = LABEL_MONTHS
) -> DataFrame:
    served = _served(eligibility, events, months, ["concept_id"])
    counts = served.groupBy("concept_id").agg(F.count(F.lit(1)).alias("concept_count"))
    return _named(counts, concept).select("concept_id", "concept_name", "concept_count")


def top_procedures(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("concept_count"), "concept_id").limit(n)


def top_abnormal_labs(
    eligibility: DataFrame,
    measurement: DataFrame,
    person: DataFrame,
    low: DataFrame,
    high: DataFrame,
    n: int,
    months: int = LABEL_MONTHS,
) -> DataFrame:
    """The n (concept, direction) pairs that are abnormal in most person-months."""
    cell = ["concept_id", "unit", "age_range", "gender_source_value"]
    bounds = _reference_columns(low, "low").withColumnRenamed("range_low", "_low").join(
        _reference_columns(high, "high").withColumnRenamed("range_high", "_high"), cell, "full"
    )
    banded = banded_measurements(measurement.where("value IS NOT NULL"), person).join(bounds, cell)
    beyond = F.array_compact(
        F.array(F.when(F.col("value") < F.col("_low"), "low"), F.when(F.col("value") > F.col("_high"), "high"))
    )
    abnormal = banded.select("person_id", "concept_id", "event_date", F.explode(beyond).alias("direction"))
    served = _served(eligibility, abnormal, months, ["concept_id", "direction"])
    counts = served.groupBy("concept_id", "direction").agg(F.count(F.lit(1)).alias("concept_count"))
    return counts.orderBy(F.desc("concept_count"), "concept_id", F.desc("direction")).limit(n)


def reference_pivot(
    top: DataFrame,
    eligibility: DataFrame,
    measurement: DataFrame,
    low: DataFrame,
    high: DataFrame,
    concept: DataFrame,
    months: int = LABEL_MONTHS,
) -> DataFrame:
    """The eight gender x band ranges per unit of each top outcome, from one conditional aggregation."""
    valued = measurement.where("value IS NOT NULL")
    units = _served(eligibility, valued, months, ["concept_id", "unit"]).select("concept_id", "unit").distinct()

    def wide(references: DataFrame, direction: str) -> DataFrame:
        cells = [
            F.max(
                F.when(
                    (F.col("gender_source_value") == g) & (F.col("age_range") == band), F.col(f"range_{direction}")
                )
            ).alias(f"{word}_reference_age_range_{i}")
            for g, word in (("M", "male"), ("F", "female"))
            for i, band in enumerate(AGE_BANDS, start=1)
        ]
        return references.groupBy("concept_id", "unit").agg(*cells).withColumn("direction", F.lit(direction))

    ranges = wide(low, "low").unionByName(wide(high, "high"))
    rows = top.join(units, "concept_id").join(ranges, ["concept_id", "unit", "direction"], "left")
    return _named(rows, concept)


def concept_group(counts: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Concepts whose name has any include phrase and no exclude phrase."""
    name = F.col("concept_name")
    return counts.where(any_phrase(name, include) & ~any_phrase(name, exclude))


def lab_frequency_over_time(
    cohort: DataFrame | None,
    eligibility: DataFrame,
    measurement: DataFrame,
    dates: DataFrame,
    concepts: Sequence[int],
    months: int = LABEL_MONTHS,
) -> DataFrame:
    """Person-months with a valued measurement in the closed window, for every index date."""
    valued = measurement.where(F.col("concept_id").isin(list(concepts)) & F.col("value").isNotNull())
    rows = _person_months(eligibility, cohort)
    counts = _served(rows, valued, months, []).groupBy("end_date").agg(F.count(F.lit(1)).alias("n"))
    joined = dates.join(counts, dates.index_date == counts.end_date, "left")
    return joined.select("index_date", F.coalesce("n", F.lit(0)).alias("count"))


def order_and_value_rate(
    cohort: DataFrame, measurement: DataFrame, concept_id: int, start: dt.date, end: dt.date
) -> DataFrame:
    """Orders per cohort person and the share with a value, by year."""
    in_scope = measurement.where((F.col("concept_id") == concept_id) & F.col("event_date").between(start, end))
    orders = in_scope.join(cohort.select("person_id").distinct(), "person_id", "left_semi")
    size = cohort.agg(F.countDistinct("person_id")).scalar()
    by_year = orders.groupBy(F.year("event_date").alias("year")).agg(
        F.count(F.lit(1)).alias("num_orders"), F.count("value").alias("num_valued")
    )
    return by_year.select(
        "year",
        "num_orders",
        "num_valued",
        ratio(F.col("num_orders"), size).alias("orders_per_person"),
        ratio(F.col("num_valued"), F.col("num_orders")).alias("value_rate"),
    )


def cohort_size_and_rate(samples: DataFrame, lab_frequency: DataFrame | None = None) -> DataFrame:
    """Samples, positives and rate per year; with the yearly lab-valued count if given."""
    yearly = samples.groupBy(F.year("end_date").alias("year")).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.sum("y").alias("num_positive"),
        F.avg(F.col("y").cast("double")).alias("rate"),
    )
    if lab_frequency is None:
        return yearly
    counts = lab_frequency.groupBy(F.year("index_date").alias("year")).agg(F.sum("count").alias("num_lab_valued"))
    return yearly.join(counts, "year", "left")


def year_over_year_change(yearly: DataFrame, outcome: str, values: Sequence[str]) -> DataFrame:
    """Previous and current value of each column per outcome."""
    by_year = Window.partitionBy(outcome).orderBy("year")
    changes = [
        c
        for v in values
        for c in (F.lag(v).over(by_year).alias(f"{v}_previous"), (F.col(v) - F.lag(v).over(by_year)).alias(f"{v}_change"))
    ]
    return yearly.select(outcome, "year", *values, *changes)


def variant_share_over_time(yearly: DataFrame, total: DataFrame, variant: str, count: str, size: str) -> DataFrame:
    """Share of each variant in the yearly cohort size."""
    joined = yearly.join(total.select("year", size), "year")
    return joined.select("year", variant, count, ratio(F.col(count), F.col(size)).alias("share"))
