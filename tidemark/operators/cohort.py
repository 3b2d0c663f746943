"""Index dates, eligibility and cohorts.

Index dates are month starts. A period or event is expanded to the month starts
it covers, which turns every interval join into an equi join on (person, date)
or into no join at all.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import DAYS_PER_YEAR, MIN_COVERAGE, month_starts
from tidemark.functions.ranking import hash_rank, ordered_index

LABEL_MONTHS = 3


def index_dates(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """First day of every month in [start, end]."""
    months = month_starts(F.lit(start), F.lit(end), start, end)
    return spark.range(1).select(F.explode(months).alias("index_date"))


def window_dates(dates: DataFrame, last_year: int, first_year: int) -> DataFrame:
    """Index dates for one look-back length."""
    return dates.where(F.year("index_date").between(first_year, last_year))


def max_date(dates: DataFrame) -> DataFrame:
    return dates.agg(F.max("index_date").alias("max_date"))


def covered_months(periods: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """One row per period and index date that the period contains."""
    dates = month_starts(F.col("period_start"), F.col("period_end"), first, last)
    return periods.select("*", F.explode(dates).alias("end_date"))


def observed_on(periods: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    return covered_months(periods, first, last).select("person_id", "end_date").distinct()


def horizon(date: str = "end_date", months: int = LABEL_MONTHS) -> Column:
    return F.add_months(F.col(date), months)


def death_label(observed: DataFrame, person: DataFrame, months: int = LABEL_MONTHS) -> DataFrame:
    """Positive rows: death no later than the horizon (deaths before the date count too)."""
    died = person.where("death_date IS NOT NULL").select("person_id", F.col("death_date").alias("outcome_date"))
    return (
        observed.join(died, "person_id")
        .where(F.col("outcome_date") <= horizon(months=months))
        .select("person_id", "end_date", "outcome_date", F.lit(1).alias("y"))
        .distinct()
    )


def survivors(observed: DataFrame, person: DataFrame, months: int = LABEL_MONTHS) -> DataFrame:
    alive = F.col("death_date").isNull() | (F.col("death_date") > horizon(months=months))
    return (
        observed.join(person.select("person_id", "death_date"), "person_id")
        .where(alive)
        .select("person_id", "end_date", F.lit(None).cast("date").alias("outcome_date"), F.lit(0).alias("y"))
        .distinct()
    )


def survivor_with_followup(alive: DataFrame, periods: DataFrame, months: int = LABEL_MONTHS) -> DataFrame:
    """Keep rows whose person is observed at or after the horizon: the latest period decides."""
    latest = periods.groupBy("person_id").agg(F.max("period_end").alias("_latest"))
    return alive.join(latest, "person_id").where(F.col("_latest") >= horizon(months=months)).drop("_latest")


def union_labels(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.unionByName(negative).distinct()


def _observed_days(years: int) -> Column:
    window_start = F.add_months(F.col("end_date"), -12 * years)
    days = F.datediff(F.least("period_end", "end_date"), F.greatest(F.col("period_start"), window_start))
    return F.greatest(days, F.lit(0))


def _enough_days(years: int, share: float) -> Column:
    return F.col("num_days") > F.lit(share * DAYS_PER_YEAR * years)


def observation_coverage(
    labels: DataFrame, periods: DataFrame, years: int, first: dt.date, last: dt.date, share: float = MIN_COVERAGE
) -> DataFrame:
    """Days observed in the look-back window over the periods containing the date."""
    days = (
        covered_months(periods, first, last)
        .groupBy("person_id", "end_date")
        .agg(F.sum(_observed_days(years)).alias("num_days"))
        .where(_enough_days(years, share))
    )
    return labels.join(days, ["person_id", "end_date"])


def _label_and_follow(rows: DataFrame, months: int) -> DataFrame:
    """Label rows that already carry ``death_date`` and the person's latest period end."""
    dies = F.col("death_date").isNotNull() & (F.col("death_date") <= horizon(months=months))
    return rows.where(dies | (F.col("_latest") >= horizon(months=months))).select(
        "person_id",
        "end_date",
        F.when(dies, F.col("death_date")).alias("outcome_date"),
        F.when(dies, 1).otherwise(0).alias("y"),
        "num_days",
    )


def monthly_eligibility(
    person: DataFrame,
    periods: DataFrame,
    first: dt.date,
    last: dt.date,
    years: int = 1,
    months: int = LABEL_MONTHS,
    share: float = MIN_COVERAGE,
) -> DataFrame:
    """Eligible person-months with a mortality label.

    Equal to observed_on, death_label, survivor_with_followup, union_labels and
    observation_coverage in a row, but each period is expanded once: the coverage
    filter runs on that expansion and only covered months meet the person table.
    """
    covered = (
        covered_months(periods, first, last)
        .groupBy("person_id", "end_date")
        .agg(F.sum(_observed_days(years)).alias("num_days"))
        .where(_enough_days(years, share))
    )
    latest = periods.groupBy("person_id").agg(F.max("period_end").alias("_latest"))
    people = person.select("person_id", "death_date").join(latest, "person_id")
    return _label_and_follow(covered.join(people, "person_id"), months)


def monthly_eligibility_eol(
    person: DataFrame,
    payer: DataFrame,
    periods: DataFrame,
    first: dt.date,
    last: dt.date,
    years: int = 1,
    min_age: int = 70,
    plan_concepts: DataFrame | None = None,
    months: int = LABEL_MONTHS,
    share: float = MIN_COVERAGE,
) -> DataFrame:
    """End-of-life cohort: older than ``min_age``, alive and in a payer plan on the date."""
    if plan_concepts is not None:
        payer = payer.join(plan_concepts, payer.payer_concept_id == plan_concepts.concept_id, "left_semi")
    old = person.where((F.lit(last.year) - F.col("year_of_birth") > min_age) & (F.col("person_id") > 0))
    periods = periods.select("person_id", "period_start", "period_end").distinct()
    latest = periods.groupBy("person_id").agg(F.max("period_end").alias("_latest"))
    people = old.select("person_id", "year_of_birth", "death_date").join(latest, "person_id")
    covered = (
        covered_months(periods, first, last)
        .groupBy("person_id", "end_date")
        .agg(F.sum(_observed_days(years)).alias("num_days"))
        .where(_enough_days(years, share))
    )
    on_date = covered.join(people, "person_id").where(
        (F.year("end_date") - F.col("year_of_birth") > min_age)
        & (F.col("death_date").isNull() | (F.col("end_date") <= F.col("death_date")))
    )
    in_plan = observed_on(payer, first, last)
    return _label_and_follow(on_date.join(in_plan, ["person_id", "end_date"], "left_semi"), months)


def plan_concepts(concept: DataFrame, names: Sequence[str]) -> DataFrame:
    return concept.where(F.col("concept_name").isin(list(names))).select("concept_id").distinct()


def person_cohort(eligibility: DataFrame, last: dt.date) -> DataFrame:
    """One row per eligible person at the last index date; positives keep their outcome date."""
    people = eligibility.groupBy("person_id").agg(F.max("outcome_date").alias("outcome_date"), F.max("y").alias("y"))
    people = people.withColumn("end_date", F.lit(last))
    return ordered_index(people, "person_id").select("example_id", "person_id", "end_date", "outcome_date", "y")


def sample_cohort(cohort: DataFrame, n: int, seed: int) -> DataFrame:
    """A reproducible random subset of n rows: the n smallest hash ranks."""
    return hash_rank(cohort, ["person_id"], seed=seed).where(F.col("rank") <= n).drop("rank", "group_size")


def month_columns(dates: Sequence[dt.date]) -> list[str]:
    return [f"m_{d:%Y_%m}" for d in dates]


def months_between(first: dt.date, last: dt.date) -> list[dt.date]:
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    return [dt.date(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1) for i in range(count)]


def date_matrix(rows: DataFrame, dates: Sequence[dt.date], value: Column | None = None) -> DataFrame:
    """Person x month matrix of 0/1: one conditional maximum per listed month."""
    cell = F.lit(1) if value is None else value
    columns = [
        F.max(F.when(F.col("end_date") == F.lit(d), cell).otherwise(0)).cast("int").alias(name)
        for d, name in zip(dates, month_columns(dates))
    ]
    return rows.groupBy("person_id").agg(*columns)


def align_to_cohort(matrix: DataFrame, cohort: DataFrame) -> DataFrame:
    """Matrix rows of the cohort's persons, numbered by the cohort; absent persons get zeros."""
    months = [c for c in matrix.columns if c != "person_id"]
    joined = cohort.select("example_id", "person_id").join(matrix, "person_id", "left")
    return joined.select("example_id", "person_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in months])


def condition_eligibility(outcomes: DataFrame) -> DataFrame:
    """Person-months that remain after prior occurrences were excluded."""
    return outcomes.select("person_id", "end_date").distinct()


def concept_dimension(person: DataFrame, concept: DataFrame, column: str) -> DataFrame:
    used = person.select(F.col(column).alias("concept_id")).where("concept_id IS NOT NULL").distinct()
    return used.join(concept, "concept_id").select(F.col("concept_id").alias(column), "concept_name")


def cohort_statistics(eligibility: DataFrame) -> DataFrame:
    people = F.countDistinct("person_id")
    samples = F.count(F.lit(1))
    return eligibility.agg(
        people.alias("num_persons"),
        samples.alias("num_samples"),
        (samples.cast("double") / people).alias("samples_per_person"),
    )


def distinct_persons(cohort: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("person_id") if approximate else F.countDistinct("person_id")
    return cohort.agg(count.alias("num_persons"))
