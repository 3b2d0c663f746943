"""Queries on index dates, eligibility and cohorts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.expressions import hash32_sql
from tidemark.operators import cohort
from tidemark.plans.common import (
    DATES,
    FIRST,
    LAST,
    SQL_ALIVE,
    SQL_COHORT,
    SQL_DATES,
    SQL_DEAD,
    SQL_ELIGIBLE,
    SQL_FOLLOWED,
    SQL_LABELS,
    SQL_OBSERVED,
    eligibility,
    eligible_months,
    people,
    sql_eligibility,
)
from tidemark.plans.registry import query, sql

_OBSERVED = (SQL_DATES, SQL_OBSERVED)
_TEXT = "person_id, CAST(end_date AS VARCHAR) AS end_date"
_LABELS = f"SELECT {_TEXT}, CAST(outcome_date AS VARCHAR) AS outcome_date, y"
_MONTHS = ",\n".join(
    f"CAST(max(CASE WHEN end_date = DATE '{d}' THEN 1 ELSE 0 END) AS INT) AS {name}"
    for d, name in zip(DATES, cohort.month_columns(DATES))
)
_MATRIX = f"matrix AS (SELECT person_id, {_MONTHS} FROM eligibility GROUP BY person_id)"


def observed(r):
    return cohort.observed_on(r["observation_period"], FIRST, LAST)


def order_calendar(r):
    """Month starts of the index range in which orders exist."""
    calendar = cohort.index_dates(r.spark, FIRST, LAST)
    months = r["orders"].select(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("index_date")).distinct()
    return calendar.join(months, "index_date", "left_semi")


_ORDER_MONTHS = """order_months AS (
    SELECT index_date FROM dates WHERE index_date IN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders))"""


@query(
    "c01_prediction_dates",
    sql(SQL_DATES, _ORDER_MONTHS, select="SELECT CAST(index_date AS VARCHAR) AS index_date FROM order_months"),
)
def _(r):
    return order_calendar(r)


@query(
    "c02_window_dates",
    sql(
        SQL_DATES,
        _ORDER_MONTHS,
        select="SELECT CAST(index_date AS VARCHAR) AS index_date FROM order_months WHERE year(index_date) BETWEEN 1998 AND 2000",
    ),
)
def _(r):
    return cohort.window_dates(order_calendar(r), last_year=2000, first_year=1998)


@query(
    "c03_max_date",
    sql(SQL_DATES, _ORDER_MONTHS, select="SELECT CAST(max(index_date) AS VARCHAR) AS max_date FROM order_months"),
)
def _(r):
    return cohort.max_date(order_calendar(r))


@query("c04_observed_on", sql(*_OBSERVED, select=f"SELECT {_TEXT} FROM observed"))
def _(r):
    return observed(r)


@query("c05_death_label", sql(*_OBSERVED, SQL_DEAD, select=f"{_LABELS} FROM dead"))
def _(r):
    return cohort.death_label(observed(r), r["person"])


@query("c06_survivor_with_followup", sql(*_OBSERVED, SQL_ALIVE, SQL_FOLLOWED, select=f"{_LABELS} FROM followed"))
def _(r):
    alive = cohort.survivors(observed(r), r["person"])
    return cohort.survivor_with_followup(alive, r["observation_period"])


def labels(r):
    seen = observed(r)
    negative = cohort.survivor_with_followup(cohort.survivors(seen, r["person"]), r["observation_period"])
    return cohort.union_labels(cohort.death_label(seen, r["person"]), negative)


@query(
    "c07_union_labels",
    sql(*_OBSERVED, SQL_DEAD, SQL_ALIVE, SQL_FOLLOWED, SQL_LABELS, select=f"{_LABELS} FROM labels_all"),
)
def _(r):
    return labels(r)


@query("c08_observation_coverage", sql(*SQL_ELIGIBLE, select=f"{_LABELS}, num_days FROM eligibility"))
def _(r):
    return cohort.observation_coverage(labels(r), r["observation_period"], 1, FIRST, LAST)


@query("c09_monthly_eligibility", sql(*SQL_ELIGIBLE, select=f"{_LABELS}, num_days FROM eligibility"))
def _(r):
    return eligible_months(r)


@query(
    "c09_monthly_eligibility_3_years",
    sql(*SQL_ELIGIBLE[:-1], sql_eligibility(3), select=f"{_LABELS}, num_days FROM eligibility"),
)
def _(r):
    return eligible_months(r, years=3)


@query(
    "c10_monthly_eligibility_eol",
    sql(
        SQL_DATES,
        "periods AS (SELECT DISTINCT person_id, period_start, period_end FROM observation_period)",
        """observed AS (
        SELECT DISTINCT pe.person_id, d.index_date AS end_date
        FROM person pe JOIN payer_plan_period pp ON pe.person_id = pp.person_id
        JOIN dates d ON pp.period_start <= d.index_date AND pp.period_end >= d.index_date
        JOIN periods o ON o.person_id = pe.person_id AND o.period_start <= d.index_date AND o.period_end >= d.index_date
        WHERE 2000 - pe.year_of_birth > 70 AND pe.person_id > 0 AND year(d.index_date) - pe.year_of_birth > 70
        AND (pe.death_date IS NULL OR d.index_date <= pe.death_date))""",
        SQL_DEAD,
        SQL_ALIVE,
        SQL_FOLLOWED,
        SQL_LABELS,
        sql_eligibility(),
        select=f"{_LABELS}, num_days FROM eligibility",
    ),
)
def _(r):
    return cohort.monthly_eligibility_eol(r["person"], r["payer_plan_period"], r["observation_period"], FIRST, LAST)


_PLAN_NAMES = ("Condition 3", "Procedure 105", "Drug 203")


@query(
    "c11_plan_concepts",
    sql(select=f"SELECT DISTINCT concept_id FROM concept WHERE concept_name IN {_PLAN_NAMES}"),
)
def _(r):
    return cohort.plan_concepts(r["concept"], _PLAN_NAMES)


_PEOPLE = "SELECT example_id, person_id, CAST(end_date AS VARCHAR) AS end_date, CAST(outcome_date AS VARCHAR) AS outcome_date, y"


@query("c12_person_cohort", sql(*SQL_COHORT, select=f"{_PEOPLE} FROM people"))
def _(r):
    return people(r)


@query(
    "c13_sample_cohort",
    sql(*SQL_COHORT, select=f"{_PEOPLE} FROM people ORDER BY {hash32_sql(17, 'person_id')}, person_id LIMIT 100"),
)
def _(r):
    return cohort.sample_cohort(people(r), n=100, seed=17)


@query("c14_eligibility_matrix", sql(*SQL_ELIGIBLE, _MATRIX, select="SELECT * FROM matrix"))
def _(r):
    return cohort.date_matrix(eligibility(r), DATES)


_ALIGNED = ", ".join(f"coalesce({m}, 0) AS {m}" for m in cohort.month_columns(DATES))


@query(
    "c15_align_to_cohort",
    sql(
        *SQL_ELIGIBLE[:-1],
        sql_eligibility(),
        sql_eligibility(3, "eligibility_3"),
        """people AS (
        SELECT row_number() OVER (ORDER BY person_id) - 1 AS example_id, person_id FROM eligibility_3 GROUP BY person_id)""",
        _MATRIX,
        select=f"SELECT example_id, p.person_id, {_ALIGNED} FROM people p LEFT JOIN matrix m ON p.person_id = m.person_id",
    ),
)
def _(r):
    matrix = cohort.date_matrix(eligibility(r), DATES)
    return cohort.align_to_cohort(matrix, cohort.person_cohort(eligibility(r, years=3), LAST))


@query(
    "c16_condition_eligibility",
    sql(
        *SQL_ELIGIBLE,
        "firsts AS (SELECT person_id, min(event_date) AS first_date FROM condition_occurrence WHERE concept_id = 7 GROUP BY person_id)",
        select="""SELECT e.person_id, CAST(e.end_date AS VARCHAR) AS end_date
        FROM eligibility e LEFT JOIN firsts f ON e.person_id = f.person_id
        WHERE f.first_date IS NULL OR f.first_date > e.end_date""",
    ),
)
def _(r):
    from tidemark.operators.outcomes import first_diagnosis_outcome

    elig = eligibility(r)
    return cohort.condition_eligibility(first_diagnosis_outcome(elig, None, r["condition_occurrence"], [7], numbered=False))


@query(
    "c17_concept_dimension",
    sql(
        select="""SELECT p.race_concept_id, c.concept_name FROM (SELECT DISTINCT race_concept_id FROM person) p
        JOIN concept c ON c.concept_id = p.race_concept_id"""
    ),
)
def _(r):
    return cohort.concept_dimension(r["person"], r["concept"], "race_concept_id")


@query(
    "c18_cohort_statistics",
    sql(
        *SQL_ELIGIBLE,
        select="""SELECT count(DISTINCT person_id) AS num_persons, count(*) AS num_samples,
        round(CAST(count(*) AS DOUBLE) / count(DISTINCT person_id), 6) AS samples_per_person FROM eligibility""",
    ),
)
def _(r):
    return cohort.cohort_statistics(eligibility(r))


@query("c19_distinct_persons", sql(*SQL_ELIGIBLE, select="SELECT count(DISTINCT person_id) AS num_persons FROM eligibility"))
def _(r):
    return cohort.distinct_persons(eligibility(r))
