"""Stages that many queries start from, and the same stages as SQL text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from tidemark.operators import cohort
from tidemark.sources.binding import FIRST_DATE, LAST_DATE, YEARS, Bound

FIRST, LAST = FIRST_DATE, LAST_DATE
DATES = cohort.months_between(FIRST, LAST)


def eligible_months(r: Bound, years: int = 1) -> DataFrame:
    return cohort.monthly_eligibility(r["person"], r["observation_period"], FIRST, LAST, years)


def eligibility(r: Bound, years: int = 1) -> DataFrame:
    """The eligibility table as a stage that labels, cohorts and discovery read."""
    return r.stage(f"eligibility_{years}", lambda: eligible_months(r, years))


def people(r: Bound) -> DataFrame:
    return r.stage("people", lambda: cohort.person_cohort(eligibility(r), LAST))


SQL_DATES = """dates AS (
    SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS index_date)"""

SQL_OBSERVED = """observed AS (
    SELECT DISTINCT o.person_id, d.index_date AS end_date
    FROM observation_period o JOIN dates d ON o.period_start <= d.index_date AND o.period_end >= d.index_date)"""

SQL_DEAD = """dead AS (
    SELECT DISTINCT o.person_id, o.end_date, p.death_date AS outcome_date, 1 AS y
    FROM observed o JOIN person p ON o.person_id = p.person_id
    WHERE p.death_date <= CAST(o.end_date + INTERVAL 3 MONTH AS DATE))"""

SQL_ALIVE = """alive AS (
    SELECT DISTINCT o.person_id, o.end_date, CAST(NULL AS DATE) AS outcome_date, 0 AS y
    FROM observed o JOIN person p ON o.person_id = p.person_id
    WHERE p.death_date IS NULL OR p.death_date > CAST(o.end_date + INTERVAL 3 MONTH AS DATE))"""

SQL_FOLLOWED = """followed AS (
    SELECT DISTINCT a.* FROM alive a JOIN observation_period o ON a.person_id = o.person_id
    AND o.period_end >= CAST(a.end_date + INTERVAL 3 MONTH AS DATE))"""

SQL_LABELS = "labels_all AS (SELECT * FROM dead UNION SELECT * FROM followed)"


def sql_eligibility(years: int = 1, name: str = "eligibility") -> str:
    return f"""{name} AS (
    SELECT l.person_id, l.end_date, l.outcome_date, l.y,
           CAST(sum(greatest(date_diff('day', greatest(o.period_start, CAST(l.end_date - INTERVAL {years} YEAR AS DATE)),
                                              least(o.period_end, l.end_date)), 0)) AS BIGINT) AS num_days
    FROM labels_all l JOIN observation_period o
    ON l.person_id = o.person_id AND l.end_date >= o.period_start AND l.end_date <= o.period_end
    GROUP BY ALL HAVING num_days > 0.95 * 365.25 * {years})"""


SQL_ELIGIBLE = (SQL_DATES, SQL_OBSERVED, SQL_DEAD, SQL_ALIVE, SQL_FOLLOWED, SQL_LABELS, sql_eligibility())

SQL_PEOPLE = """people AS (
    SELECT row_number() OVER (ORDER BY person_id) - 1 AS example_id, person_id, DATE '2000-12-01' AS end_date,
           max(outcome_date) AS outcome_date, max(y) AS y
    FROM eligibility GROUP BY person_id)"""

SQL_COHORT = (*SQL_ELIGIBLE, SQL_PEOPLE)
