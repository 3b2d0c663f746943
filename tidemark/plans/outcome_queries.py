"""Queries on outcomes, outcome discovery, splits and yearly samples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.expressions import AGE_BANDS, hash32_sql
from tidemark.operators import cohort, outcomes, splits
from tidemark.plans import lab_sql as ls
from tidemark.plans.common import DATES, FIRST, LAST, SQL_COHORT, SQL_DATES, SQL_ELIGIBLE, eligibility, people
from tidemark.plans.lab_queries import clean, references
from tidemark.plans.registry import query, sql
from tidemark.session import materialize

PROCEDURES = (103, 107)
_ROWS = "SELECT example_id, person_id, CAST(end_date AS VARCHAR) AS end_date, CAST(outcome_date AS VARCHAR) AS outcome_date, y"


def sql_outcome(events: str, name: str = "outcome", exclude_prior: bool = False) -> tuple[str, ...]:
    """Labels from a CTE of (person_id, event_date) with interval joins on the eligibility."""
    prior = f"""WHERE NOT EXISTS (SELECT 1 FROM {events} f WHERE f.person_id = me.person_id AND f.event_date <= me.end_date)"""
    return (
        f"""{name}_hits AS (SELECT me.person_id, me.end_date, min(e.event_date) AS outcome_date
            FROM eligibility me JOIN {events} e ON me.person_id = e.person_id AND me.end_date < e.event_date
            AND e.event_date <= CAST(me.end_date + INTERVAL 3 MONTH AS DATE) GROUP BY ALL)""",
        f"""{name} AS (SELECT row_number() OVER (ORDER BY me.person_id, me.end_date) - 1 AS example_id, me.person_id, me.end_date,
            h.outcome_date, CASE WHEN h.outcome_date IS NULL THEN 0 ELSE 1 END AS y
            FROM (SELECT DISTINCT person_id, end_date FROM eligibility) me
            LEFT JOIN {name}_hits h ON me.person_id = h.person_id AND me.end_date = h.end_date
            {prior if exclude_prior else ''})""",
    )


SQL_PROCEDURES = f"proc_events AS (SELECT person_id, event_date FROM procedure_occurrence WHERE concept_id IN {PROCEDURES})"
SQL_OUTCOME = (*SQL_COHORT, SQL_PROCEDURES, *sql_outcome("proc_events"))


def procedure_outcome(r):
    """Labels of every eligible person-month, as a stage that splits and samples read."""
    return r.stage(
        "outcome",
        lambda: outcomes.recurrent_outcome(eligibility(r), None, r["procedure_occurrence"], PROCEDURES, numbered=False),
    )


@query(
    "o01_first_diagnosis_outcome",
    sql(
        *SQL_COHORT,
        "cond_events AS (SELECT person_id, event_date FROM condition_occurrence WHERE concept_id = 7)",
        *sql_outcome("cond_events", exclude_prior=True),
        select=f"{_ROWS} FROM outcome",
    ),
)
def _(r):
    elig = eligibility(r)
    return outcomes.first_diagnosis_outcome(elig, cohort.person_cohort(elig, LAST), r["condition_occurrence"], [7])


@query("o02_recurrent_outcome", sql(*SQL_OUTCOME, select=f"{_ROWS} FROM outcome"))
def _(r):
    return outcomes.recurrent_outcome(eligibility(r), None, r["procedure_occurrence"], PROCEDURES)


def _sql_abnormal(name: str, d: str, where: str) -> str:
    sign = "<" if d == "low" else ">"
    return f"""{name} AS (SELECT m.person_id, m.concept_id, m.event_date FROM clean m JOIN person p ON m.person_id = p.person_id
        JOIN refs_{d} r ON r.concept_id = m.concept_id AND r.unit = m.unit AND r.gender_source_value = p.gender_source_value
        AND r.age_range = {ls.band('(year(m.event_date) - p.year_of_birth)')}
        WHERE m.value {sign} r.range_{d} AND {where})"""


@query(
    "o03_abnormal_lab_outcome",
    sql(
        *SQL_COHORT,
        *ls.REFS,
        _sql_abnormal("abnormal", "low", "m.concept_id = 300"),
        *sql_outcome("abnormal"),
        select=f"{_ROWS} FROM outcome",
    ),
)
def _(r):
    elig = eligibility(r)
    return outcomes.abnormal_lab_outcome(elig, None, clean(r), r.stored("person"), references(r, "low"), [300], "low")


@query(
    "o04_abnormal_lab_group_outcome",
    sql(
        *SQL_COHORT,
        *ls.REFS,
        _sql_abnormal("abnormal", "high", "m.concept_id IN (301, 303, 304)"),
        *sql_outcome("abnormal"),
        select=f"{_ROWS} FROM outcome",
    ),
)
def _(r):
    elig = eligibility(r)
    return outcomes.abnormal_lab_outcome(
        elig, None, clean(r), r.stored("person"), references(r, "high"), [301, 303, 304], "high"
    )


@query(
    "o05_mortality_outcome",
    sql(
        *SQL_ELIGIBLE,
        select="SELECT person_id, CAST(end_date AS VARCHAR) AS end_date, CAST(outcome_date AS VARCHAR) AS outcome_date, y FROM eligibility",
    ),
)
def _(r):
    return outcomes.mortality_outcome(eligibility(r))


_CELLS = ",\n".join(
    f"CAST(max(CASE WHEN o.end_date = DATE '{d}' THEN o.y ELSE 0 END) AS INT) AS {name}"
    for d, name in zip(DATES, cohort.month_columns(DATES))
)


@query(
    "o06_outcome_matrix",
    sql(
        *SQL_OUTCOME,
        select=f"""SELECT p.example_id, p.person_id, {_CELLS}
        FROM people p LEFT JOIN outcome o ON o.person_id = p.person_id GROUP BY p.example_id, p.person_id""",
    ),
)
def _(r):
    return outcomes.outcome_matrix(procedure_outcome(r), DATES, people(r))


@query(
    "o07_top_first_conditions",
    sql(
        *SQL_ELIGIBLE,
        """firsts AS (SELECT person_id, concept_id, min(event_date) AS first_date FROM condition_occurrence
        WHERE person_id IN (SELECT person_id FROM eligibility) GROUP BY ALL)""",
        """counted AS (SELECT f.concept_id, count(DISTINCT f.person_id) AS concept_count FROM firsts f JOIN eligibility e
        ON f.person_id = e.person_id AND e.end_date <= f.first_date
        AND CAST(e.end_date + INTERVAL 3 MONTH AS DATE) >= f.first_date GROUP BY f.concept_id)""",
        select="""SELECT t.concept_id, c.concept_name, t.concept_count FROM counted t JOIN concept c ON c.concept_id = t.concept_id
        ORDER BY t.concept_count DESC, t.concept_id LIMIT 10""",
    ),
)
def _(r):
    return outcomes.top_first_conditions(eligibility(r), r["condition_occurrence"], r["concept"], 10)


SQL_COUNTS = """counts AS (
    SELECT s.concept_id, c.concept_name, s.concept_count FROM (
        SELECT concept_id, count(*) AS concept_count FROM (
            SELECT DISTINCT e.person_id, e.end_date, o.concept_id FROM eligibility e JOIN procedure_occurrence o
            ON e.person_id = o.person_id AND e.end_date <= o.event_date
            AND CAST(e.end_date + INTERVAL 3 MONTH AS DATE) >= o.event_date) GROUP BY concept_id) s
    JOIN concept c ON c.concept_id = s.concept_id)"""


def procedure_counts(r):
    return outcomes.procedure_cohort_counts(eligibility(r), r["procedure_occurrence"], r["concept"])


@query("o08_procedure_cohort_counts", sql(*SQL_ELIGIBLE, SQL_COUNTS, select="SELECT * FROM counts"))
def _(r):
    return procedure_counts(r)


@query(
    "o09_top_procedures",
    sql(*SQL_ELIGIBLE, SQL_COUNTS, select="SELECT * FROM counts ORDER BY concept_count DESC, concept_id LIMIT 5"),
)
def _(r):
    return outcomes.top_procedures(procedure_counts(r), 5)


def _sql_served(source: str, name: str, columns: str) -> str:
    return f"""{name} AS (SELECT DISTINCT e.person_id, e.end_date, {columns} FROM eligibility e JOIN {source} m
        ON e.person_id = m.person_id AND e.end_date <= m.event_date AND CAST(e.end_date + INTERVAL 3 MONTH AS DATE) >= m.event_date)"""


SQL_TOP_LABS = (
    *SQL_ELIGIBLE,
    *ls.REFS,
    _sql_abnormal("too_low", "low", "TRUE"),
    _sql_abnormal("too_high", "high", "TRUE"),
    _sql_served("too_low", "served_low", "m.concept_id, 'low' AS direction"),
    _sql_served("too_high", "served_high", "m.concept_id, 'high' AS direction"),
    """top_labs AS (SELECT concept_id, direction, count(*) AS concept_count
    FROM (SELECT * FROM served_low UNION SELECT * FROM served_high) GROUP BY ALL
    ORDER BY concept_count DESC, concept_id, direction DESC LIMIT 8)""",
)


def top_labs(r):
    meas, low, high = clean(r), references(r, "low"), references(r, "high")
    return outcomes.top_abnormal_labs(eligibility(r), meas, r.stored("person"), low, high, 8), meas, low, high


@query("o10_top_abnormal_labs", sql(*SQL_TOP_LABS, select="SELECT * FROM top_labs"))
def _(r):
    return top_labs(r)[0]


_WIDE = ", ".join(
    f"""(SELECT max(CASE WHEN t.direction = 'low' THEN l.v_low ELSE l.v_high END) FROM both_refs l
        WHERE l.concept_id = t.concept_id AND l.unit = u.unit AND l.gender_source_value = '{g}' AND l.age_range = '{b}')
        AS {word}_reference_age_range_{i}"""
    for g, word in (("M", "male"), ("F", "female"))
    for i, b in enumerate(AGE_BANDS, start=1)
)


@query(
    "o11_reference_pivot",
    sql(
        *SQL_TOP_LABS,
        _sql_served("(SELECT * FROM clean WHERE value IS NOT NULL)", "served_units", "m.concept_id, m.unit"),
        """both_refs AS (SELECT concept_id, unit, gender_source_value, age_range, range_low AS v_low, NULL AS v_high FROM refs_low
        UNION ALL SELECT concept_id, unit, gender_source_value, age_range, NULL, range_high FROM refs_high)""",
        select=f"""SELECT t.concept_id, c.concept_name, t.direction, t.concept_count, u.unit, {_WIDE}
        FROM top_labs t JOIN (SELECT DISTINCT concept_id, unit FROM served_units) u ON u.concept_id = t.concept_id
        JOIN concept c ON c.concept_id = t.concept_id""",
    ),
)
def _(r):
    top, meas, low, high = top_labs(r)
    return outcomes.reference_pivot(materialize(top), eligibility(r), meas, low, high, r["concept"])


@query(
    "o12_concept_group",
    sql(
        *SQL_ELIGIBLE,
        SQL_COUNTS,
        select="""SELECT * FROM counts WHERE (concept_name ILIKE '%procedure 10%' OR concept_name ILIKE '%RE 11%')
        AND concept_name NOT ILIKE '%107%'""",
    ),
)
def _(r):
    return outcomes.concept_group(procedure_counts(r), ["procedure 10", "RE 11"], ["107"])


@query(
    "o13_lab_frequency_over_time",
    sql(
        *SQL_ELIGIBLE,
        *ls.CLEAN,
        _sql_served("(SELECT * FROM clean WHERE value IS NOT NULL AND concept_id IN (300, 301))", "served", "1 AS one"),
        "per_date AS (SELECT end_date, count(*) AS n FROM served GROUP BY end_date)",
        select="""SELECT CAST(d.index_date AS VARCHAR) AS index_date, coalesce(p.n, 0) AS count
        FROM dates d LEFT JOIN per_date p ON d.index_date = p.end_date""",
    ),
)
def _(r):
    elig = eligibility(r)
    calendar = cohort.index_dates(r.spark, FIRST, LAST)
    return outcomes.lab_frequency_over_time(None, elig, clean(r), calendar, [300, 301])


@query(
    "o14_order_and_value_rate",
    sql(
        *SQL_COHORT,
        select="""SELECT year(m.event_date) AS year, count(*) AS num_orders, count(m.value) AS num_valued,
        round(count(*) / CAST((SELECT count(*) FROM people) AS DOUBLE), 6) AS orders_per_person,
        round(count(m.value) / CAST(count(*) AS DOUBLE), 6) AS value_rate
        FROM measurement m WHERE m.person_id IN (SELECT person_id FROM people) AND m.concept_id = 300
        AND m.event_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY 1""",
    ),
)
def _(r):
    return outcomes.order_and_value_rate(
        eligibility(r), r["measurement"], 300, dt.date(1997, 1, 1), dt.date(1999, 12, 31)
    )


SQL_YEARLY = """yearly AS (SELECT year(end_date) AS year, count(*) AS num_samples, CAST(sum(y) AS BIGINT) AS num_positive,
    avg(CAST(y AS DOUBLE)) AS rate FROM outcome GROUP BY 1)"""


@query(
    "o15_cohort_size_and_rate",
    sql(*SQL_OUTCOME, SQL_YEARLY, select="SELECT year, num_samples, num_positive, round(rate, 6) AS rate FROM yearly"),
)
def _(r):
    return outcomes.cohort_size_and_rate(procedure_outcome(r))


def outcomes_by_concept(r, concepts):
    """Labels of several single-concept outcomes, stacked."""
    elig = eligibility(r)
    stacked = None
    for c in concepts:
        rows = outcomes.recurrent_outcome(elig, None, r["procedure_occurrence"], [c], numbered=False)
        rows = rows.withColumn("outcome", F.lit(f"procedure_{c}"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked


SQL_STACKED = (
    *SQL_ELIGIBLE,
    "ev_103 AS (SELECT person_id, event_date FROM procedure_occurrence WHERE concept_id = 103)",
    "ev_107 AS (SELECT person_id, event_date FROM procedure_occurrence WHERE concept_id = 107)",
    *sql_outcome("ev_103", "out_103"),
    *sql_outcome("ev_107", "out_107"),
    """stacked AS (SELECT *, 'procedure_103' AS outcome FROM out_103 UNION ALL SELECT *, 'procedure_107' FROM out_107)""",
    """stacked_yearly AS (SELECT outcome, year(end_date) AS year, count(*) AS num_samples, CAST(sum(y) AS BIGINT) AS num_positive
    FROM stacked GROUP BY 1, 2)""",
)


def stacked_yearly(r):
    rows = outcomes_by_concept(r, PROCEDURES)
    return rows.groupBy("outcome", F.year("end_date").alias("year")).agg(
        F.count(F.lit(1)).alias("num_samples"), F.sum("y").alias("num_positive")
    )


@query(
    "o16_year_over_year_change",
    sql(
        *SQL_STACKED,
        select="""SELECT outcome, year, num_samples, num_positive,
        lag(num_samples) OVER w AS num_samples_previous, num_samples - lag(num_samples) OVER w AS num_samples_change,
        lag(num_positive) OVER w AS num_positive_previous, num_positive - lag(num_positive) OVER w AS num_positive_change
        FROM stacked_yearly WINDOW w AS (PARTITION BY outcome ORDER BY year)""",
    ),
)
def _(r):
    return outcomes.year_over_year_change(stacked_yearly(r), "outcome", ["num_samples", "num_positive"])


@query(
    "o17_variant_share_over_time",
    sql(
        *SQL_STACKED,
        select="""SELECT s.year, s.outcome, s.num_positive, round(s.num_positive / CAST(t.size AS DOUBLE), 6) AS share
        FROM stacked_yearly s JOIN (SELECT year(end_date) AS year, count(*) AS size FROM eligibility GROUP BY 1) t ON t.year = s.year""",
    ),
)
def _(r):
    sizes = eligibility(r).groupBy(F.year("end_date").alias("year")).agg(F.count(F.lit(1)).alias("size"))
    return outcomes.variant_share_over_time(stacked_yearly(r), sizes, "outcome", "num_positive", "size")


# ------------------------------------------------------------------ splits

SPLIT_SEED = 5

SQL_STRATA = """strata AS (SELECT person_id, coalesce(CAST(min(CASE WHEN y = 1 THEN end_date END) AS VARCHAR), 'never') AS stratum
    FROM outcome GROUP BY person_id)"""
SQL_SPLIT = (
    SQL_STRATA,
    f"hashed AS (SELECT *, {hash32_sql(SPLIT_SEED, 'person_id')} AS h FROM strata)",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, person_id) AS rk,
        count(*) OVER (PARTITION BY stratum) AS n FROM hashed)""",
    "tested AS (SELECT *, CASE WHEN (stratum = 'never' OR n >= 5) AND rk <= ceil(0.2E0 * n) THEN 1 ELSE 0 END AS is_test FROM ranked)",
    """folded AS (SELECT person_id, stratum, is_test, CASE WHEN stratum <> 'never' AND n < 5 THEN -1
        ELSE ntile(4) OVER (PARTITION BY stratum ORDER BY h, person_id) - 1 END AS fold FROM tested WHERE is_test = 0)""",
    "split_people AS (SELECT * FROM folded UNION ALL SELECT person_id, stratum, 1, -1 FROM tested WHERE is_test = 1)",
)
SQL_SAMPLES = f"""samples AS (SELECT o.person_id, o.end_date, year(o.end_date) AS year,
    CASE WHEN s.is_test = 1 THEN 'test' WHEN s.fold = 0 THEN 'valid' ELSE 'train' END AS split, o.y,
    {hash32_sql(0, 'o.person_id', 'o.end_date')} AS order_hash
    FROM outcome o JOIN split_people s ON s.person_id = o.person_id)"""
SQL_SAMPLED = (*SQL_OUTCOME, *SQL_SPLIT, SQL_SAMPLES)


def split(r, labelled=None):
    labelled = procedure_outcome(r) if labelled is None else labelled
    return splits.split_people(splits.outcome_stratum(labelled), SPLIT_SEED)


def samples(r):
    labelled = procedure_outcome(r)
    return r.stage("samples", lambda: splits.yearly_samples(labelled, split(r, labelled), fold=0))


@query("d01_outcome_stratum", sql(*SQL_OUTCOME, SQL_STRATA, select="SELECT * FROM strata"))
def _(r):
    return splits.outcome_stratum(procedure_outcome(r))


@query("d02_test_split", sql(*SQL_OUTCOME, *SQL_SPLIT, select="SELECT person_id, stratum, is_test FROM tested"))
def _(r):
    return splits.test_split(splits.outcome_stratum(procedure_outcome(r)), SPLIT_SEED)


@query("d03_k_folds", sql(*SQL_OUTCOME, *SQL_SPLIT, select="SELECT person_id, stratum, fold FROM folded"))
def _(r):
    return splits.k_folds(splits.outcome_stratum(procedure_outcome(r)), SPLIT_SEED)


_SAMPLE = "person_id, CAST(end_date AS VARCHAR) AS end_date, year, split, y"


@query("d04_yearly_samples", sql(*SQL_SAMPLED, select=f"SELECT {_SAMPLE}, order_hash FROM samples"))
def _(r):
    return samples(r)


@query(
    "d05_split_counts",
    sql(
        *SQL_SAMPLED,
        select="""SELECT year, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid,
        count(*) FILTER (split = 'test') AS test FROM samples GROUP BY year""",
    ),
)
def _(r):
    return splits.split_counts(samples(r))


@query(
    "d06_person_samples",
    sql(
        *SQL_SAMPLED,
        f"""placed AS (SELECT *, row_number() OVER (PARTITION BY year, split
            ORDER BY {hash32_sql(3, 'person_id', 'end_date')}, person_id, end_date) - 1 AS pos FROM samples)""",
        select="""SELECT person_id, year, split, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS sample_positions
        FROM placed GROUP BY person_id, year, split""",
    ),
)
def _(r):
    listed = splits.person_samples(samples(r), seed=3)
    return listed.withColumn("sample_positions", F.array_join(F.col("sample_positions").cast("array<string>"), ","))


@query(
    "d08_balanced_weights",
    sql(
        *SQL_SAMPLED,
        select=f"""SELECT {_SAMPLE}, order_hash, round(count(*) OVER () / (2.0E0 * count(*) OVER (PARTITION BY y)), 6) AS weight
        FROM samples""",
    ),
)
def _(r):
    return splits.balanced_weights(samples(r))
