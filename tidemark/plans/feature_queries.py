"""Queries on dated events, windowed features and the feature catalogue, and the flagship query."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.functions.expressions import hash32_sql
from tidemark.functions.ranking import hash_rank
from tidemark.operators import features, shift, splits
from tidemark.plans import lab_sql as ls
from tidemark.plans.common import FIRST, LAST, SQL_COHORT, SQL_DATES, people
from tidemark.plans.lab_queries import clean, references
from tidemark.plans.outcome_queries import SQL_SAMPLED, samples
from tidemark.plans.registry import query, sql
from tidemark.session import materialize

WINDOWS = (30, 365)
_EVENT = """example_id, person_id, concept_name, CAST(feature_start_date AS VARCHAR) AS feature_start_date,
    CAST(person_end_date AS VARCHAR) AS person_end_date"""


def _sql_events(name: str, source: str, kind: str) -> str:
    return f"""{name} AS (SELECT p.example_id, p.person_id,
        concat(CAST(e.concept_id AS VARCHAR), ' - {kind} - ', c.concept_name) AS concept_name,
        e.event_date AS feature_start_date, p.end_date AS person_end_date
        FROM people p JOIN {source} e ON p.person_id = e.person_id AND e.event_date <= p.end_date
        JOIN concept c ON c.concept_id = e.concept_id)"""


SQL_CONDITIONS = _sql_events("cond_feats", "condition_occurrence", "condition")
SQL_DRUGS = _sql_events("drug_feats", "drug_exposure", "drug")
SQL_PROCS = _sql_events("proc_feats", "procedure_occurrence", "procedure")
SQL_SPECIALTIES = _sql_events(
    "spec_feats",
    """(SELECT v.person_id, pr.specialty_concept_id AS concept_id, v.visit_start_date AS event_date
        FROM visit_occurrence v JOIN provider pr ON pr.provider_id = v.provider_id)""",
    "specialty",
)


@query("f01_condition_events", sql(*SQL_COHORT, SQL_CONDITIONS, select=f"SELECT {_EVENT} FROM cond_feats"))
def _(r):
    return features.condition_events(people(r), r["condition_occurrence"], r["concept"])


@query("f02_drug_events", sql(*SQL_COHORT, SQL_DRUGS, select=f"SELECT {_EVENT} FROM drug_feats"))
def _(r):
    return features.drug_events(people(r), r["drug_exposure"], r["concept"])


@query("f03_procedure_events", sql(*SQL_COHORT, SQL_PROCS, select=f"SELECT {_EVENT} FROM proc_feats"))
def _(r):
    return features.procedure_events(people(r), r["procedure_occurrence"], r["concept"])


@query("f04_specialty_events", sql(*SQL_COHORT, SQL_SPECIALTIES, select=f"SELECT {_EVENT} FROM spec_feats"))
def _(r):
    return features.specialty_events(people(r), r["visit_occurrence"], r["provider"], r["concept"])


@query(
    "f05_static_year_of_birth",
    sql(
        *SQL_COHORT,
        select="""SELECT p.example_id, p.person_id, q.year_of_birth AS ntmp_val, 'year_of_birth' AS concept_name
        FROM people p JOIN person q ON p.person_id = q.person_id""",
    ),
)
def _(r):
    return features.static_year_of_birth(people(r), r["person"])


@query(
    "f06_static_flag",
    sql(
        *SQL_COHORT,
        select="""SELECT p.example_id, p.person_id, CASE WHEN q.gender_source_value = 'M' THEN 1 ELSE 0 END AS ntmp_val,
        'Male' AS concept_name FROM people p JOIN person q ON p.person_id = q.person_id
        UNION ALL SELECT p.example_id, p.person_id, CASE WHEN q.race_concept_id = 1 THEN 1 ELSE 0 END, 'White'
        FROM people p JOIN person q ON p.person_id = q.person_id
        UNION ALL SELECT p.example_id, p.person_id, CASE WHEN q.race_concept_id = 2 THEN 1 ELSE 0 END, 'Asian'
        FROM people p JOIN person q ON p.person_id = q.person_id""",
    ),
)
def _(r):
    gender = features.static_flags(people(r), r["person"], "gender_source_value", {"Male": "M"})
    race = features.static_flags(people(r), r["person"], "race_concept_id", {"White": 1, "Asian": 2})
    return gender.unionByName(race)


# ------------------------------------------------------------ measurements

SQL_LABS = (
    *SQL_COHORT,
    *ls.CLEAN,
    """cm AS (SELECT p.example_id, p.person_id, m.concept_id, c.concept_name, m.value, m.unit, m.event_date AS feature_start_date,
        p.end_date AS person_end_date FROM people p JOIN clean m ON p.person_id = m.person_id AND m.event_date <= p.end_date
        JOIN concept c ON c.concept_id = m.concept_id)""",
    "cmv AS (SELECT * FROM cm WHERE value IS NOT NULL)",
    """quartiles AS (SELECT concept_id, unit, percentile_disc(0.25) WITHIN GROUP (ORDER BY value) AS p25,
        percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.75) WITHIN GROUP (ORDER BY value) AS p75
        FROM cmv GROUP BY concept_id, unit)""",
    "cmq AS (SELECT m.*, q.p25, q.p50, q.p75 FROM cmv m JOIN quartiles q ON m.concept_id = q.concept_id AND m.unit = q.unit)",
    """changes AS (SELECT *, value - lag(value) OVER (PARTITION BY example_id, concept_id ORDER BY feature_start_date, value) AS change
        FROM cmv)""",
)


def _lab(state: str, source: str, where: str = "TRUE") -> str:
    return f"""SELECT example_id, person_id, concat(CAST(concept_id AS VARCHAR), ' - lab - ', concept_name, ' - {state}') AS concept_name,
        feature_start_date, person_end_date FROM {source} WHERE {where}"""


_ORDERED = _lab("ordered", "cm")
_QUARTILE = " UNION ".join(
    [
        _lab("below 25th percentile", "cmq", "value < p25"),
        _lab("25th to 50th percentile", "cmq", "value >= p25 AND value < p50"),
        _lab("50th to 75th percentile", "cmq", "value >= p50 AND value < p75"),
        _lab("above 75th percentile", "cmq", "value >= p75"),
    ]
)
_TREND = " UNION ".join([_lab("increasing", "changes", "change > 0"), _lab("decreasing", "changes", "change < 0")])
_RANGE = " UNION ".join(
    [
        _lab("below range", "ranged", "value < range_low"),
        _lab(
            "in range",
            "ranged",
            """(value >= range_low AND value <= range_high) OR (range_low IS NULL AND value <= range_high)
            OR (range_high IS NULL AND value >= range_low)""",
        ),
        _lab("above range", "ranged", "value > range_high"),
    ]
)
SQL_RANGED = (
    *SQL_COHORT,
    *ls.REFS,
    *SQL_LABS[len(SQL_COHORT) + len(ls.CLEAN) :],
    f"""ranged AS (SELECT m.*, lo.range_low, hi.range_high FROM (
        SELECT v.*, p.gender_source_value, {ls.band('(year(v.feature_start_date) - p.year_of_birth)')} AS age_range
        FROM cmv v JOIN person p ON p.person_id = v.person_id) m
        LEFT JOIN refs_low lo ON lo.concept_id = m.concept_id AND lo.unit = m.unit AND lo.gender_source_value = m.gender_source_value
        AND lo.age_range = m.age_range
        LEFT JOIN refs_high hi ON hi.concept_id = m.concept_id AND hi.unit = m.unit AND hi.gender_source_value = m.gender_source_value
        AND hi.age_range = m.age_range)""",
)


def measured(r):
    """Cohort measurements as a stage: quartiles, trends and states each read them."""
    return r.stage("measured", lambda: features.cohort_measurements(people(r), clean(r), r["concept"]))


@query("f07_lab_ordered", sql(*SQL_LABS, f"out AS (SELECT DISTINCT * FROM ({_ORDERED}))", select=f"SELECT {_EVENT} FROM out"))
def _(r):
    return features.lab_ordered(measured(r))


@query("f08_lab_quartiles", sql(*SQL_LABS, select="SELECT * FROM quartiles"))
def _(r):
    return features.lab_quartiles(measured(r))


@query("f09_lab_quartile_bucket", sql(*SQL_LABS, f"out AS ({_QUARTILE})", select=f"SELECT {_EVENT} FROM out"))
def _(r):
    rows = measured(r)
    return features.lab_quartile_bucket(rows, features.lab_quartiles(rows))


@query("f10_lab_trend", sql(*SQL_LABS, f"out AS ({_TREND})", select=f"SELECT {_EVENT} FROM out"))
def _(r):
    return features.lab_trend(measured(r))


@query("f11_lab_range_state", sql(*SQL_RANGED, f"out AS ({_RANGE})", select=f"SELECT {_EVENT} FROM out"))
def _(r):
    return features.lab_range_state(measured(r), r.stored("person"), references(r, "low"), references(r, "high"))


@query(
    "f12_lab_features",
    sql(*SQL_RANGED, f"out AS ({_QUARTILE} UNION {_TREND} UNION {_RANGE} UNION {_ORDERED})", select=f"SELECT {_EVENT} FROM out"),
)
def _(r):
    rows = measured(r)
    return features.lab_features(
        rows, r.stored("person"), features.lab_quartiles(rows), references(r, "low"), references(r, "high")
    )


# --------------------------------------------------------------- timelines

SQL_TIMELINE = (
    *SQL_COHORT,
    SQL_CONDITIONS,
    SQL_DRUGS,
    SQL_PROCS,
    SQL_SPECIALTIES,
    """timeline AS (SELECT * FROM cond_feats UNION ALL SELECT * FROM drug_feats UNION ALL SELECT * FROM proc_feats
        UNION ALL SELECT * FROM spec_feats)""",
    f"""feature_ids AS (SELECT feature, split_part(feature, ' - ', 2) AS type,
        row_number() OVER (ORDER BY {hash32_sql(0, 'feature')}, feature) - 1 AS feature_id
        FROM (SELECT DISTINCT concept_name AS feature FROM timeline))""",
)


def timeline(r):
    cohort = people(r)
    return features.event_timeline(
        [
            features.condition_events(cohort, r["condition_occurrence"], r["concept"]),
            features.drug_events(cohort, r["drug_exposure"], r["concept"]),
            features.procedure_events(cohort, r["procedure_occurrence"], r["concept"]),
            features.specialty_events(cohort, r["visit_occurrence"], r["provider"], r["concept"]),
        ]
    )


@query("f13_event_timeline", sql(*SQL_TIMELINE, select=f"SELECT {_EVENT} FROM timeline"))
def _(r):
    return timeline(r)


@query("f14_feature_index", sql(*SQL_TIMELINE, select="SELECT * FROM feature_ids"))
def _(r):
    return features.feature_index(timeline(r))


@query(
    "f15_coordinate_tensor",
    sql(
        *SQL_TIMELINE,
        select="""SELECT DISTINCT t.person_id, CAST(t.feature_start_date AS VARCHAR) AS event_date, i.feature_id
        FROM timeline t JOIN feature_ids i ON i.feature = t.concept_name""",
    ),
)
def _(r):
    events = timeline(r)
    return features.coordinate_tensor(events, features.feature_index(events))


def _sql_windowed(source: str, name: str = "windowed") -> str:
    return f"""{name} AS (SELECT DISTINCT e.person_id, d.index_date AS end_date, e.feature, w.days AS window_days
        FROM {source} e JOIN dates d ON e.event_date < d.index_date
        JOIN (VALUES (30), (365)) w(days) ON e.event_date >= d.index_date - w.days)"""


SQL_PROC_EVENTS = """proc_named AS (SELECT person_id, event_date,
    concat(CAST(concept_id AS VARCHAR), ' - procedure - Procedure ', CAST(concept_id AS VARCHAR)) AS feature FROM procedure_occurrence)"""
SQL_COND_EVENTS = """cond_named AS (SELECT person_id, event_date,
    concat(CAST(concept_id AS VARCHAR), ' - condition - Condition ', CAST(concept_id AS VARCHAR)) AS feature FROM condition_occurrence)"""


def named_events(r, source, kind):
    """Events with their composed feature name; the name needs no join in this binding."""
    word = kind.capitalize()
    text = F.col("concept_id").cast("string")
    name = F.concat(text, F.lit(f" - {kind} - {word} "), text)
    return r[source].select("person_id", "event_date", name.alias("feature"))


@query(
    "f16_windowed_features",
    sql(
        SQL_DATES,
        SQL_PROC_EVENTS,
        _sql_windowed("proc_named"),
        select="SELECT person_id, CAST(end_date AS VARCHAR) AS end_date, feature, window_days FROM windowed",
    ),
)
def _(r):
    return features.windowed_features(named_events(r, "procedure_occurrence", "procedure"), FIRST, LAST, WINDOWS)


_MONTH_FLAGS = ", ".join(f"CASE WHEN month(end_date) = {m} THEN 1 ELSE 0 END AS month_{m}" for m in range(1, 13))


def aged_samples(r):
    born = r["person"].select("person_id", "year_of_birth")
    return samples(r).join(born, "person_id").withColumn("age", features.age_at("end_date", "year_of_birth"))


SQL_AGED = (
    *SQL_SAMPLED,
    """aged AS (SELECT s.*, p.year_of_birth, year(s.end_date) - p.year_of_birth AS age
        FROM samples s JOIN person p ON p.person_id = s.person_id)""",
    """age_params AS (SELECT avg(age) AS age_mean, stddev_pop(age) AS age_std FROM aged WHERE split = 'train')""",
)
_KEY = "person_id, CAST(end_date AS VARCHAR) AS end_date"


@query("f17_age_at", sql(*SQL_AGED, select=f"SELECT {_KEY}, age FROM aged"))
def _(r):
    return aged_samples(r).select("person_id", "end_date", "age")


@query("f18_month_one_hot", sql(*SQL_SAMPLED, select=f"SELECT {_KEY}, {_MONTH_FLAGS} FROM samples"))
def _(r):
    return samples(r).select("person_id", "end_date", *features.month_one_hot("end_date"))


SQL_LONG = (
    *SQL_SAMPLED,
    SQL_PROC_EVENTS,
    SQL_COND_EVENTS,
    "all_named AS (SELECT * FROM proc_named UNION ALL SELECT * FROM cond_named)",
    _sql_windowed("all_named"),
    """long_all AS (SELECT s.person_id, s.end_date, s.year, s.split, s.y,
        concat(w.feature, ' - ', CAST(w.window_days AS VARCHAR), ' days') AS feature
        FROM samples s JOIN windowed w ON w.person_id = s.person_id AND w.end_date = s.end_date)""",
    """frequent AS (SELECT feature, count(*) AS train_count FROM long_all WHERE split = 'train' GROUP BY feature
        HAVING count(*) >= 300)""",
    "long AS (SELECT * FROM long_all WHERE feature IN (SELECT feature FROM frequent))",
)


def sample_sets(r, windows=WINDOWS, sampled=None):
    """Samples with the windowed features of both event kinds that are present, as an array."""
    events = named_events(r, "procedure_occurrence", "procedure").unionByName(
        named_events(r, "condition_occurrence", "condition")
    )
    sampled = samples(r) if sampled is None else sampled
    events = events.join(sampled.select("person_id").distinct(), "person_id", "left_semi")
    return features.sample_sets(sampled.drop("order_hash"), events, windows)


def long_samples(r, windows=WINDOWS, sampled=None):
    """Samples with one row per present windowed feature of both event kinds."""
    return features.one_per_feature(sample_sets(r, windows, sampled))


def stored_long(r, windows=WINDOWS, sampled=None):
    """The same rows for steps that read them more than once: what is stored is one row per sample, with its features as an array."""
    return features.one_per_feature(materialize(sample_sets(r, windows, sampled)))


def dataset(r):
    rows = stored_long(r)
    return features.keep_features(rows, features.frequent_features(rows, 300))


@query(
    "f19_feature_names",
    sql(
        *SQL_LONG,
        select="""SELECT DISTINCT feature, CAST(split_part(feature, ' - ', 1) AS BIGINT) AS concept_id, split_part(feature, ' - ', 2) AS type,
        split_part(feature, ' - ', 3) AS concept_name, CAST(NULL AS VARCHAR) AS variant,
        CAST(replace(split_part(feature, ' - ', 4), ' days', '') AS INT) AS window_days FROM long_all""",
    ),
)
def _(r):
    names = long_samples(r).select("feature").distinct()
    return names.select("feature", *features.parse_feature_name())


@query("f20_frequent_features", sql(*SQL_LONG, select="SELECT * FROM frequent"))
def _(r):
    return features.frequent_features(long_samples(r), 300)


@query(
    "f21_standardize_age",
    sql(
        *SQL_AGED,
        select=f"""SELECT {_KEY}, split, age, round((age - age_mean) / age_std, 6) AS age_scaled FROM aged, age_params""",
    ),
)
def _(r):
    rows = aged_samples(r)
    scaled = features.standardize_age(rows, features.age_scaling(rows))
    return scaled.select("person_id", "end_date", "split", "age", "age_scaled")


@query("f22_unstandardize_age", sql(*SQL_AGED, select=f"SELECT {_KEY}, age, round(CAST(age AS DOUBLE), 6) AS age_restored FROM aged"))
def _(r):
    rows = aged_samples(r)
    params = features.age_scaling(rows)
    restored = features.unstandardize_age(features.standardize_age(rows, params), params)
    return restored.select("person_id", "end_date", "age", "age_restored")


_OTHER_FOLD = "CASE WHEN s.is_test = 1 THEN 'test' WHEN s.fold = 1 THEN 'valid' ELSE 'train' END"


@query(
    "f23_apply_fold_features",
    sql(
        *SQL_LONG,
        select=f"""SELECT l.person_id, CAST(l.end_date AS VARCHAR) AS end_date, l.year, {_OTHER_FOLD} AS split, l.y, l.feature
        FROM long l JOIN split_people s ON s.person_id = l.person_id""",
    ),
)
def _(r):
    from tidemark.plans.outcome_queries import procedure_outcome, split

    labelled = procedure_outcome(r)
    parts = split(r, labelled)
    fitted = features.frequent_features(long_samples(r), 300)
    other = splits.yearly_samples(labelled, parts, fold=1)
    aged = other.join(r["person"].select("person_id", "year_of_birth"), "person_id").withColumn(
        "age", features.age_at("end_date", "year_of_birth")
    )
    rows, _ = features.apply_fold_features(
        long_samples(r, sampled=other), aged, fitted, features.age_scaling(aged_samples(r))
    )
    return rows


@query(
    "f24_feature_set",
    sql(
        *SQL_TIMELINE,
        select="""SELECT DISTINCT concept_name AS feature FROM timeline
        WHERE split_part(concept_name, ' - ', 2) IN ('condition', 'procedure')""",
    ),
)
def _(r):
    names = timeline(r).select(F.col("concept_name").alias("feature")).distinct()
    return features.feature_set(names, "cond_proc")


@query(
    "f26_interaction_terms",
    sql(
        *SQL_LONG,
        select=f"""SELECT {_KEY}, year, split, y, CASE WHEN y = 1 THEN concat('imaging (Y) & ', feature)
        ELSE concat('no imaging (Y) & ', feature) END AS feature FROM long""",
    ),
)
def _(r):
    return features.interaction_terms(dataset(r), "imaging")


_CATALOG = """SELECT feature, CAST(split_part(feature, ' - ', 1) AS BIGINT) AS concept_id, split_part(feature, ' - ', 2) AS type,
    split_part(feature, ' - ', 3) AS concept_name,
    CASE WHEN split_part(feature, ' - ', 2) = 'lab' THEN split_part(feature, ' - ', 4) END AS variant,
    30 AS window_days,
    concat(left(CASE WHEN split_part(feature, ' - ', 2) = 'lab' THEN concat(split_part(feature, ' - ', 3), ' - ', split_part(feature, ' - ', 4))
        ELSE split_part(feature, ' - ', 3) END, 25), ' 30 days') AS label
    FROM (SELECT DISTINCT concat(concept_name, ' - 30 days') AS feature FROM out)"""


@query(
    "f27_feature_catalog",
    sql(
        *SQL_RANGED,
        SQL_CONDITIONS,
        f"lab_out AS ({_QUARTILE} UNION {_TREND} UNION {_RANGE} UNION {_ORDERED})",
        "out AS (SELECT concept_name FROM lab_out UNION SELECT concept_name FROM cond_feats)",
        f"catalog AS ({_CATALOG})",
        select="""SELECT *, concat('no ', label) AS negated_label,
        concat(CAST(concept_id AS VARCHAR), '_', regexp_replace(label, '[ /]', '_', 'g')) AS file_key,
        concat('no_', CAST(concept_id AS VARCHAR), '_', regexp_replace(label, '[ /]', '_', 'g')) AS negated_file_key FROM catalog""",
    ),
)
def _(r):
    rows = measured(r)
    lab = features.lab_features(
        rows, r.stored("person"), features.lab_quartiles(rows), references(r, "low"), references(r, "high")
    )
    events = features.event_timeline([lab, features.condition_events(people(r), r["condition_occurrence"], r["concept"])])
    names = events.select(F.concat("concept_name", F.lit(" - 30 days")).alias("feature"))
    return features.feature_catalog(names)


@query(
    "f28_feature_statistics",
    sql(
        *SQL_LABS,
        f"out AS ({_QUARTILE} UNION {_TREND} UNION {_ORDERED})",
        select="""SELECT count(DISTINCT concept_name) AS num_features, count(DISTINCT split_part(concept_name, ' - lab -', 1)) AS num_lab_concepts
        FROM out""",
    ),
)
def _(r):
    rows = measured(r)
    quartiles = features.lab_quartiles(rows)
    parts = [features.lab_quartile_bucket(rows, quartiles), features.lab_trend(rows), features.lab_ordered(rows)]
    names = functools.reduce(lambda a, b: a.unionByName(b), parts).select(F.col("concept_name").alias("feature"))
    return features.feature_statistics(features.feature_catalog(names))


@query(
    "d07_build_dataset",
    sql(*SQL_LONG, select=f"SELECT {_KEY}, year, split, y, feature FROM long"),
)
def _(r):
    return dataset(r)


@query(
    "d07_dataset_samples",
    sql(
        *SQL_AGED,
        *SQL_LONG[len(SQL_SAMPLED) :],
        "held AS (SELECT person_id, end_date, count(*) AS num_features FROM long GROUP BY 1, 2)",
        f"""placed AS (SELECT *, row_number() OVER (PARTITION BY year, split
            ORDER BY {hash32_sql(3, 'person_id', 'end_date')}, person_id, end_date) - 1 AS position FROM aged)""",
        select=f"""SELECT p.person_id, CAST(p.end_date AS VARCHAR) AS end_date, p.year, p.split, p.y, p.position,
        round((p.age - age_mean) / age_std, 6) AS age_scaled, {_MONTH_FLAGS.replace("end_date", "p.end_date")},
        coalesce(h.num_features, 0) AS num_features FROM placed p CROSS JOIN age_params
        LEFT JOIN held h ON h.person_id = p.person_id AND h.end_date = p.end_date""",
    ),
)
def _(r):
    """The samples of the dataset with age, month flags, position and the number of their frequent features."""
    rows = aged_samples(r)
    scaled = features.standardize_age(rows, features.age_scaling(rows))
    ranked = hash_rank(scaled, ["person_id", "end_date"], by=["year", "split"], seed=3)
    held = dataset(r).groupBy("person_id", "end_date").agg(F.count(F.lit(1)).alias("num_features"))
    return ranked.join(held, ["person_id", "end_date"], "left").select(
        "person_id", "end_date", "year", "split", "y", (F.col("rank") - 1).alias("position"), "age_scaled",
        *features.month_one_hot("end_date"), F.coalesce("num_features", F.lit(0)).alias("num_features"),
    )


# ---------------------------------------------------------------- flagship


@query(
    "flagship_yearly_rate",
    sql(
        *SQL_LONG[:-2],
        select="""SELECT s.year, CASE WHEN f.person_id IS NULL THEN 0 ELSE 1 END AS has_feature, count(*) AS num_samples,
        CAST(sum(s.y) AS BIGINT) AS num_positive, round(avg(CAST(s.y AS DOUBLE)), 6) AS rate
        FROM samples s LEFT JOIN (SELECT DISTINCT person_id, end_date FROM long_all
            WHERE feature = '105 - procedure - Procedure 105 - 365 days') f
        ON f.person_id = s.person_id AND f.end_date = s.end_date GROUP BY 1, 2""",
    ),
)
def _(r):
    feature = "105 - procedure - Procedure 105"
    events = named_events(r, "procedure_occurrence", "procedure").where(F.col("feature") == feature)
    present = features.windowed_features(events, FIRST, LAST, [365]).select("person_id", "end_date").distinct()
    return shift.rate_with_and_without(samples(r), present)
