"""Queries on domain shift and conditional shift."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.functions.expressions import chi2_p_sql, hash32_sql
from tidemark.operators import features, shift
from tidemark.operators import metrics as me
from tidemark.plans.common import FIRST, LAST
from tidemark.plans.feature_queries import (
    SQL_AGED,
    SQL_LABS,
    SQL_LONG,
    _lab,
    aged_samples,
    dataset,
    long_samples,
    measured,
    named_events,
    sample_sets,
    stored_long,
)
from tidemark.plans.metric_queries import (
    REPLICATES,
    SEED,
    SQL_MODELS,
    SQL_SCORES,
    scored,
    scores,
    sql_actual,
    sql_auc,
    sql_bootstrap,
    sql_ci,
    sql_entries_datasets,
    sql_entries_models,
)
from tidemark.plans.outcome_queries import SQL_SAMPLED, samples
from tidemark.plans.region_queries import _METRICS, SQL_COEFS, _sql_metrics, log_odds
from tidemark.plans.registry import query, sql
from tidemark.session import materialize

_KEY = "person_id, CAST(end_date AS VARCHAR) AS end_date"
PROC = "{0} - procedure - Procedure {0} - {1} days"
COND = "{0} - condition - Condition {0} - {1} days"


@query(
    "x01_restrict_months_and_features",
    sql(*SQL_LONG, select=f"SELECT {_KEY}, feature FROM long_all WHERE month(end_date) BETWEEN 4 AND 12 AND feature LIKE '% - 30 days'"),
)
def _(r):
    rows = shift.restrict_months_and_features(long_samples(r, windows=(30,)), (4, 12), " - 30 days")
    return rows.select("person_id", "end_date", "feature")


SQL_FREQ = (
    *SQL_LONG,
    """sizes AS (SELECT count(*) FILTER (year = 1998) AS n1, count(*) FILTER (year = 1999) AS n2 FROM samples WHERE split = 'test')""",
    """counted AS (SELECT feature, count(*) FILTER (split = 'valid') AS num_valid, count(*) FILTER (split = 'test' AND year = 1998) AS with_prev,
        count(*) FILTER (split = 'test' AND year = 1999) AS with_curr FROM long_all WHERE year IN (1998, 1999) AND split IN ('valid', 'test') GROUP BY 1)""",
    """framed AS (SELECT feature, with_prev, n1 - with_prev AS without_prev, with_curr, n2 - with_curr AS without_curr,
        with_prev / CAST(n1 AS DOUBLE) AS freq_prev, with_curr / CAST(n2 AS DOUBLE) AS freq_curr FROM counted, sizes WHERE num_valid >= 20)""",
    """freq AS (SELECT *, CAST(with_prev + without_prev + with_curr + without_curr AS DOUBLE) * power(greatest(
        abs(CAST(with_prev AS DOUBLE) * without_curr - CAST(with_curr AS DOUBLE) * without_prev)
        - (with_prev + without_prev + with_curr + without_curr) / 2.0E0, 0), 2)
        / (CAST(with_prev + without_prev AS DOUBLE) * (with_curr + without_curr) * (with_prev + with_curr) * (without_prev + without_curr)) AS chi2
        FROM framed)""",
)


def frequencies(r):
    rows = samples(r)
    return shift.feature_frequency_shift(long_samples(r, sampled=rows), rows, 1998, 1999)


@query(
    "x03_feature_frequency_shift",
    sql(
        *SQL_FREQ,
        f"fp AS (SELECT *, {chi2_p_sql('chi2')} AS p FROM freq)",
        """fr_ranked AS (SELECT *, rank() OVER (ORDER BY p) AS rank, rank() OVER (ORDER BY p) / CAST(count(*) OVER () AS DOUBLE) * 0.05E0
            AS critical FROM fp)""",
        select="""SELECT feature, with_prev, without_prev, with_curr, without_curr, round(freq_prev, 6) AS freq_prev,
        round(freq_curr, 6) AS freq_curr, round(freq_prev + freq_curr, 6) AS freq_sum, round(chi2, 6) AS chi2, round(p, 6) AS chi2_p_value,
        rank, round(critical, 6) AS critical,
        coalesce(CASE WHEN rank <= (SELECT max(rank) FROM fr_ranked WHERE p < critical) THEN 1 ELSE 0 END, 0) AS accepted FROM fr_ranked""",
    ),
)
def _(r):
    return frequencies(r)


@query(
    "x04_frequency_ci",
    sql(
        *SQL_FREQ,
        "ns AS (SELECT count(*) FILTER (year = 1998) AS m1, count(*) FILTER (year = 1999) AS m2 FROM samples)",
        select="""SELECT feature, 'previous' AS period, round(freq_prev, 6) AS frequency, round(1.96E0 * sqrt(freq_prev * (1 - freq_prev) / m1), 6) AS half_width FROM freq, ns
        UNION ALL SELECT feature, 'current', round(freq_curr, 6), round(1.96E0 * sqrt(freq_curr * (1 - freq_curr) / m2), 6) FROM freq, ns""",
    ),
)
def _(r):
    rows = samples(r)

    def size(year):
        return rows.where(F.col("year") == year).agg(F.count(F.lit(1))).scalar()

    return shift.frequency_ci(frequencies(r), size(1998), size(1999))


SQL_TASKS = (
    *SQL_LONG,
    "seg AS (SELECT c_custkey AS person_id, c_mktsegment AS task FROM customer)",
    "tsamples AS (SELECT s.*, g.task FROM samples s JOIN seg g ON g.person_id = s.person_id)",
    """tclass AS (SELECT task, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM tsamples
        WHERE split = 'train' AND year = 1998 GROUP BY 1)""",
    """tcells AS (SELECT g.task, l.feature, sum(l.y) + 0.5E0 AS a, sum(1 - l.y) + 0.5E0 AS b, max(c.n1) - sum(l.y) + 0.5E0 AS c,
        max(c.n0) - sum(1 - l.y) + 0.5E0 AS d FROM long l JOIN seg g ON g.person_id = l.person_id JOIN tclass c ON c.task = g.task
        WHERE l.split = 'train' AND l.year = 1998 GROUP BY 1, 2)""",
    "tcoefs AS (SELECT task, feature, round(ln((a * d) / (b * c)), 6) AS coefficient FROM tcells)",
    """tyear AS (SELECT task, count(*) FILTER (year = 1998) AS n_prev, sum(y) FILTER (year = 1998) AS pos_prev,
        count(*) FILTER (year = 1999) AS n_curr, sum(y) FILTER (year = 1999) AS pos_curr FROM tsamples GROUP BY 1)""",
    """by_coef AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY coefficient DESC, feature) AS hi,
        row_number() OVER (PARTITION BY task ORDER BY coefficient, feature DESC) AS lo FROM tcoefs)""",
    """shifted AS (SELECT task, n_prev, pos_prev, n_curr, pos_curr, CAST(n_prev + n_curr AS DOUBLE) * power(greatest(
        abs(CAST(n_prev - pos_prev AS DOUBLE) * pos_curr - CAST(n_curr - pos_curr AS DOUBLE) * pos_prev) - (n_prev + n_curr) / 2.0E0, 0), 2)
        / (CAST(n_prev AS DOUBLE) * n_curr * (n_prev - pos_prev + n_curr - pos_curr) * (pos_prev + pos_curr)) AS chi2 FROM tyear)""",
)


@query(
    "x05_condition_dependent_tasks",
    sql(
        *SQL_TASKS,
        select=f"""SELECT task, n_prev, CAST(pos_prev AS BIGINT) AS pos_prev, n_curr, CAST(pos_curr AS BIGINT) AS pos_curr FROM shifted s
        WHERE {chi2_p_sql('chi2')} > 0.05E0 AND EXISTS (SELECT 1 FROM by_coef r WHERE r.task = s.task AND least(hi, lo) <= 6
        AND split_part(r.feature, ' - ', 2) = 'condition' AND abs(r.coefficient) > 0.01E0)""",
    ),
)
def _(r):
    task = r["customer"].select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("task"))
    rows = samples(r)
    y, prev, curr = F.col("y"), F.col("year") == 1998, F.col("year") == 1999
    yearly = rows.join(task, "person_id").groupBy("task").agg(
        F.sum(F.when(prev, 1).otherwise(0)).alias("n_prev"),
        F.sum(F.when(prev, y).otherwise(0)).alias("pos_prev"),
        F.sum(F.when(curr, 1).otherwise(0)).alias("n_curr"),
        F.sum(F.when(curr, y).otherwise(0)).alias("pos_curr"),
    )
    yearly = materialize(yearly)
    every = materialize(long_samples(r, sampled=rows).where("split = 'train'"))
    kept = features.keep_features(every, features.frequent_features(every, 300)).where(prev).join(task, "person_id")
    half = F.lit(0.5)
    sizes = rows.where((F.col("split") == "train") & prev).join(task, "person_id").groupBy("task").agg(
        F.sum(y).alias("n1"), F.sum(1 - y).alias("n0")
    )
    cells = kept.groupBy("task", "feature").agg(F.sum(y).alias("a0"), F.sum(1 - y).alias("b0")).join(sizes, "task")
    a, b = F.col("a0") + half, F.col("b0") + half
    c, d = F.col("n1") - F.col("a0") + half, F.col("n0") - F.col("b0") + half
    coefs = cells.select("task", "feature", F.round(F.log((a * d) / (b * c)), 6).alias("coefficient"))
    return shift.condition_dependent_tasks(yearly, coefs, yearly, 6)


# --------------------------------------------------------------- imputation

_F30, _F365 = PROC.format(103, 30), PROC.format(103, 365)
# The 30-day window is predicted from the 365-day one of the same procedure, the outcome from the 30-day one.
SQL_IMPUTED = (
    *SQL_LONG[:-2],
    f"""marks AS (SELECT person_id, end_date, max(CASE WHEN feature = '{_F30}' THEN 1 ELSE 0 END) AS f30,
        max(CASE WHEN feature = '{_F365}' THEN 1 ELSE 0 END) AS f365 FROM long_all WHERE feature IN ('{_F30}', '{_F365}') GROUP BY 1, 2)""",
    """flagged AS (SELECT s.person_id, s.end_date, s.year, s.split, s.y, coalesce(m.f30, 0) AS seen, coalesce(m.f365, 0) AS wide
        FROM samples s LEFT JOIN marks m ON m.person_id = s.person_id AND m.end_date = s.end_date)""",
    "classes AS (SELECT year, sum(seen) AS n1, sum(1 - seen) AS n0 FROM flagged WHERE split = 'train' GROUP BY 1)",
    """wide_fit AS (SELECT f.year, wide, sum(seen) * max(n0) / nullif(CAST(sum(seen) * max(n0) + sum(1 - seen) * max(n1) AS DOUBLE), 0) AS p
        FROM flagged f JOIN classes c USING (year) WHERE split = 'train' GROUP BY 1, 2)""",
    "lagged AS (SELECT *, year AS fit_year, 'current' AS fit FROM flagged UNION ALL SELECT *, year - 1, 'previous' FROM flagged)",
    """imputed AS (SELECT l.*, CASE WHEN seen = 1 OR coalesce(p, 0) >= 0.5E0 THEN 1 ELSE 0 END AS seen_imputed
        FROM (SELECT * FROM lagged WHERE fit_year IN (SELECT year FROM classes)) l LEFT JOIN wide_fit w ON w.year = l.fit_year AND w.wide = l.wide)""",
)


def flagged(r):
    rows = samples(r)
    present = long_samples(r, sampled=rows)
    marks = present.where(F.col("feature").isin(_F30, _F365)).groupBy("person_id", "end_date").agg(
        F.max((F.col("feature") == _F30).cast("int")).alias("f30"), F.max((F.col("feature") == _F365).cast("int")).alias("f365")
    )
    joined = rows.join(marks, ["person_id", "end_date"], "left")
    return materialize(joined.withColumns({"seen": F.coalesce("f30", F.lit(0)), "wide": F.coalesce("f365", F.lit(0))}).drop("f30", "f365"))


def imputed(rows):
    fitted = shift.cell_rates(rows.where("split = 'train'"), ["year"], "wide", "seen")
    predicted = shift.with_rate(shift.by_fit(rows, fitted), fitted, "wide", "balanced", "predicted")
    return shift.impute_missing_feature(predicted, "seen", "predicted")


@query(
    "x06_impute_missing_feature",
    sql(
        *SQL_IMPUTED,
        select="""SELECT year, split, fit, CAST(sum(seen) AS BIGINT) AS num_before, CAST(sum(seen_imputed) AS BIGINT) AS num_after,
        count(*) AS num_samples FROM imputed GROUP BY 1, 2, 3""",
    ),
)
def _(r):
    return shift.imputation_counts(imputed(flagged(r)), "seen", ["year", "split", "fit"])


@query(
    "x07_imputation_effect",
    sql(
        *SQL_IMPUTED,
        "seen_fit AS (SELECT year, seen, sum(y) / CAST(count(*) AS DOUBLE) AS p FROM flagged WHERE split = 'train' GROUP BY 1, 2)",
        """v AS (SELECT i.year, y, fit || ' raw' AS region, coalesce(p, 0) AS score FROM imputed i
            LEFT JOIN seen_fit f ON f.year = i.fit_year AND f.seen = i.seen WHERE split = 'test'
            UNION ALL SELECT i.year, y, fit || ' imputed', coalesce(p, 0) FROM imputed i
            LEFT JOIN seen_fit f ON f.year = i.fit_year AND f.seen = i.seen_imputed WHERE split = 'test')""",
        *_sql_metrics("v", "y", "(1 - y)"),
        select=_METRICS.replace("m.region,", "m.region AS variant,")
        .replace("round(CAST(p AS DOUBLE), 6)", "CAST(p AS BIGINT)")
        .replace("round(CAST(n AS DOUBLE), 6)", "CAST(n AS BIGINT)"),
    ),
)
def _(r):
    """Models of the own year and of the year before, each on raw samples and on those imputed with what the same year taught."""
    rows = flagged(r)
    outcome = shift.cell_rates(rows.where("split = 'train'"), ["year"], "seen", "y")
    test = imputed(rows).where("split = 'test'")
    raw = shift.with_rate(test, outcome, "seen", "rate", "raw")
    filled = outcome.withColumnRenamed("seen", "seen_imputed")
    both = shift.with_rate(raw, filled, "seen_imputed", "rate", "imputed")
    stacked = shift.variants(both, {"raw": "raw", "imputed": "imputed"}).withColumn("variant", F.concat_ws(" ", "fit", "variant"))
    return me.eval_predictions(stacked, by=["year", "variant"])


# ------------------------------------------------------------------ weights

SQL_WEIGHTS = (
    SQL_SCORES,
    "wt AS (SELECT sample_id, year, split, y, greatest(0.01E0, least(10.0E0, s_prev / (1 - s_prev))) AS weight FROM sc)",
)


def weights(r):
    return shift.importance_weights(scores(r), "s_prev").select("sample_id", "year", "split", "y", "weight")


@query("x08_importance_weights", sql(*SQL_WEIGHTS, select="SELECT sample_id, year, split, y, round(weight, 6) AS weight FROM wt"))
def _(r):
    return weights(r)


@query(
    "x09_weight_percentiles",
    sql(
        *SQL_WEIGHTS,
        "ps AS (SELECT unnest([0.0E0, 0.025E0, 0.25E0, 0.5E0, 0.75E0, 0.975E0, 1.0E0]) AS probability)",
        "q AS (SELECT year, quantile_cont(weight, [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]) AS v FROM wt GROUP BY year)",
        select="""SELECT year, round(unnest([0.0E0, 0.025E0, 0.25E0, 0.5E0, 0.75E0, 0.975E0, 1.0E0]), 6) AS probability, round(unnest(v), 6) AS percentile FROM q""",
    ),
)
def _(r):
    return shift.weight_percentiles(weights(r), ["year"])


@query(
    "x09_weight_histogram",
    sql(
        *SQL_WEIGHTS,
        select="""SELECT year, CAST(least(floor((round(log10(weight), 9) + 2.0E0) / (3.0E0 / 100)), 99) AS INT) AS bin, count(*) AS num_samples
        FROM wt GROUP BY 1, 2""",
    ),
)
def _(r):
    return shift.weight_histogram(weights(r), ["year"])


@query(
    "x11_three_way_evaluation",
    sql(
        SQL_SCORES,
        """v AS (SELECT split, y, s_curr AS score, 'old on old' AS pair FROM sc WHERE year = 1998
        UNION ALL SELECT split, y, s_prev, 'old on new' FROM sc WHERE year = 1999
        UNION ALL SELECT split, y, s_curr, 'new on new' FROM sc WHERE year = 1999)""",
        *sql_auc("a", "v", "split, pair", "score"),
        select="SELECT split, pair, round(auc, 6) AS auc FROM a",
    ),
)
def _(r):
    return shift.three_way_evaluation(scores(r), 1999, ["split"])


# -------------------------------------------------------- conditional rates

_ANY = (PROC.format(103, 365), COND.format(7, 365))


@query(
    "x12_rate_with_and_without_feature",
    sql(
        *SQL_LONG[:-2],
        f"hit AS (SELECT DISTINCT person_id, end_date FROM long_all WHERE feature IN {_ANY})",
        select="""SELECT s.year, CASE WHEN h.person_id IS NULL THEN 0 ELSE 1 END AS has_feature, count(*) AS num_samples,
        CAST(sum(s.y) AS BIGINT) AS num_positive, round(avg(CAST(s.y AS DOUBLE)), 6) AS rate
        FROM samples s LEFT JOIN hit h ON h.person_id = s.person_id AND h.end_date = s.end_date GROUP BY 1, 2""",
    ),
)
def _(r):
    rows = samples(r)
    return shift.rate_with_and_without(rows, shift.any_of_features(long_samples(r, sampled=rows), _ANY))


@query(
    "x13_age_histogram",
    sql(
        *SQL_AGED,
        select="""SELECT year, CASE WHEN age BETWEEN 0 AND 100 THEN CAST(least(floor(age / 5.0E0), 19) AS INT) END AS bin, count(*) AS num_samples
        FROM aged GROUP BY 1, 2""",
    ),
)
def _(r):
    return shift.age_histogram(aged_samples(r))


@query(
    "x14_outcomes_by_age_band",
    sql(
        *SQL_AGED,
        select="""SELECT year, CASE WHEN age <= 30 THEN 'range 1: <= 30' WHEN age <= 50 THEN 'range 2: 31 - 50'
        WHEN age <= 70 THEN 'range 3: 51 - 70' ELSE 'range 4: > 70' END AS age_range, count(*) AS num_samples,
        CAST(sum(y) AS BIGINT) AS num_positive FROM aged GROUP BY 1, 2""",
    ),
)
def _(r):
    return shift.outcomes_by_age_band(aged_samples(r))


_AND = (PROC.format(103, 365), PROC.format(107, 365))
_OR = (COND.format(7, 365), COND.format(8, 365), PROC.format(111, 30))
SQL_SUBPOPS = (
    *SQL_LONG[:-2],
    f"sub_and AS (SELECT person_id, end_date FROM long_all WHERE feature IN {_AND} GROUP BY 1, 2 HAVING count(DISTINCT feature) = 2)",
    f"sub_or AS (SELECT DISTINCT person_id, end_date FROM long_all WHERE feature IN {_OR})",
    "members AS (SELECT 'both' AS subpopulation, * FROM sub_and UNION ALL SELECT 'any', * FROM sub_or)",
    """sub_rates AS (SELECT m.subpopulation, s.year, avg(CAST(s.y AS DOUBLE)) AS rate, count(*) AS num_samples FROM samples s JOIN members m
        ON m.person_id = s.person_id AND m.end_date = s.end_date WHERE s.split IN ('train', 'valid') GROUP BY 1, 2)""",
    """sub_weights AS (SELECT subpopulation, coalesce(max(CASE WHEN year = 1998 THEN rate END), 0) AS source_rate,
        coalesce(max(CASE WHEN year = 1999 THEN rate END), 0) AS target_rate FROM sub_rates GROUP BY 1)""",
    """sub_factors AS (SELECT *, CASE WHEN source_rate <> 0 THEN target_rate / source_rate WHEN target_rate = 0 THEN 1.0E0 ELSE 2.0E0 END AS weight
        FROM sub_weights)""",
)


def members(r, rows=None, complement=False):
    rows = samples(r) if rows is None else rows
    # both groups are cut from the samples' own arrays, of which only the features they ask for are stored
    asked = F.array_intersect("present", F.array(*map(F.lit, (*_AND, *_OR))))
    sets = materialize(sample_sets(r, sampled=rows).withColumn("present", asked))
    both = shift.subpopulation_filter(sets, None, _AND, "AND", complement=complement).withColumn("subpopulation", F.lit("both"))
    any_of = shift.subpopulation_filter(sets, None, _OR, "OR", complement=complement).withColumn("subpopulation", F.lit("any"))
    return both.unionByName(any_of).drop("present")


@query(
    "x15_subpopulation_filter",
    sql(*SQL_SUBPOPS, select=f"SELECT subpopulation, {_KEY} FROM members JOIN samples USING (person_id, end_date)"),
)
def _(r):
    return members(r).select("subpopulation", "person_id", "end_date")


@query(
    "x15_subpopulation_complement",
    sql(
        *SQL_SUBPOPS,
        """outside AS (SELECT 'both' AS subpopulation, person_id, end_date FROM samples WHERE (person_id, end_date) NOT IN (SELECT * FROM sub_and)
        UNION ALL SELECT 'any', person_id, end_date FROM samples WHERE (person_id, end_date) NOT IN (SELECT * FROM sub_or))""",
        select=f"SELECT subpopulation, {_KEY} FROM outside",
    ),
)
def _(r):
    return members(r, complement=True).select("subpopulation", "person_id", "end_date")


@query(
    "x16_subpopulation_rate",
    sql(*SQL_SUBPOPS, select="SELECT subpopulation, year, round(rate, 6) AS rate, num_samples FROM sub_rates"),
)
def _(r):
    return shift.subpopulation_rate(members(r), ["subpopulation", "year"])


def subpop_weights(r, inside):
    rates = shift.subpopulation_rate(inside, ["subpopulation", "year"])
    return shift.recalibration_weight(rates, 1998, 1999, ["subpopulation"])


@query(
    "x17_recalibration_weight",
    sql(
        *SQL_SUBPOPS,
        select="SELECT subpopulation, round(source_rate, 6) AS source_rate, round(target_rate, 6) AS target_rate, round(weight, 6) AS weight FROM sub_factors",
    ),
)
def _(r):
    return subpop_weights(r, members(r))


@query(
    "x18_recalibrate_scores",
    sql(
        *SQL_SUBPOPS,
        f"base AS (SELECT person_id, end_date, year, y, ({hash32_sql(21, 'person_id', 'end_date')} % 1000) / 1000.0E0 AS score FROM samples WHERE split = 'test' AND year = 1999)",
        """raised AS (SELECT b.person_id, b.end_date, b.score, least(1.0E0, b.score * coalesce(max(CASE WHEN m.subpopulation = 'both' THEN f.weight END), 1)
            * coalesce(max(CASE WHEN m.subpopulation = 'any' THEN f.weight END), 1)) AS recalibrated
            FROM base b LEFT JOIN members m ON m.person_id = b.person_id AND m.end_date = b.end_date
            LEFT JOIN sub_factors f ON f.subpopulation = m.subpopulation GROUP BY 1, 2, 3)""",
        select=f"SELECT {_KEY}, round(score, 6) AS score, round(recalibrated, 6) AS recalibrated FROM raised",
    ),
)
def _(r):
    from tidemark.functions.expressions import hash32

    rows = samples(r)
    inside = materialize(members(r, rows))
    factors = subpop_weights(r, inside)
    base = rows.where("split = 'test' AND year = 1999").select(
        "person_id", "end_date", ((hash32(21, "person_id", "end_date") % 1000) / 1000.0).alias("score")
    )
    return shift.recalibrate_scores(base, inside.select("subpopulation", "person_id", "end_date"), factors, shift.SAMPLE, "score")


# ------------------------------------------------------------- coefficients


def two_years(r):
    table = materialize(log_odds(r))
    return table.where("year = 1998"), table.where("year = 1999")


_JOIN = "FROM coefs a JOIN coefs b ON a.feature = b.feature AND a.year = 1998 AND b.year = 1999"


@query(
    "x19_sign_stable_features",
    sql(*SQL_COEFS, select=f"SELECT a.feature, a.coefficient AS coefficient_1, b.coefficient AS coefficient_2 {_JOIN} WHERE a.coefficient * b.coefficient >= 0"),
)
def _(r):
    return shift.sign_stable_features(*two_years(r))


_CI4 = "a.feature, a.ci_low AS ci_low_1, a.ci_high AS ci_high_1, b.ci_low AS ci_low_2, b.ci_high AS ci_high_2"


@query(
    "x20_ci_stable_features",
    sql(*SQL_COEFS, select=f"SELECT {_CI4} {_JOIN} WHERE (a.ci_low > 0 AND b.ci_low > 0) OR (a.ci_high < 0 AND b.ci_high < 0)"),
)
def _(r):
    return shift.ci_stable_features(*two_years(r))


@query(
    "x22_drop_lab_value_features",
    sql(
        *SQL_LABS,
        f"names AS (SELECT DISTINCT concept_name AS feature FROM ({_lab('ordered', 'cm')}) UNION SELECT DISTINCT concept_name FROM ({_lab('increasing', 'changes', 'change > 0')}))",
        select="SELECT feature FROM names WHERE split_part(feature, ' - ', 4) = 'ordered'",
    ),
)
def _(r):
    rows = measured(r)
    names = features.event_timeline([features.lab_ordered(rows), features.lab_trend(rows)])
    catalog = features.feature_catalog(names.select(F.col("concept_name").alias("feature")))
    return shift.drop_lab_value_features(catalog).select("feature")


@query(
    "x23_chi2_select",
    sql(
        *SQL_LONG,
        "cls AS (SELECT year, count(*) AS n, CAST(sum(y) AS DOUBLE) AS n1 FROM samples WHERE split = 'train' GROUP BY 1)",
        "fs AS (SELECT year, feature, count(*) AS total, CAST(sum(y) AS DOUBLE) AS o1 FROM long WHERE split = 'train' GROUP BY 1, 2)",
        """stat AS (SELECT f.year, f.feature, f.total, round(power(o1 - total * (n1 / n), 2) / (total * (n1 / n)) + power(o1 - total * (n1 / n), 2) / (total * (1 - n1 / n)), 9) AS chi2
        FROM fs f JOIN cls c ON c.year = f.year)""",
        "rk AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY chi2 DESC) AS pos FROM stat)",
        select="SELECT year, feature, total, round(chi2, 6) AS chi2 FROM rk WHERE pos <= 10",
    ),
)
def _(r):
    rows = samples(r)
    every = stored_long(r, sampled=rows)
    kept = features.keep_features(every, features.frequent_features(every, 300))
    return shift.chi2_select(kept.where("split = 'train'"), rows.where("split = 'train'"), 10)


@query(
    "x24_min_frequency_both_years",
    sql(
        *SQL_LONG,
        """c AS (SELECT feature, count(*) FILTER (year = 1998) AS freq_1, count(*) FILTER (year = 1999) AS freq_2 FROM long WHERE split = 'train' GROUP BY 1)""",
        select="SELECT * FROM c WHERE freq_1 > 300 AND freq_2 > 300",
    ),
)
def _(r):
    return shift.min_frequency_both_years(dataset(r), (1998, 1999), 300)


_NEAR = (350, 363, 365)
SQL_PAIRS = (
    *SQL_SAMPLED,
    """named AS (SELECT person_id, event_date, concat(CAST(concept_id AS VARCHAR), ' - procedure - Procedure ', CAST(concept_id AS VARCHAR)) AS feature
        FROM procedure_occurrence)""",
    """win AS (SELECT DISTINCT s.person_id, s.end_date, s.year, concat(e.feature, ' - ', CAST(w.days AS VARCHAR), ' days') AS feature
        FROM samples s JOIN named e ON e.person_id = s.person_id AND e.event_date < s.end_date
        JOIN (VALUES (350), (363), (365)) w(days) ON e.event_date >= s.end_date - w.days WHERE s.split = 'train')""",
    "tot AS (SELECT year, CAST(count(*) AS DOUBLE) AS n FROM samples WHERE split = 'train' GROUP BY 1)",
    "fr AS (SELECT year, feature, CAST(count(*) AS DOUBLE) AS f FROM win GROUP BY 1, 2)",
    """co AS (SELECT a.year, a.feature AS fa, b.feature AS fb, count(*) AS n_both FROM win a JOIN win b
        ON a.person_id = b.person_id AND a.end_date = b.end_date AND a.feature < b.feature GROUP BY 1, 2, 3)""",
    """phi AS (SELECT co.*, x.f AS f1, z.f AS f2, (n * n_both - x.f * z.f) / sqrt(x.f * (n - x.f) * z.f * (n - z.f)) AS correlation
        FROM co JOIN tot ON tot.year = co.year JOIN fr x ON x.year = co.year AND x.feature = fa JOIN fr z ON z.year = co.year AND z.feature = fb)""",
    """high AS (SELECT year, CASE WHEN f2 > f1 THEN fb ELSE fa END AS feature_1, CASE WHEN f2 > f1 THEN fa ELSE fb END AS feature_2, n_both, correlation
        FROM phi WHERE abs(f1 - f2) <= 100 AND correlation > 0.95E0)""",
)


def near_windows(r):
    rows = samples(r).where("split = 'train'")
    events = named_events(r, "procedure_occurrence", "procedure")
    events = events.join(rows.select("person_id").distinct(), "person_id", "left_semi")
    sets = features.sample_sets(rows.select("person_id", "end_date", "year"), events, _NEAR)
    long = materialize(features.one_per_feature(sets))
    return rows, long, long.select("feature").distinct()


@query(
    "x25_correlated_pairs",
    sql(*SQL_PAIRS, select="SELECT year, feature_1, feature_2, n_both, round(correlation, 6) AS correlation FROM high"),
)
def _(r):
    rows, long, _ = near_windows(r)
    return shift.correlated_pairs(long, rows, None)


# partners form short chains by window length, so three rounds decide every feature
@query(
    "x25_correlated_pairs_prune",
    sql(
        *SQL_PAIRS,
        "ft AS (SELECT feature, sum(f) AS f FROM fr GROUP BY 1)",
        """better AS (SELECT DISTINCT CASE WHEN a.f > b.f OR (a.f = b.f AND a.feature < b.feature) THEN a.feature ELSE b.feature END AS feature_1,
            CASE WHEN a.f > b.f OR (a.f = b.f AND a.feature < b.feature) THEN b.feature ELSE a.feature END AS feature_2
            FROM high h JOIN ft a ON a.feature = h.feature_1 JOIN ft b ON b.feature = h.feature_2)""",
        "names AS (SELECT DISTINCT feature FROM win)",
        "kept1 AS (SELECT feature FROM names WHERE feature NOT IN (SELECT feature_2 FROM better))",
        "out1 AS (SELECT DISTINCT feature_2 AS feature FROM better WHERE feature_1 IN (SELECT feature FROM kept1))",
        "open1 AS (SELECT feature FROM names EXCEPT SELECT feature FROM kept1 EXCEPT SELECT feature FROM out1)",
        "kept2 AS (SELECT feature FROM open1 WHERE feature NOT IN (SELECT feature_2 FROM better WHERE feature_1 IN (SELECT feature FROM open1)))",
        "out2 AS (SELECT DISTINCT feature_2 AS feature FROM better WHERE feature_1 IN (SELECT feature FROM kept2))",
        "open2 AS (SELECT feature FROM open1 EXCEPT SELECT feature FROM kept2 EXCEPT SELECT feature FROM out2)",
        "kept3 AS (SELECT feature FROM open2 WHERE feature NOT IN (SELECT feature_2 FROM better WHERE feature_1 IN (SELECT feature FROM open2)))",
        select="SELECT feature FROM kept1 UNION SELECT feature FROM kept2 UNION SELECT feature FROM kept3",
    ),
)
def _(r):
    rows, long, names = near_windows(r)
    totals = long.groupBy("feature").agg(F.count(F.lit(1)).alias("f"))
    return shift.correlated_pairs_prune(names, shift.correlated_pairs(long, rows, None), totals)


SQL_DRUG_COEFS = (
    *SQL_LONG[: len(SQL_SAMPLED)],
    SQL_LONG[len(SQL_SAMPLED)],
    """drug_named AS (SELECT person_id, event_date, concat(CAST(concept_id AS VARCHAR), ' - drug - Drug ', CAST(concept_id AS VARCHAR),
        CASE WHEN concept_id % 2 = 0 THEN ' alphazine tablet' ELSE ' betazine oral' END) AS feature FROM drug_exposure)""",
    "all_named AS (SELECT * FROM proc_named UNION ALL SELECT * FROM drug_named)",
    *SQL_LONG[len(SQL_SAMPLED) + 3 :],
    *SQL_COEFS[len(SQL_LONG) :],
)


def _sql_appearing(name: str, before: int, after: int, k: int) -> tuple[str, ...]:
    stops = " AND ".join(f"NOT contains(w.word, '{s}')" for s in shift.DRUG_STOP_WORDS)
    return (
        f"""{name}_top AS (SELECT feature, lower(split_part(feature, ' - ', 3)) AS name, split_part(feature, ' - ', 2) AS type, coefficient
            FROM (SELECT * FROM coefs WHERE year = {after} ORDER BY coefficient DESC, feature LIMIT {k}) WHERE coefficient >= 0.001E0)""",
        f"""{name}_old AS (SELECT feature, lower(split_part(feature, ' - ', 3)) AS name FROM coefs WHERE year = {before} AND coefficient >= 0.0001E0)""",
        f"""{name}_words AS (SELECT feature, word FROM (SELECT feature, unnest(string_split(name, ' ')) AS word FROM {name}_top WHERE type = 'drug') w
            WHERE length(w.word) > 3 AND {stops})""",
        f"""{name} AS (SELECT feature, name, coefficient FROM {name}_top t WHERE NOT EXISTS (SELECT 1 FROM {name}_old o WHERE o.feature = t.feature)
            AND NOT (type <> 'drug' AND EXISTS (SELECT 1 FROM {name}_old o WHERE starts_with(o.name, left(t.name, 30))))
            AND NOT EXISTS (SELECT 1 FROM {name}_words w JOIN {name}_old o ON contains(o.name, w.word) WHERE w.feature = t.feature))""",
    )


@query(
    "x26_appearing_coefficients",
    sql(
        *SQL_DRUG_COEFS,
        *_sql_appearing("up", 1998, 1999, 20),
        *_sql_appearing("down", 1999, 1998, 20),
        select="SELECT 1 AS in_current, * FROM up UNION ALL SELECT 0, * FROM down",
    ),
)
def _(r):
    text = F.col("concept_id").cast("string")
    maker = F.when(F.col("concept_id") % 2 == 0, " alphazine tablet").otherwise(" betazine oral")
    drugs = r["drug_exposure"].select(
        "person_id", "event_date", F.concat(text, F.lit(" - drug - Drug "), text, maker).alias("feature")
    )
    events = named_events(r, "procedure_occurrence", "procedure").unionByName(drugs)
    rows = samples(r)
    present = features.windowed_features(events, FIRST, LAST, (30, 365))
    every = features.sample_features(rows, present).withColumn("feature", features.window_name())
    every = every.drop("window_days", "order_hash")
    kept = features.keep_features(every, features.frequent_features(every, 300))
    table = materialize(log_odds(r, rows=kept, sampled=rows))
    before, after = table.where("year = 1998"), table.where("year = 1999")
    up = shift.appearing_coefficients(before, after, 20).withColumn("in_current", F.lit(1))
    down = shift.appearing_coefficients(after, before, 20).withColumn("in_current", F.lit(0))
    return up.unionByName(down)


@query(
    "x27_significant_sign_changes",
    sql(
        *SQL_COEFS,
        select=f"""SELECT a.year, {_CI4}, CASE WHEN a.ci_low > 0 THEN 'falls' ELSE 'rises' END AS direction
        FROM coefs a JOIN coefs b ON a.feature = b.feature AND b.year = a.year + 1
        WHERE (a.ci_low > 0 AND b.ci_high < 0) OR (a.ci_high < 0 AND b.ci_low > 0)""",
    ),
)
def _(r):
    """Every two consecutive years with the intervals as they are."""
    table = materialize(log_odds(r))
    years = [row["year"] for row in table.select("year").distinct().orderBy("year").collect()]
    pairs = [
        shift.significant_sign_changes(table.where(F.col("year") == y), table.where(F.col("year") == y + 1)).withColumn("year", F.lit(y))
        for y in years
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), pairs)


# ------------------------------------------------------------ distributions


def _sql_nll(score: str) -> str:
    p = f"greatest(1e-9, least(1 - 1e-9, {score}))"
    return f"(-CASE WHEN y = 1 THEN ln({p}) ELSE ln(1 - {p}) END)"


@query(
    "x28_nll_difference_distribution",
    sql(
        SQL_SCORES,
        f"g AS (SELECT year, round({_sql_nll('s_prev')} - {_sql_nll('s_curr')}, 9) AS gap FROM sc)",
        select="""SELECT year, CASE WHEN gap BETWEEN -0.4E0 AND 0.4E0 THEN CAST(least(floor((gap + 0.4E0) / (0.8E0 / 40)), 39) AS INT) END AS bin,
        count(*) AS num_samples FROM g GROUP BY 1, 2""",
    ),
)
def _(r):
    return shift.nll_difference_distribution(scores(r), "s_prev", "s_curr")


def _sql_gain(days: int) -> tuple[str, ...]:
    w = f"w{days}"
    return (
        f"""{w}_points AS (SELECT l.person_id, l.end_date, c.year AS model_year, CAST(sum(CAST(round(c.coefficient * 1e6) AS BIGINT)) AS BIGINT) AS score
            FROM long l JOIN coefs c ON c.feature = l.feature WHERE ends_with(l.feature, ' - {days} days') GROUP BY 1, 2, 3)""",
        f"""{w}_scored AS (SELECT t.person_id, t.y, t.year AS eval_year, m.model_year, coalesce(p.score, 0) AS score
            FROM samples t JOIN (SELECT DISTINCT year AS model_year FROM coefs) m ON m.model_year IN (t.year, t.year - 1)
            LEFT JOIN {w}_points p ON p.person_id = t.person_id AND p.end_date = t.end_date AND p.model_year = m.model_year WHERE t.split = 'test')""",
        *sql_auc(f"{w}_auc", f"{w}_scored", "model_year, eval_year", "score"),
        f"""{w}_gain AS (SELECT a.eval_year, a.auc - b.auc AS gain FROM {w}_auc a JOIN {w}_auc b
            ON b.eval_year = a.eval_year AND a.model_year = a.eval_year AND b.model_year = b.eval_year - 1)""",
    )


@query(
    "x29_feature_window_comparison",
    sql(
        *SQL_COEFS,
        *_sql_gain(30),
        *_sql_gain(365),
        select="SELECT eval_year, round(s.gain, 6) AS gain_short, round(l.gain, 6) AS gain_long FROM w30_gain s JOIN w365_gain l USING (eval_year)",
    ),
)
def _(r):
    """Two models a year, one of the log odds of the 30-day features and one of the 365-day features."""
    rows = materialize(samples(r))
    every = stored_long(r, sampled=rows)
    long = materialize(features.keep_features(every, features.frequent_features(every, 300)))
    table = materialize(log_odds(r, rows=long, sampled=rows))
    test = rows.where("split = 'test'")

    def metrics(days):
        part = long.where((F.col("split") == "test") & F.col("feature").endswith(f" - {days} days"))
        return me.auc(shift.additive_scores(test, part, table), "score", ["model_year", "eval_year"])

    return shift.feature_window_comparison(metrics(30), metrics(365))


@query(
    "x30_auc_series_with_ci",
    sql(
        SQL_SCORES,
        "te AS (SELECT * FROM sc WHERE split = 'test')",
        sql_entries_models("e", "te", "year"),
        *sql_bootstrap("b", "e", "year"),
        *sql_actual("act", "e", "year"),
        sql_ci("ci", "b", "act", "year"),
        "se AS (SELECT year, stddev_pop(auc_1) AS se_curr, stddev_pop(auc_2) AS se_prev FROM b GROUP BY year)",
        sql_entries_datasets("d0", "te"),
        "d AS (SELECT * FROM d0 WHERE year IN (SELECT year FROM te) AND year - 1 IN (SELECT year FROM te))",
        *sql_bootstrap("bd", "d", "year"),
        *sql_actual("actd", "d", "year"),
        sql_ci("cid", "bd", "actd", "year"),
        select="""SELECT year, round(ci.actual_1, 6) AS auc_curr, round(ci.actual_2, 6) AS auc_prev, round(ci.actual_diff, 6) AS actual_diff,
        round(ci.ci_low, 6) AS ci_low, round(ci.ci_high, 6) AS ci_high, round(se_curr, 6) AS se_curr, round(se_prev, 6) AS se_prev,
        round(cid.actual_diff, 6) AS baseline_diff, round(cid.ci_low, 6) AS baseline_ci_low, round(cid.ci_high, 6) AS baseline_ci_high
        FROM ci JOIN se USING (year) LEFT JOIN cid USING (year)""",
    ),
)
def _(r):
    return shift.auc_series_with_ci(scored(r, "test"), REPLICATES, SEED)
