"""Queries on sub-populations (regions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import hash32_sql
from tidemark.operators import features, regions
from tidemark.operators import metrics as me
from tidemark.plans.feature_queries import SQL_AGED, SQL_LONG, aged_samples, long_samples, stored_long
from tidemark.plans.metric_queries import (
    REPLICATES,
    SEED,
    SQL_SCORES,
    scores,
    sql_actual,
    sql_auc,
    sql_bootstrap,
    sql_ci,
    sql_entries_datasets,
    sql_entries_models,
    sql_p,
    sql_permutation,
    sql_ranked,
)
from tidemark.plans.outcome_queries import samples
from tidemark.plans.registry import query, sql

_RIGHT_PREV = "CASE WHEN (s_prev >= 0.5E0) = (y = 1) THEN 1 ELSE 0 END"
_RIGHT_CURR = "CASE WHEN (s_curr >= 0.6E0) = (y = 1) THEN 1 ELSE 0 END"

SQL_ERRORS = (
    SQL_SCORES,
    "err AS (SELECT sample_id, person_id, year, split, y, CASE WHEN abs(s_prev - y) > abs(s_curr - y) THEN 1 ELSE 0 END AS label FROM sc)",
    """enough AS (SELECT year FROM err GROUP BY year HAVING
        least(count(*) FILTER (split = 'test' AND label = 1), count(*) FILTER (split = 'test' AND label = 0)) >= 10
        AND least(count(*) FILTER (split <> 'test' AND label = 1), count(*) FILTER (split <> 'test' AND label = 0)) >= 40)""",
    "err_data AS (SELECT * FROM err WHERE year IN (SELECT year FROM enough))",
)


def errors(r):
    return regions.calibration_error_label(scores(r)).select("sample_id", "person_id", "year", "split", "y", "label")


@query("r01_calibration_error_label", sql(*SQL_ERRORS, select="SELECT * FROM err"))
def _(r):
    return errors(r)


@query(
    "r02_threshold_error_label",
    sql(
        SQL_SCORES,
        f"j AS (SELECT year, {_RIGHT_PREV} AS prev_right, {_RIGHT_CURR} AS curr_right, count(*) AS num_samples FROM sc GROUP BY 1, 2, 3)",
        select="SELECT *, round(num_samples / CAST(sum(num_samples) OVER (PARTITION BY year) AS DOUBLE), 6) AS share FROM j",
    ),
)
def _(r):
    return regions.threshold_error_counts(scores(r), 0.5, 0.6, ["year"])


@query(
    "r02_threshold_error_rows",
    sql(
        SQL_SCORES,
        f"j AS (SELECT sample_id, year, {_RIGHT_PREV} AS prev_right, {_RIGHT_CURR} AS curr_right FROM sc)",
        select="SELECT sample_id, year, 1 - prev_right AS label FROM j WHERE curr_right = 1",
    ),
)
def _(r):
    return regions.threshold_error_label(scores(r), 0.5, 0.6).select("sample_id", "year", "label")


@query("r03_error_dataset", sql(*SQL_ERRORS, select="SELECT * FROM err_data"))
def _(r):
    return regions.error_dataset(errors(r), ["year"])


@query(
    "r04_label_stratified_resplit",
    sql(
        *SQL_ERRORS,
        f"""rk AS (SELECT *, row_number() OVER (PARTITION BY year, label ORDER BY {hash32_sql(7, 'sample_id')}, sample_id) AS rank,
        count(*) OVER (PARTITION BY year, label) AS n FROM err_data WHERE split IN ('train', 'valid'))""",
        select="""SELECT sample_id, person_id, year, y, label, CASE WHEN rank <= floor(n * 0.25E0) THEN 'valid' ELSE 'train' END AS split FROM rk""",
    ),
)
def _(r):
    return regions.label_stratified_resplit(regions.error_dataset(errors(r), ["year"]), ["sample_id"], ["year"], seed=7)


@query(
    "r05_timepoint_dataset",
    sql(
        SQL_SCORES,
        select=f"""SELECT sample_id, person_id, y, CASE WHEN year = 1999 THEN 1 ELSE 0 END AS label, year,
        CASE WHEN split = 'test' THEN 'test' WHEN {hash32_sql(9, 'sample_id')} < {int(0.25 * 2**32)} THEN 'valid' ELSE 'train' END AS split
        FROM sc WHERE year IN (1998, 1999)""",
    ),
)
def _(r):
    return regions.timepoint_dataset(scores(r), 1999, seed=9).select("sample_id", "person_id", "y", "label", "year", "split")


@query(
    "r07_model_region",
    sql(SQL_SCORES, select="SELECT sample_id, year, CASE WHEN s_prev >= 0.5E0 THEN 1 ELSE 0 END AS region FROM sc"),
)
def _(r):
    return regions.model_region(scores(r), "s_prev").select("sample_id", "year", "region")


_FEATURE = "103 - procedure - Procedure 103 - 365 days"
_KEY = "person_id, CAST(end_date AS VARCHAR) AS end_date"


@query(
    "r08_single_feature_region",
    sql(
        *SQL_LONG[:-2],
        f"holders AS (SELECT DISTINCT person_id, end_date, 1 AS present FROM long_all WHERE feature = '{_FEATURE}')",
        select="""SELECT s.person_id, CAST(s.end_date AS VARCHAR) AS end_date, s.year, 1 - coalesce(h.present, 0) AS region
        FROM samples s LEFT JOIN holders h ON h.person_id = s.person_id AND h.end_date = s.end_date""",
    ),
)
def _(r):
    rows = samples(r)
    present = long_samples(r, sampled=rows).where(F.col("feature") == _FEATURE)
    return regions.single_feature_region(rows, present, ["person_id", "end_date"], -1).select(
        "person_id", "end_date", "year", "region"
    )


@query(
    "r08_age_region",
    sql(
        *SQL_AGED,
        "b AS (SELECT ceil(quantile_cont(age, 0.8)) AS bound FROM aged WHERE split = 'train')",
        select=f"SELECT {_KEY}, age, CASE WHEN age >= (SELECT bound FROM b) THEN 1 ELSE 0 END AS region FROM aged",
    ),
)
def _(r):
    aged = aged_samples(r)
    bound = regions.age_bound(aged.where("split = 'train'").withColumn("_g", F.lit(1)), 1, ["_g"]).first()["age_bound"]
    return regions.age_region(aged, bound, 1).select("person_id", "end_date", "age", "region")


# per-year log odds of a feature against the outcome, as a coefficient table that plain SQL can repeat
SQL_COEFS = (
    *SQL_LONG,
    """year_class AS (SELECT year, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM samples WHERE split = 'train' GROUP BY year)""",
    """cells2 AS (SELECT l.year, l.feature, sum(l.y) + 0.5E0 AS a, sum(1 - l.y) + 0.5E0 AS b, max(c.n1) - sum(l.y) + 0.5E0 AS c,
        max(c.n0) - sum(1 - l.y) + 0.5E0 AS d FROM long l JOIN year_class c ON c.year = l.year WHERE l.split = 'train' GROUP BY 1, 2)""",
    """coefs AS (SELECT year, feature, round(ln((a * d) / (b * c)), 6) AS coefficient,
        round(ln((a * d) / (b * c)) - 1.96E0 * sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS ci_low,
        round(ln((a * d) / (b * c)) + 1.96E0 * sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS ci_high FROM cells2)""",
)


def log_odds(r, rows=None, sampled=None):
    """Yearly log odds ratios of the frequent features with 95 % intervals, on training rows."""
    sampled = samples(r) if sampled is None else sampled
    if rows is None:
        every = stored_long(r, sampled=sampled)
        rows = features.keep_features(every, features.frequent_features(every, 300))
    y = F.col("y")
    train = sampled.where("split = 'train'")
    sizes = train.groupBy("year").agg(F.sum(y).alias("n1"), F.sum(1 - y).alias("n0"))
    counts = rows.where("split = 'train'").groupBy("year", "feature").agg(F.sum(y).alias("a0"), F.sum(1 - y).alias("b0"))
    half = F.lit(0.5)
    cells = counts.join(sizes, "year").select(
        "year",
        "feature",
        (F.col("a0") + half).alias("a"),
        (F.col("b0") + half).alias("b"),
        (F.col("n1") - F.col("a0") + half).alias("c"),
        (F.col("n0") - F.col("b0") + half).alias("d"),
    )
    a, b, c, d = (F.col(x) for x in "abcd")
    odds = F.log((a * d) / (b * c))
    width = 1.96 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return cells.select(
        "year",
        "feature",
        F.round(odds, 6).alias("coefficient"),
        F.round(odds - width, 6).alias("ci_low"),
        F.round(odds + width, 6).alias("ci_high"),
    )


SQL_TOP = """placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY abs(coefficient) DESC, feature) AS position
    FROM coefs WHERE coefficient <> 0) WHERE position <= 5 AND feature <> 'Y'),
    topf AS (SELECT * FROM placed r WHERE NOT EXISTS (SELECT 1 FROM placed e
        WHERE e.year < r.year AND e.feature = r.feature AND (e.coefficient > 0) = (r.coefficient > 0)))"""


@query(
    "r09_top_features",
    sql(*SQL_COEFS, SQL_TOP, select="SELECT year, feature, coefficient, position FROM topf"),
)
def _(r):
    return regions.top_features(log_odds(r), k=5).select("year", "feature", "coefficient", "position")


@query(
    "r10_age_bound",
    sql(
        *SQL_AGED,
        select="""SELECT year, ceil(quantile_cont(age, 0.8)) AS high_bound, floor(quantile_cont(age, 0.2)) AS low_bound
        FROM aged WHERE split = 'train' GROUP BY year""",
    ),
)
def _(r):
    train = aged_samples(r).where("split = 'train'")
    high = regions.age_bound(train, 1, ["year"]).withColumnRenamed("age_bound", "high_bound")
    low = regions.age_bound(train, -1, ["year"]).withColumnRenamed("age_bound", "low_bound")
    return high.join(low, "year")


@query(
    "r11_region_catalog",
    sql(
        *SQL_COEFS,
        SQL_TOP,
        """named AS (SELECT *, concat(left(split_part(feature, ' - ', 3), 25), ' ', split_part(feature, ' - ', 4)) AS label FROM topf)""",
        """sides AS (SELECT *, 1 AS inside FROM named UNION ALL SELECT *, 0 FROM named)""",
        select="""SELECT year, feature, concat(split_part(feature, ' - ', 1), '_', replace(label, ' ', '_')) AS file_key, inside,
        CASE WHEN (coefficient > 0) = (inside = 1) THEN label ELSE concat('no ', label) END AS region_label,
        CASE WHEN (coefficient > 0) = (inside = 1) THEN 'present' ELSE 'absent' END AS rule FROM sides""",
    ),
)
def _(r):
    top = regions.top_features(log_odds(r), k=5)
    return regions.region_catalog(top, features.feature_catalog(top))


# --------------------------------------------------- statistics and checks

SQL_REGION = (
    SQL_SCORES,
    "rs AS (SELECT s.*, CASE WHEN p.gender_source_value = 'F' THEN 1 ELSE 0 END AS region FROM sc s JOIN person p ON p.person_id = s.person_id)",
)


def region_scores(r, rows=None):
    gender = r["person"].select("person_id", (F.col("gender_source_value") == "F").cast("int").alias("region"))
    return (scores(r) if rows is None else rows).join(gender, "person_id")


def checked_scores(r):
    """Validation and test scores with their region, as a table: the check scans them many times."""
    return r.stage("region_scores", lambda: region_scores(r, scores(r).where("split IN ('valid', 'test')").drop("sample_id")))


_AT = """sum(CASE WHEN score >= 0.5E0 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5E0 THEN neg ELSE 0 END) AS fp, sum(pos) AS p, sum(neg) AS n"""
_PR = "CAST(pos_total - pos_below AS DOUBLE) / (pos_total - pos_below + neg_total - neg_below)"


def _sql_metrics(source: str, pos: str, neg: str) -> tuple[str, ...]:
    return (
        *sql_auc("a", source, "year, region", "score", pos, neg),
        f"""m AS (SELECT year, region, {_AT}, sum(pos * {_PR}) / CAST(sum(pos) AS DOUBLE) AS ap,
        sum(pos * (score - 1) ** 2 + neg * score ** 2) / sum(pos + neg) AS brier FROM a_run GROUP BY 1, 2)""",
    )


_METRICS = """SELECT m.year, m.region, round(CAST(p AS DOUBLE), 6) AS num_positive, round(CAST(n AS DOUBLE), 6) AS num_negative, round(a.auc, 6) AS auc,
    round(ap, 6) AS average_precision, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
    round(coalesce(tp / nullif(CAST(p AS DOUBLE), 0), 0), 6) AS recall,
    round(coalesce(2.0E0 * tp / nullif(CAST(2 * tp + fp + (p - tp) AS DOUBLE), 0), 0), 6) AS f1, round(brier, 6) AS brier
    FROM m JOIN a ON a.year = m.year AND a.region = m.region"""


@query("r12_region_metrics", sql(*SQL_REGION, "x AS (SELECT *, s_curr AS score FROM rs)", *_sql_metrics("x", "y", "(1 - y)"), select=_METRICS.replace("round(CAST(p AS DOUBLE), 6)", "CAST(p AS BIGINT)").replace("round(CAST(n AS DOUBLE), 6)", "CAST(n AS BIGINT)")))
def _(r):
    return regions.region_metrics(region_scores(r).withColumn("score", F.col("s_curr")), ["year"])


@query(
    "r12_soft_region_metrics",
    sql(
        SQL_SCORES,
        """x AS (SELECT *, s_curr AS score, 1 AS region, round(s_prev / 2, 3) AS wt FROM sc
        UNION ALL SELECT *, s_curr, 0, 1 - round(s_prev / 2, 3) FROM sc)""",
        *_sql_metrics("x", "wt * y", "wt * (1 - y)"),
        select=_METRICS,
    ),
)
def _(r):
    soft = scores(r).withColumn("score", F.col("s_curr")).withColumn("region", F.round(F.col("s_prev") / 2, 3))
    return regions.region_metrics(soft, ["year"], soft=True)


@query(
    "r13_region_statistics",
    sql(
        *SQL_REGION,
        "e AS (SELECT *, CASE WHEN abs(s_prev - y) > abs(s_curr - y) THEN 1 ELSE 0 END AS label FROM rs)",
        select="""SELECT year, split, count(*) AS num_samples, CAST(sum(region) AS BIGINT) AS region_size, CAST(sum(label) AS BIGINT) AS num_errors,
        CAST(sum(region * label) AS BIGINT) AS region_errors, round(sum(region) / CAST(count(*) AS DOUBLE), 6) AS region_share,
        round(coalesce(sum(region * label) / nullif(CAST(sum(label) AS DOUBLE), 0), 1), 6) AS error_share FROM e GROUP BY 1, 2""",
    ),
)
def _(r):
    return regions.region_statistics(regions.calibration_error_label(region_scores(r)), ["year", "split"])


def _sql_region_check(baseline: bool) -> tuple[str, ...]:
    """The check inside a region as SQL: all intervals and p-values for all years, then the first failing rule."""

    def part(split: str, region: int) -> str:
        return f"(SELECT * FROM rs WHERE split = '{split}' AND region = {region})"

    def entries(name: str, source: str) -> tuple[str, ...]:
        return (sql_entries_datasets(name, source),) if baseline else (sql_entries_models(name, source, "year"),)

    counts = ", ".join(
        f"count(DISTINCT CASE WHEN split = '{s}' AND region = {g} AND y = {v} THEN person_id END) AS {s}_{side}_{o}"
        for s in ("valid", "test")
        for side, g in (("in", 1), ("out", 0))
        for o, v in (("pos", 1), ("neg", 0))
    )
    rules = ["WHEN c.rows_in < 0.001E0 * c.rows_all OR c.rows_in > 0.75E0 * c.rows_all THEN 'region size'"]
    for alias, year in (("p", "previous"), ("c", "current")):
        for side, place in (("in", "inside"), ("out", "outside")):
            for o, word in (("pos", "with"), ("neg", "without")):
                rules.append(f"WHEN {alias}.valid_{side}_{o} < 25 THEN 'few validation persons {word} outcome {place} in {year} year'")
    rules.append("WHEN coalesce(p.auc, 0) < 0.5E0 THEN 'low AUC of previous model'")
    if baseline:
        rules.append("WHEN coalesce(p.auc_in, 0) < 0.5E0 THEN 'low AUC of previous model inside'")
    else:
        rules.append("WHEN coalesce(c.auc, 0) < 0.5E0 THEN 'low AUC of current model'")
        rules.append("WHEN coalesce(c.auc_in, 0) < 0.5E0 THEN 'low AUC of current model inside'")
    few = [
        f"WHEN {alias}.test_in_{o} < 20 THEN 'few test persons {word} outcome inside in {year} year'"
        for alias, year in ([("c", "current"), ("p", "previous")] if baseline else [("c", "current")])
        for o, word in (("pos", "with"), ("neg", "without"))
    ]
    ranked = () if baseline else (sql_ranked("te", "te0", "year"),)
    te = entries("te" if baseline else "te0", part("test", 1))
    return (
        *SQL_REGION,
        f"""pc AS (SELECT year, {counts}, count(*) FILTER (split = 'valid' AND region = 1) AS rows_in,
            count(*) FILTER (split = 'valid') AS rows_all FROM rs GROUP BY year)""",
        *sql_auc("va", "(SELECT * FROM rs WHERE split = 'valid')", "year", "s_curr"),
        *sql_auc("vi", part("valid", 1), "year", "s_curr"),
        "facts AS (SELECT pc.*, va.auc, vi.auc AS auc_in FROM pc LEFT JOIN va USING (year) LEFT JOIN vi USING (year))",
        *entries("ei", part("valid", 1)),
        *sql_bootstrap("bi", "ei", "year"),
        *sql_actual("ai", "ei", "year"),
        sql_ci("cin", "bi", "ai", "year"),
        *entries("eo", part("valid", 0)),
        *sql_bootstrap("bo", "eo", "year"),
        *sql_actual("ao", "eo", "year"),
        sql_ci("cout", "bo", "ao", "year"),
        *te,
        *ranked,
        *sql_permutation("tp", "te", "year"),
        *sql_actual("tact", "te", "year"),
        sql_p("tpv", "tp", "tact", "year"),
        f"""staged AS (SELECT c.year, CASE {' '.join(rules)} END AS screen, CASE {' '.join(few)} END AS few
            FROM facts c JOIN facts p ON p.year = c.year - 1)""",
        """checked AS (SELECT year, CASE WHEN screen IS NOT NULL THEN screen
            WHEN NOT coalesce(cin.above_zero, FALSE) THEN 'interval inside not above 0'
            WHEN coalesce(cout.above_zero, FALSE) THEN 'interval outside above 0'
            WHEN few IS NOT NULL THEN few ELSE 'tested' END AS status,
            CASE WHEN screen IS NULL THEN cin.ci_low END AS ci_low, p_value AS p
            FROM staged LEFT JOIN cin USING (year) LEFT JOIN cout USING (year) LEFT JOIN tpv USING (year))""",
    )


_CHECKED = """SELECT year, status, round(ci_low, 6) AS ci_low, round(CASE WHEN status LIKE 'few test%' THEN 1
    WHEN status = 'tested' THEN p END, 6) AS p_value FROM checked"""


@query("r14_region_nonstationarity_check", sql(*_sql_region_check(False), select=_CHECKED))
def _(r):
    return regions.region_nonstationarity_check(checked_scores(r), [], REPLICATES, SEED)


@query("r15_region_baseline_check", sql(*_sql_region_check(True), select=_CHECKED))
def _(r):
    return regions.region_nonstationarity_check(checked_scores(r), [], REPLICATES, SEED, baseline=True)


@query(
    "r16_region_cohort_rate",
    sql(
        SQL_SCORES,
        "soft AS (SELECT *, CAST(round(s_prev) AS INT) AS inside FROM sc)",
        select="""SELECT year, count(*) AS num_samples, round(avg(CAST(y AS DOUBLE)), 6) AS rate, CAST(sum(inside) AS BIGINT) AS region_size,
        round(sum(inside * y) / nullif(CAST(sum(inside) AS DOUBLE), 0), 6) AS region_rate FROM soft GROUP BY year""",
    ),
)
def _(r):
    return regions.region_cohort_rate(scores(r).withColumn("region", F.col("s_prev")))


@query(
    "r11_age_region_catalog",
    sql(
        *SQL_AGED,
        """bounds AS (SELECT year, 1 AS coefficient, ceil(quantile_cont(age, 0.8)) AS age_bound FROM aged WHERE split = 'train' GROUP BY 1
            UNION ALL SELECT year, -1, floor(quantile_cont(age, 0.2)) FROM aged WHERE split = 'train' GROUP BY 1)""",
        select="""SELECT year, coefficient, age_bound, 1 AS inside,
            concat(CASE WHEN coefficient > 0 THEN 'age >= ' ELSE 'age <= ' END, CAST(CAST(age_bound AS BIGINT) AS VARCHAR)) AS region_label,
            concat(CASE WHEN coefficient > 0 THEN 'age_atleast_' ELSE 'age_atmost_' END, CAST(CAST(age_bound AS BIGINT) AS VARCHAR)) AS file_key FROM bounds
        UNION ALL SELECT year, coefficient, age_bound, 0,
            concat(CASE WHEN coefficient > 0 THEN 'age < ' ELSE 'age > ' END, CAST(CAST(age_bound AS BIGINT) AS VARCHAR)),
            concat(CASE WHEN coefficient > 0 THEN 'age_below_' ELSE 'age_above_' END, CAST(CAST(age_bound AS BIGINT) AS VARCHAR)) FROM bounds""",
    ),
)
def _(r):
    train = aged_samples(r).where("split = 'train'")
    sides = [regions.age_bound(train, sign, ["year"]).withColumn("coefficient", F.lit(sign)) for sign in (1, -1)]
    return regions.age_region_catalog(sides[0].unionByName(sides[1]))
