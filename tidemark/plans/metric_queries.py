"""Queries on evaluation metrics, resampling and hypothesis tests over the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import below_sql, chi2_p_sql, draw62_sql, hash32_sql, key62_sql
from tidemark.operators import hypothesis as hy
from tidemark.operators import metrics as me
from tidemark.operators import resampling as rs
from tidemark.plans.registry import query, sql

BY = ["year", "split"]
REPLICATES = rs.REPLICATES
SEED = 11


def scores(r):
    return r["scores"]


def scored(r, *splits):
    """The scores of these splits as a table of their own, for checks that scan them many times: the large tables are joined once."""
    rows = scores(r).where(F.col("split").isin(*splits)).drop("sample_id")
    return r.stage(f"scores_{'_'.join(splits)}", lambda: rows)


def weighted(r):
    return scores(r).withColumn("w", (F.col("person_id") % 3 + 1))


SQL_SCORES = "sc AS MATERIALIZED (SELECT *, person_id % 3 + 1 AS w FROM scores)"


def sql_auc(name: str, source: str, by: str, value: str, pos: str = "y", neg: str = "(1 - y)") -> tuple[str, ...]:
    """AUC per group from running sums over distinct scores."""
    return (
        f"""{name}_steps AS (SELECT {by}, {value} AS score, sum({pos}) AS pos, sum({neg}) AS neg FROM {source} GROUP BY {by}, {value})""",
        f"""{name}_run AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) - neg AS neg_below,
            sum(pos) OVER (PARTITION BY {by} ORDER BY score) - pos AS pos_below,
            sum(pos) OVER (PARTITION BY {by}) AS pos_total, sum(neg) OVER (PARTITION BY {by}) AS neg_total FROM {name}_steps)""",
        f"""{name} AS (SELECT {by}, CASE WHEN sum(pos) * sum(neg) <> 0 THEN
            CAST(sum(pos * (neg_below + neg / 2.0E0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS auc
            FROM {name}_run GROUP BY {by})""",
    )


_RUN = sql_auc("a", "sc", "year, split", "s_prev", "w * y", "w * (1 - y)")
_PRECISION = "CAST(pos_total - pos_below AS DOUBLE) / (pos_total - pos_below + neg_total - neg_below)"
_AT = """sum(CASE WHEN score >= 0.5E0 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5E0 THEN neg ELSE 0 END) AS fp,
    sum(pos) AS p, sum(neg) AS n"""
_AT_VALUES = """round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
    round(coalesce(tp / nullif(CAST(p AS DOUBLE), 0), 0), 6) AS recall,
    round(coalesce(2.0E0 * tp / nullif(CAST(2 * tp + fp + (p - tp) AS DOUBLE), 0), 0), 6) AS f1"""
_EVAL = f"""SELECT year, split, round(sum(pos * {_PRECISION}) / CAST(sum(pos) AS DOUBLE), 6) AS average_precision
    FROM a_run GROUP BY year, split"""


@query(
    "m09_auc",
    sql(
        SQL_SCORES,
        """ranked AS (SELECT year, split, y, rank() OVER w + (count(*) OVER (PARTITION BY year, split, s_prev) - 1) / 2.0E0 AS r
        FROM sc WINDOW w AS (PARTITION BY year, split ORDER BY s_prev))""",
        select="""SELECT year, split, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0E0)
        / CAST(sum(y) * sum(1 - y) AS DOUBLE), 6) AS auc FROM ranked GROUP BY year, split""",
    ),
)
def _(r):
    return me.auc(scores(r), "s_prev", BY)


@query("m09_auc_weighted", sql(SQL_SCORES, *_RUN, select="SELECT year, split, round(auc, 6) AS auc FROM a"))
def _(r):
    return me.auc(weighted(r), "s_prev", BY, "w")


@query("m10_average_precision", sql(SQL_SCORES, *_RUN, select=_EVAL))
def _(r):
    return me.average_precision(weighted(r), "s_prev", BY, "w")


@query(
    "m11_threshold_metrics",
    sql(SQL_SCORES, *_RUN, select=f"SELECT year, split, {_AT_VALUES} FROM (SELECT year, split, {_AT} FROM a_run GROUP BY ALL)"),
)
def _(r):
    return me.threshold_metrics(weighted(r), "s_prev", 0.5, BY, "w")


@query(
    "m12_brier",
    sql(SQL_SCORES, select="SELECT year, split, round(sum(w * (s_prev - y) ** 2) / sum(w), 6) AS brier FROM sc GROUP BY year, split"),
)
def _(r):
    return me.brier(weighted(r), "s_prev", BY, "w")


@query(
    "m13_eval_predictions",
    sql(
        SQL_SCORES,
        *_RUN,
        f"at_t AS (SELECT year, split, {_AT_VALUES}, CAST(p AS BIGINT) AS num_positive, CAST(n AS BIGINT) AS num_negative FROM (SELECT year, split, {_AT} FROM a_run GROUP BY ALL))",
        f"ap AS ({_EVAL})",
        "br AS (SELECT year, split, round(sum(w * (s_prev - y) ** 2) / sum(w), 6) AS brier FROM sc GROUP BY year, split)",
        select="""SELECT at_t.*, round(a.auc, 6) AS auc, ap.average_precision, br.brier FROM at_t JOIN a USING (year, split)
        JOIN ap USING (year, split) JOIN br USING (year, split)""",
    ),
)
def _(r):
    return me.eval_predictions(weighted(r), "s_prev", 0.5, BY, "w")


@query(
    "m14_miss_and_false_alarm_rate",
    sql(
        SQL_SCORES,
        select="""SELECT year, split,
        round(100 * sum(CASE WHEN y = 1 AND s_curr < 0.5E0 THEN 1 ELSE 0 END) / nullif(CAST(sum(y) AS DOUBLE), 0), 6) AS percent_missed,
        round(100 * sum(CASE WHEN y = 0 AND s_curr >= 0.5E0 THEN 1 ELSE 0 END)
            / nullif(CAST(sum(CASE WHEN s_curr >= 0.5E0 THEN 1 ELSE 0 END) AS DOUBLE), 0), 6) AS percent_false
        FROM sc GROUP BY year, split""",
    ),
)
def _(r):
    return me.miss_and_false_alarm_rate(scores(r), "s_curr", 0.5, BY)


_CURVE = f"""curve AS (SELECT year, split, score AS threshold, {_PRECISION} AS precision,
    CAST(pos_total - pos_below AS DOUBLE) / pos_total AS recall FROM c_run)"""
SQL_CURVE = (SQL_SCORES, *sql_auc("c", "sc", "year, split", "s_curr"), _CURVE)


@query(
    "m15_precision_recall_curve",
    sql(
        *SQL_CURVE,
        select="SELECT year, split, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve",
    ),
)
def _(r):
    return me.precision_recall_curve(scores(r), "s_curr", BY)


@query(
    "m16_best_threshold",
    sql(
        *SQL_CURVE,
        """f AS (SELECT *, row_number() OVER (PARTITION BY year, split ORDER BY coalesce(2.0E0 * precision * recall / nullif(precision + recall, 0), -1)
        DESC, threshold) AS rn FROM curve)""",
        select="""SELECT year, split, 'f1' AS criterion, round(threshold, 6) AS threshold FROM f WHERE rn = 1
        UNION ALL SELECT year, split, 'fpr', round(coalesce(min(CASE WHEN precision >= 0.3E0 THEN threshold END), 1), 6) FROM curve GROUP BY 1, 2
        UNION ALL SELECT year, split, 'fnr', round(coalesce(max(CASE WHEN recall >= 0.8E0 THEN threshold END), 0), 6) FROM curve GROUP BY 1, 2""",
    ),
)
def _(r):
    curve = me.precision_recall_curve(scores(r), "s_curr", BY)
    found = [
        me.best_threshold(curve, c, v, BY).select(*BY, F.lit(c).alias("criterion"), "threshold")
        for c, v in (("f1", None), ("fpr", 0.7), ("fnr", 0.2))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


SQL_MODELS = """ms AS (SELECT sample_id, person_id, split, y, year AS eval_year, year - 1 AS model_year, s_prev AS score FROM sc
    UNION ALL SELECT sample_id, person_id, split, y, year, year, s_curr FROM sc)"""


@query(
    "m17_cross_year_evaluation",
    sql(
        SQL_SCORES,
        SQL_MODELS,
        *sql_auc("a", "(SELECT * FROM ms WHERE split = 'test')", "model_year, eval_year", "score"),
        f"at_t AS (SELECT model_year, eval_year, {_AT_VALUES}, CAST(p AS BIGINT) AS num_positive, CAST(n AS BIGINT) AS num_negative FROM (SELECT model_year, eval_year, {_AT} FROM a_run GROUP BY ALL))",
        f"ap AS (SELECT model_year, eval_year, round(sum(pos * {_PRECISION}) / CAST(sum(pos) AS DOUBLE), 6) AS average_precision FROM a_run GROUP BY 1, 2)",
        "br AS (SELECT model_year, eval_year, round(avg((score - y) ** 2), 6) AS brier FROM ms WHERE split = 'test' GROUP BY 1, 2)",
        select="""SELECT at_t.*, round(a.auc, 6) AS auc, ap.average_precision, br.brier FROM at_t JOIN a USING (model_year, eval_year)
        JOIN ap USING (model_year, eval_year) JOIN br USING (model_year, eval_year) WHERE num_positive >= 10 AND num_negative >= 10""",
    ),
)
def _(r):
    return me.cross_year_evaluation(me.model_scores(scores(r)).where("split = 'test'"))


@query(
    "m19_select_by_validation",
    sql(
        SQL_SCORES,
        SQL_MODELS,
        *sql_auc("a", "(SELECT * FROM ms WHERE split = 'valid')", "eval_year, model_year", "score"),
        """r AS (SELECT *, row_number() OVER (PARTITION BY eval_year ORDER BY auc DESC, model_year) AS rn FROM a)""",
        select="SELECT eval_year, model_year, round(auc, 6) AS auc FROM r WHERE rn = 1",
    ),
)
def _(r):
    candidates = me.auc(me.model_scores(scores(r)).where("split = 'valid'"), "score", ["eval_year", "model_year"])
    return me.select_by_validation(candidates, "auc", "model_year", ["eval_year"])


# -------------------------------------------------------------- screens


@query(
    "h01_min_positive_persons",
    sql(
        SQL_SCORES,
        """c AS (SELECT year, split, count(DISTINCT CASE WHEN y = 1 THEN person_id END) AS positive_persons,
        count(DISTINCT CASE WHEN y = 0 THEN person_id END) AS negative_persons FROM sc GROUP BY 1, 2)""",
        select="""SELECT *, CASE WHEN positive_persons >= 240 THEN 1 ELSE 0 END AS enough_positive,
        CASE WHEN negative_persons >= 240 THEN 1 ELSE 0 END AS enough_negative FROM c""",
    ),
)
def _(r):
    return hy.min_positive_persons(scores(r), BY, 240)


@query(
    "h02_min_auc",
    sql(
        SQL_SCORES,
        *sql_auc("a", "sc", "year, split", "s_prev"),
        select="SELECT year, split, round(auc, 6) AS auc, CASE WHEN auc >= 0.6E0 THEN 1 ELSE 0 END AS enough_auc FROM a",
    ),
)
def _(r):
    return hy.min_auc(scores(r), "s_prev", BY, 0.6)


# ----------------------------------------------------------- resampling


def sql_entries_models(name: str, source: str, by: str) -> str:
    return f"""{name} AS (SELECT {by}, person_id, y, 0 AS arm, s_curr AS value FROM {source}
        UNION ALL SELECT {by}, person_id, y, 1, s_prev FROM {source})"""


def sql_entries_datasets(name: str, source: str, by: str = "") -> str:
    extra = f"{by}, " if by else ""
    return f"""{name} AS (SELECT {extra}year + 1 AS year, person_id, y, 0 AS arm, s_curr AS value FROM {source}
        UNION ALL SELECT {extra}year, person_id, y, 1, s_prev FROM {source})"""


def _sql_paired(name: str, by: str) -> str:
    return f"""{name} AS (SELECT {by}, replicate, max(CASE WHEN arm = 0 THEN auc END) AS auc_1, max(CASE WHEN arm = 1 THEN auc END) AS auc_2,
        max(CASE WHEN arm = 0 THEN auc END) - max(CASE WHEN arm = 1 THEN auc END) AS auc_diff FROM {name}_auc GROUP BY {by}, replicate)"""


def sql_bootstrap(name: str, entries: str, by: str, n: int = REPLICATES, seed: int = SEED) -> tuple[str, ...]:
    return (
        f"{name}_people AS (SELECT {by}, person_id, max(y) AS stratum FROM {entries} GROUP BY {by}, person_id)",
        f"""{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {by}, stratum ORDER BY {hash32_sql(seed, 'person_id')}, person_id) AS rk,
            count(*) OVER (PARTITION BY {by}, stratum) AS n FROM {name}_people)""",
        f"""{name}_keys AS (SELECT * FROM (SELECT *, CAST(rk * 2 + stratum AS BIGINT) AS k FROM {name}_ranked)
            CROSS JOIN (SELECT unnest(generate_series(1, {n})) AS replicate))""",
        f"""{name}_drawn AS (SELECT {by}, stratum, replicate, {below_sql('n')} + 1 AS rk, count(*) AS w
            FROM {draw62_sql(f'{name}_keys', 'k', 'replicate', seed)} GROUP BY ALL)""",
        f"""{name}_weights AS (SELECT q.*, d.replicate, d.w FROM {name}_ranked q JOIN {name}_drawn d USING ({by}, stratum, rk))""",
        f"""{name}_same AS MATERIALIZED (SELECT {by}, person_id, arm, y, value, count(*) AS times FROM {entries} GROUP BY ALL)""",
        f"""{name}_rows AS (SELECT e.*, d.replicate, d.w * e.times AS w FROM {name}_same e JOIN {name}_weights d USING ({by}, person_id))""",
        *sql_auc(f"{name}_auc", f"{name}_rows", f"{by}, replicate, arm", "value", "w * y", "w * (1 - y)"),
        _sql_paired(name, by),
    )


def sql_permutation(name: str, entries: str, by: str, n: int = REPLICATES, seed: int = SEED) -> tuple[str, ...]:
    return (
        f"""{name}_keyed AS MATERIALIZED (SELECT {by}, arm, y, value, {key62_sql(seed, 'person_id')} AS k, count(*) AS times FROM {entries} GROUP BY ALL)""",
        f"""{name}_tossed AS (SELECT * FROM {name}_keyed CROSS JOIN (SELECT unnest(generate_series(1, {n})) AS replicate))""",
        f"""{name}_rows AS (SELECT {by}, y, value, times, replicate, xor(arm, CAST((draw_2 >> 9) & 1 AS INT)) AS arm
            FROM {draw62_sql(f'{name}_tossed', 'k', 'replicate', seed)})""",
        *sql_auc(f"{name}_auc", f"{name}_rows", f"{by}, replicate, arm", "value", "times * y", "times * (1 - y)"),
        _sql_paired(name, by),
    )


def sql_actual(name: str, entries: str, by: str) -> tuple[str, ...]:
    return (
        *sql_auc(f"{name}_arms", entries, f"{by}, arm", "value"),
        f"""{name} AS (SELECT {by}, max(CASE WHEN arm = 0 THEN auc END) AS actual_1, max(CASE WHEN arm = 1 THEN auc END) AS actual_2,
            max(CASE WHEN arm = 0 THEN auc END) - max(CASE WHEN arm = 1 THEN auc END) AS actual_diff FROM {name}_arms GROUP BY {by})""",
    )


def sql_ci(name: str, replicates: str, actual: str, by: str) -> str:
    return f"""{name} AS (SELECT {by}, a.actual_1, a.actual_2, a.actual_diff, 2 * a.actual_diff - q.hi AS ci_low, 2 * a.actual_diff - q.lo AS ci_high,
        (a.actual_diff > 0 AND 2 * a.actual_diff - q.hi > 0) AS above_zero
        FROM {actual} a JOIN (SELECT {by}, quantile_cont(auc_diff, 0.05) AS lo, quantile_cont(auc_diff, 0.95) AS hi
        FROM {replicates} GROUP BY {by}) q USING ({by}))"""


def sql_p(name: str, replicates: str, actual: str, by: str) -> str:
    return f"""{name} AS (SELECT {by}, max(a.actual_diff) AS actual_diff,
        (1 + sum(CASE WHEN r.auc_diff >= a.actual_diff THEN 1 ELSE 0 END)) / CAST(1 + count(*) AS DOUBLE) AS p_value
        FROM {replicates} r JOIN {actual} a USING ({by}) GROUP BY {by})"""


def sql_ranked(name: str, entries: str, by: str) -> str:
    over = f"PARTITION BY {by}, arm"
    return f"""{name} AS (SELECT {by}, person_id, y, arm, (rank() OVER ({over} ORDER BY value)
        + (count(*) OVER ({over}, value) - 1) / 2.0E0) / CAST(count(*) OVER ({over}) AS DOUBLE) AS value FROM {entries})"""


_VALID = "(SELECT * FROM sc WHERE split = 'valid')"
_TEST = "(SELECT * FROM sc WHERE split = 'test')"
SQL_BOOT_MODELS = (SQL_SCORES, sql_entries_models("e", _VALID, "year"), *sql_bootstrap("b", "e", "year"))
# only years that have a year before can be compared with it
SQL_BOTH_YEARS = "e AS (SELECT * FROM e0 WHERE year IN (SELECT year FROM sc) AND year - 1 IN (SELECT year FROM sc))"
SQL_BOOT_DATASETS = (
    SQL_SCORES,
    sql_entries_datasets("e0", _VALID),
    SQL_BOTH_YEARS,
    *sql_bootstrap("b", "e", "year"),
)
_REPS = "SELECT year, replicate, round(auc_1, 6) AS auc_1, round(auc_2, 6) AS auc_2, round(auc_diff, 6) AS auc_diff FROM"


def valid_entries(r):
    return rs.two_models(scores(r).where("split = 'valid'"), ["year"])


def dataset_entries(r, split):
    rows = scored(r, split)
    entries = hy.year_entries(rows, [], True)
    years = rows.select("year").distinct()
    both = years.join(years.select((F.col("year") + 1).alias("year")), "year", "left_semi")
    return entries.join(both, "year", "left_semi")


@query("h03_bootstrap_auc_diff_models", sql(*SQL_BOOT_MODELS, select=f"{_REPS} b"))
def _(r):
    return rs.bootstrap_aucs(valid_entries(r), ["year"], REPLICATES, SEED)


@query("h04_bootstrap_auc_diff_datasets", sql(*SQL_BOOT_DATASETS, select=f"{_REPS} b"))
def _(r):
    return rs.bootstrap_aucs(dataset_entries(r, "valid"), ["year"], REPLICATES, SEED)


_CI = """SELECT year, round(actual_1, 6) AS actual_1, round(actual_2, 6) AS actual_2, round(actual_diff, 6) AS actual_diff,
    round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, CAST(above_zero AS INT) AS above_zero FROM ci"""


@query(
    "h05_pivotal_ci",
    sql(*SQL_BOOT_MODELS, *sql_actual("act", "e", "year"), sql_ci("ci", "b", "act", "year"), select=_CI),
)
def _(r):
    entries = rs.two_models(scored(r, "valid"), ["year"])
    replicates = rs.bootstrap_aucs(entries, ["year"], REPLICATES, SEED)
    ci = rs.pivotal_ci(replicates, rs.actual_difference(entries, ["year"]), ["year"])
    return ci.withColumn("above_zero", F.col("above_zero").cast("int"))


@query(
    "h06_bootstrap_se",
    sql(*SQL_BOOT_MODELS, select="SELECT year, round(stddev_pop(auc_1), 6) AS auc_se FROM b GROUP BY year"),
)
def _(r):
    return rs.bootstrap_se(rs.bootstrap_aucs(valid_entries(r), ["year"], REPLICATES, SEED), ["year"])


@query(
    "h07_normalized_ranks",
    sql(
        SQL_SCORES,
        select="""SELECT sample_id, year, split, round((rank() OVER (PARTITION BY year, split ORDER BY s_curr)
        + (count(*) OVER (PARTITION BY year, split, s_curr) - 1) / 2.0E0) / CAST(count(*) OVER (PARTITION BY year, split) AS DOUBLE), 6)
        AS normalized_rank FROM sc""",
    ),
)
def _(r):
    ranked = me.normalized_ranks(scores(r), "s_curr", BY)
    return ranked.select("sample_id", "year", "split", "normalized_rank")


SQL_PERM_MODELS = (
    SQL_SCORES,
    sql_entries_models("e", _TEST, "year"),
    sql_ranked("er", "e", "year"),
    *sql_permutation("pm", "er", "year"),
    *sql_actual("act", "e", "year"),
    sql_p("pv", "pm", "act", "year"),
)
_P = "SELECT year, round(actual_diff, 6) AS actual_diff, round(p_value, 6) AS p_value FROM pv"


@query("h08_permutation_test_models", sql(*SQL_PERM_MODELS, select=_P))
def _(r):
    entries = rs.two_models(scored(r, "test"), ["year"])
    replicates = rs.permutation_aucs(hy.ranked_entries(entries, ["year"]), ["year"], REPLICATES, SEED)
    return rs.permutation_p_value(replicates, rs.actual_difference(entries, ["year"]), ["year"])


@query(
    "h09_permutation_test_datasets",
    sql(
        SQL_SCORES,
        sql_entries_datasets("e0", _TEST),
        SQL_BOTH_YEARS,
        *sql_permutation("pm", "e", "year"),
        *sql_actual("act", "e", "year"),
        sql_p("pv", "pm", "act", "year"),
        select=_P,
    ),
)
def _(r):
    entries = dataset_entries(r, "test")
    replicates = rs.permutation_aucs(entries, ["year"], REPLICATES, SEED)
    return rs.permutation_p_value(replicates, rs.actual_difference(entries, ["year"]), ["year"])


# ---------------------------------------------------------- discovery control

SQL_YEAR_RATES = """brand_rates AS (SELECT p.p_brand AS brand, p.p_size AS size,
    CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS a,
    CAST(sum(CASE WHEN l.l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS b FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2)"""
SQL_TABLES = """tables AS (SELECT brand, size, a, b, (SELECT CAST(sum(a) AS BIGINT) FROM brand_rates) - a AS c,
    (SELECT CAST(sum(b) AS BIGINT) FROM brand_rates) - b AS d FROM brand_rates)"""
SQL_CHI = """chi AS (SELECT *, CAST(a + b + c + d AS DOUBLE) * power(abs(CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c)
    - least((a + b + c + d) / 2.0E0, abs(CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c)), 2)
    / (CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) AS chi2 FROM tables)"""


def return_tables(r):
    """2x2 tables: returned or not, within a brand and size against everywhere else."""
    joined = r["lineitem"].join(r["part"], F.col("l_partkey") == F.col("p_partkey"))
    returned = (F.col("l_returnflag") == "R").cast("int")
    rates = joined.groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(
        F.sum(returned).alias("a"), F.sum(1 - returned).alias("b")
    )
    all_a, all_b = rates.agg(F.sum("a")).scalar(), rates.agg(F.sum("b")).scalar()
    return rates.select("brand", "size", "a", "b", (all_a - F.col("a")).alias("c"), (all_b - F.col("b")).alias("d"))


@query(
    "h10_benjamini_hochberg",
    sql(
        SQL_YEAR_RATES,
        SQL_TABLES,
        SQL_CHI,
        f"hyp AS (SELECT brand, size, round({chi2_p_sql('chi2')}, 9) AS p_value FROM chi)",
        """ranked AS (SELECT *, rank() OVER (ORDER BY p_value) AS rank,
        rank() OVER (ORDER BY p_value) / CAST(count(*) OVER () AS DOUBLE) * 0.05E0 AS critical FROM hyp)""",
        """lastr AS (SELECT max(rank) AS last FROM ranked WHERE p_value < critical)""",
        select="""SELECT brand, size, round(p_value, 6) AS p_value, rank, round(critical, 6) AS critical,
        coalesce(CASE WHEN rank <= (SELECT last FROM lastr) THEN 1 ELSE 0 END, 0) AS accepted FROM ranked""",
    ),
)
def _(r):
    tested = hy.chi2_2x2(return_tables(r), "a", "b", "c", "d")
    return hy.benjamini_hochberg(tested.select("brand", "size", F.round("chi2_p_value", 9).alias("p_value")))


@query(
    "h13_chi2_2x2",
    sql(
        SQL_YEAR_RATES,
        SQL_TABLES,
        SQL_CHI,
        select=f"""SELECT brand, size, a, b, c, d, round(chi2, 6) AS chi2, round({chi2_p_sql('chi2')}, 6) AS chi2_p_value FROM chi""",
    ),
)
def _(r):
    return hy.chi2_2x2(return_tables(r), "a", "b", "c", "d")


# ------------------------------------------------------------ yearly checks


def sql_check(baseline: bool, source: str = "sc", by: str = "", n: int = REPLICATES, x: str = "") -> tuple[str, ...]:
    """The yearly check as SQL: the first failing screen is named, and only groups that pass it are resampled.

    ``x`` goes before the names of all its tables, so that two checks fit into one query.
    """
    keys = f"{by}, year" if by else "year"
    extra = f"{by}, " if by else ""
    on_prev = " AND ".join([*[f"p.{b} = c.{b}" for b in by.split(", ") if by], "p.year = c.year - 1"])
    valid, test = (f"(SELECT * FROM {source} WHERE split = '{s}')" for s in ("valid", "test"))
    entries = sql_entries_datasets if baseline else sql_entries_models
    over = by if baseline else keys
    test_entries = (
        (f"{x}te AS (SELECT * FROM {x}te0 JOIN {x}open USING ({keys}))",)
        if baseline
        else (f"{x}te1 AS (SELECT * FROM {x}te0 JOIN {x}open USING ({keys}))", sql_ranked(f"{x}te", f"{x}te1", keys))
    )
    curr_rule = "" if baseline else "WHEN coalesce(c.auc, 0) < 0.5E0 THEN 'low AUC of current model'"
    prev_rule = "WHEN p.test_pos < 20 THEN 'few test outcomes in previous year'" if baseline else ""
    return (
        f"""{x}persons AS (SELECT {keys}, count(DISTINCT CASE WHEN y = 1 AND split = 'valid' THEN person_id END) AS valid_pos,
            count(DISTINCT CASE WHEN y = 1 AND split = 'test' THEN person_id END) AS test_pos FROM {source} GROUP BY {keys})""",
        *sql_auc(f"{x}va", valid, keys, "s_curr"),
        f"{x}facts AS (SELECT q.*, v.auc FROM {x}persons q LEFT JOIN {x}va v USING ({keys}))",
        f"""{x}staged AS (SELECT {', '.join(f'c.{b}' for b in by.split(', ')) + ', ' if by else ''}c.year, CASE WHEN p.valid_pos < 25 THEN 'few validation outcomes in previous year'
            WHEN c.valid_pos < 25 THEN 'few validation outcomes in current year'
            WHEN coalesce(p.auc, 0) < 0.5E0 THEN 'low AUC of previous model' {curr_rule} END AS screen,
            CASE WHEN c.test_pos < 20 THEN 'few test outcomes in current year' {prev_rule} END AS few
            FROM {x}facts c JOIN {x}facts p ON {on_prev})""",
        entries(f"{x}ve0", valid, over),
        f"{x}ve AS (SELECT * FROM {x}ve0 JOIN (SELECT {keys} FROM {x}staged WHERE screen IS NULL) USING ({keys}))",
        *sql_bootstrap(f"{x}vb", f"{x}ve", keys, n),
        *sql_actual(f"{x}vact", f"{x}ve", keys),
        sql_ci(f"{x}vci", f"{x}vb", f"{x}vact", keys),
        f"{x}open AS (SELECT {keys} FROM {x}staged JOIN {x}vci USING ({keys}) WHERE screen IS NULL AND few IS NULL AND above_zero)",
        entries(f"{x}te0", test, over),
        *test_entries,
        *sql_permutation(f"{x}tp", f"{x}te", keys, n),
        *sql_actual(f"{x}tact", f"{x}te", keys),
        sql_p(f"{x}tpv", f"{x}tp", f"{x}tact", keys),
        f"""{x}checked AS (SELECT {extra}year, CASE WHEN screen IS NOT NULL THEN screen WHEN NOT coalesce(above_zero, FALSE) THEN 'interval not above 0'
            WHEN few IS NOT NULL THEN few ELSE 'tested' END AS status, CASE WHEN screen IS NULL THEN ci_low END AS ci_low, p_value AS p
            FROM {x}staged LEFT JOIN {x}vci USING ({keys}) LEFT JOIN {x}tpv USING ({keys}))""",
    )


_CHECKED = """SELECT year, status, round(ci_low, 6) AS ci_low, round(CASE WHEN status LIKE 'few test%' THEN 1
    WHEN status = 'tested' THEN p END, 6) AS p_value FROM checked"""


@query("h11_nonstationarity_check", sql(SQL_SCORES, *sql_check(False), select=_CHECKED))
def _(r):
    return hy.nonstationarity_check(scored(r, "valid", "test"), [], REPLICATES, SEED)


@query("h12_baseline_nonstationarity_check", sql(SQL_SCORES, *sql_check(True), select=_CHECKED))
def _(r):
    return hy.nonstationarity_check(scored(r, "valid", "test"), [], REPLICATES, SEED, baseline=True)
