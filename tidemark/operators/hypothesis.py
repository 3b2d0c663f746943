"""Screens, hypothesis tests and false-discovery control.

A check runs in three steps, each on the groups that passed the one before:
counts and AUCs, then the bootstrap screen on validation data, then the
permutation test on test data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import chi2_p_sql, ratio
from tidemark.functions.ranking import join_on, running_sums
from tidemark.operators import resampling as rs
from tidemark.operators.metrics import auc
from tidemark.session import materialize

# Least persons with the outcome, least AUC, false-discovery rate.
MIN_VALID_PERSONS = 25
MIN_TEST_PERSONS = 20
MIN_AUC = 0.5
FDR = 0.05


def outcome_persons(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct persons with any positive and with any negative sample per group."""
    per_person = samples.groupBy(*by, "person_id").agg(F.max("y").alias("_pos"), F.max(1 - F.col("y")).alias("_neg"))
    return per_person.groupBy(*by).agg(F.sum("_pos").alias("positive_persons"), F.sum("_neg").alias("negative_persons"))


def min_positive_persons(samples: DataFrame, by: Sequence[str], k: int = MIN_VALID_PERSONS) -> DataFrame:
    counts = outcome_persons(samples, by)
    return counts.select(
        *by,
        "positive_persons",
        "negative_persons",
        (F.col("positive_persons") >= k).cast("int").alias("enough_positive"),
        (F.col("negative_persons") >= k).cast("int").alias("enough_negative"),
    )


def min_auc(scores: DataFrame, score: str, by: Sequence[str], least: float = MIN_AUC) -> DataFrame:
    return auc(scores, score, by).withColumn("enough_auc", F.coalesce((F.col("auc") >= least).cast("int"), F.lit(0)))


def benjamini_hochberg(
    hypotheses: DataFrame, p: str = "p_value", fdr: float = FDR, by: Sequence[str] = ()
) -> DataFrame:
    """Rank (ties share the smallest), critical value rank / n * fdr, and acceptance.

    Everything up to the largest rank with p < critical is accepted.
    """
    hypotheses = materialize(hypotheses)
    group = list(by)
    if not group:
        hypotheses, group = hypotheses.withColumn("_all", F.lit(1)), ["_all"]
    counts = hypotheses.groupBy(*group, p).agg(F.count(F.lit(1)).alias("_n"))
    run = running_sums(counts, order=p, sums=["_n"], by=group)
    ranked = run.select(
        *group,
        p,
        (F.col("_n_below") + 1).alias("rank"),
        ((F.col("_n_below") + 1).cast("double") / F.col("_n_total").cast("double") * F.lit(float(fdr))).alias("critical"),
    )
    last = ranked.where(F.col(p) < F.col("critical")).groupBy(*group).agg(F.max("rank").alias("_last"))
    tested = join_on(join_on(hypotheses, ranked, [*group, p]), last, group, "left")
    accept = F.coalesce((F.col("rank") <= F.col("_last")).cast("int"), F.lit(0))
    return tested.withColumn("accepted", accept).drop("_last", "_all")


def chi2_statistic(a: str, b: str, c: str, d: str) -> Column:
    """Chi-squared of the 2x2 table [[a, b], [c, d]] with Yates correction; null if a margin is empty."""
    n11, n12, n21, n22 = (F.col(x).cast("double") for x in (a, b, c, d))
    total = n11 + n12 + n21 + n22
    gap = F.abs(n11 * n22 - n12 * n21)
    half = F.least(total / F.lit(2).cast("double"), gap)
    margins = (n11 + n12) * (n21 + n22) * (n11 + n21) * (n12 + n22)
    return F.when(margins > 0, total * (gap - half) * (gap - half) / margins)


def chi2_p_value(statistic: str) -> Column:
    """Upper tail of chi-squared with one degree of freedom."""
    return F.expr(chi2_p_sql(statistic))


def chi2_2x2(table: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    with_statistic = table.withColumn("chi2", chi2_statistic(a, b, c, d))
    return with_statistic.withColumn("chi2_p_value", chi2_p_value("chi2"))


# ----------------------------------------------------------- yearly checks


def shifted(facts: DataFrame, by: Sequence[str], prefix: str, years: int) -> DataFrame:
    renamed = [F.col(c).alias(f"{prefix}_{c}") for c in facts.columns if c not in (*by, "year")]
    return facts.select(*by, (F.col("year") + years).alias("year"), *renamed)


def screen_facts(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and year: persons by outcome in validation and test, and the own model's validation AUC."""
    keys = [*by, "year"]
    per_person = scores.where(F.col("split").isin("valid", "test")).groupBy(*keys, "split", "person_id").agg(
        F.max("y").alias("_pos"), F.max(1 - F.col("y")).alias("_neg")
    )

    def count(split: str, column: str) -> Column:
        return F.sum(F.when(F.col("split") == split, F.col(column)).otherwise(0))

    persons = per_person.groupBy(*keys).agg(
        *[count(s, f"_{o}").alias(f"{s}_{o}") for s in ("valid", "test") for o in ("pos", "neg")]
    )
    aucs = auc(scores.where("split = 'valid'"), "s_curr", keys).withColumnRenamed("auc", "valid_auc")
    return join_on(persons, aucs, keys, "left")


def yearly_pairs(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Facts of each year next to those of the year before."""
    facts = materialize(screen_facts(scores, by))
    return join_on(shifted(facts, by, "curr", 0), shifted(facts, by, "prev", 1), [*by, "year"])


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """Name of the first rule that fails; null if all hold."""
    reason = F.when(~F.coalesce(rules[0][0], F.lit(False)), F.lit(rules[0][1]))
    for holds, name in rules[1:]:
        reason = reason.when(~F.coalesce(holds, F.lit(False)), F.lit(name))
    return reason


def year_entries(scores: DataFrame, by: Sequence[str], baseline: bool) -> DataFrame:
    """Entries of the yearly comparison.

    Two models on the current year; or, for the baseline, the previous model on
    the previous and on the current year.
    """
    keys = [*by, "year"]
    if not baseline:
        return rs.two_models(scores, keys, "s_curr", "s_prev")
    before = scores.select(*by, (F.col("year") + 1).alias("year"), "person_id", "y", F.col("s_curr").alias("score"))
    now = scores.select(*keys, "person_id", "y", F.col("s_prev").alias("score"))
    return rs.two_datasets(before, now, keys)


def bootstrap_screen(
    scores: DataFrame, groups: DataFrame, by: Sequence[str], n: int, seed: int, baseline: bool
) -> DataFrame:
    """Confidence interval of the AUC difference on validation data, for the given (by, year) groups."""
    keys = [*by, "year"]
    entries = year_entries(scores.where("split = 'valid'"), by, baseline)
    entries = materialize(join_on(entries, groups.select(*keys), keys, "left_semi"))
    replicates = rs.bootstrap_aucs(entries, keys, n, seed)
    return rs.pivotal_ci(replicates, rs.actual_difference(entries, keys), keys)


def test_p_values(
    scores: DataFrame, groups: DataFrame, by: Sequence[str], n: int, seed: int, baseline: bool
) -> DataFrame:
    """Permutation p-value on test data for the given (by, year) groups.

    The arms of two models are compared by normalized rank, which leaves the AUC
    of each model unchanged and makes their scores exchangeable.
    """
    keys = [*by, "year"]
    entries = year_entries(scores.where("split = 'test'"), by, baseline)
    entries = materialize(join_on(entries, groups.select(*keys), keys, "left_semi"))
    if not baseline:
        entries = ranked_entries(entries, keys)
    replicates = rs.permutation_aucs(entries, keys, n, seed)
    return rs.permutation_p_value(replicates, rs.actual_difference(entries, keys), keys)


def ranked_entries(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    from tidemark.operators.metrics import normalized_ranks

    ranked = normalized_ranks(entries, "value", [*by, "arm"])
    return ranked.drop("value").withColumnRenamed("normalized_rank", "value")


def nonstationarity_check(
    scores: DataFrame,
    by: Sequence[str] = (),
    n: int = rs.REPLICATES,
    seed: int = 0,
    min_valid: int = MIN_VALID_PERSONS,
    min_test: int = MIN_TEST_PERSONS,
    least_auc: float = MIN_AUC,
    baseline: bool = False,
) -> DataFrame:
    """Per year: the p-value, or null with the screen that failed, or 1 if the test data are too few."""
    keys = [*by, "year"]
    pairs = yearly_pairs(scores, by)
    rules = [
        (F.col("prev_valid_pos") >= min_valid, "few validation outcomes in previous year"),
        (F.col("curr_valid_pos") >= min_valid, "few validation outcomes in current year"),
        (F.col("prev_valid_auc") >= least_auc, "low AUC of previous model"),
    ]
    if not baseline:
        rules.append((F.col("curr_valid_auc") >= least_auc, "low AUC of current model"))
    screened = materialize(pairs.withColumn("_screen", first_reason(rules)))
    intervals = bootstrap_screen(scores, screened.where("_screen IS NULL"), by, n, seed, baseline)
    passed = materialize(join_on(screened, intervals.select(*keys, "ci_low", "above_zero"), keys, "left"))
    enough = [(F.col("curr_test_pos") >= min_test, "few test outcomes in current year")]
    if baseline:
        enough.append((F.col("prev_test_pos") >= min_test, "few test outcomes in previous year"))
    status = (
        F.when(F.col("_screen").isNotNull(), F.col("_screen"))
        .when(~F.coalesce("above_zero", F.lit(False)), "interval not above 0")
        .otherwise(F.coalesce(first_reason(enough), F.lit("tested")))
    )
    passed = passed.withColumn("status", status)
    p = test_p_values(scores, passed.where("status = 'tested'"), by, n, seed, baseline)
    few = F.col("status").startswith("few test")
    joined = join_on(passed, p.select(*keys, F.col("p_value").alias("_p")), keys, "left")
    return joined.select(*keys, "status", "ci_low", F.when(few, 1.0).otherwise(F.col("_p")).alias("p_value"))
