"""Domain-shift and conditional-shift diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import age_band, bin_index, clip, ratio
from tidemark.functions.ranking import exact_percentiles, join_on, running_sums
from tidemark.operators import hypothesis as hy
from tidemark.operators import resampling as rs
from tidemark.operators.features import SEPARATOR, name_part
from tidemark.operators.metrics import auc
from tidemark.session import materialize

SAMPLE = ("person_id", "end_date")

# Normal quantile, weight bounds, and thresholds on coefficients and frequencies.
Z95 = 1.96
WEIGHT_BOUNDS = (0.01, 10.0)
LABEL_SHIFT_P = 0.05
TOP_COEFFICIENT = 0.01
LARGE_COEFFICIENT = 1e-3
SMALL_COEFFICIENT = 1e-4
MIN_VALID_FREQUENCY = 20
MIN_YEAR_FREQUENCY = 100
FREQUENCY_GAP = 100
CORRELATION = 0.95
PREFIX_CHARS = 30

# Word parts that say nothing about which drug it is.
DRUG_STOP_WORDS = (
    "0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "tablet", "oral", "inject", "mg", "ml", "pack",
    "week", "day", "delay", "release", "capsule", "disintegrat", "solution", "medicat", "patch", "daily",
    "twice", "hr", "topical", "hour", "lotion", "extend", "regular", "human", "actuat", "gel", "syringe",
    "prefill", "cream", "chew", "inert", "ingredient", "opthalmic", "spray", "nasal", "month", "rectal",
    "suppository", "suspension", "inhal", "vaccine", "virus", "viral", "live", "strain", "toxoid",
    "antigen", "type", "protein", "like", "surface", "activ", "dose", "dosage", "meter",
)


# ----------------------------------------------------------- feature frequencies


def restrict_months_and_features(long: DataFrame, months: tuple[int, int], suffix: str) -> DataFrame:
    """Rows whose index date lies in the given months, and features of one window."""
    return long.where(F.month("end_date").between(*months) & F.col("feature").endswith(suffix))


def feature_frequency_shift(
    long: DataFrame,
    samples: DataFrame,
    year_prev: int,
    year_curr: int,
    min_valid: int = MIN_VALID_FREQUENCY,
    fdr: float = hy.FDR,
) -> DataFrame:
    """Test frequency of each feature in two years with chi-squared, its p-value and false-discovery control."""
    years = F.col("year").isin(year_prev, year_curr)

    in_test = F.col("split") == "test"
    sizes = materialize(
        samples.agg(
            *[F.count(F.when(in_test & (F.col("year") == y), 1)).alias(f"n_{i}") for i, y in enumerate((year_prev, year_curr))]
        )
    )

    def size(year: int) -> Column:
        return sizes.select("n_0" if year == year_prev else "n_1").scalar()

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    is_test = F.col("split") == "test"
    counts = long.where(years & F.col("split").isin("valid", "test")).groupBy("feature").agg(
        count(F.col("split") == "valid").alias("num_valid"),
        count(is_test & (F.col("year") == year_prev)).alias("with_prev"),
        count(is_test & (F.col("year") == year_curr)).alias("with_curr"),
    )
    table = counts.where(F.col("num_valid") >= min_valid).select(
        "feature",
        "with_prev",
        (size(year_prev) - F.col("with_prev")).alias("without_prev"),
        "with_curr",
        (size(year_curr) - F.col("with_curr")).alias("without_curr"),
    )
    tested = hy.chi2_2x2(table, "without_prev", "with_prev", "without_curr", "with_curr")
    controlled = hy.benjamini_hochberg(tested.where("chi2_p_value IS NOT NULL"), "chi2_p_value", fdr)
    freq_prev = F.col("with_prev") / (F.col("with_prev") + F.col("without_prev"))
    freq_curr = F.col("with_curr") / (F.col("with_curr") + F.col("without_curr"))
    framed = controlled.withColumn("freq_prev", freq_prev).withColumn("freq_curr", freq_curr)
    return framed.withColumn("freq_sum", F.col("freq_prev") + F.col("freq_curr")).orderBy(F.desc("freq_sum"), "feature")


def frequency_ci(frequencies: DataFrame, n_prev: Column | int, n_curr: Column | int) -> DataFrame:
    """Long form of two yearly frequencies with half-widths of their 95 % intervals."""

    def side(label: str, column: str, n: Column | int) -> Column:
        f = F.col(column)
        half = Z95 * F.sqrt(f * (1 - f) / (n if isinstance(n, Column) else F.lit(n)))
        return F.struct(F.lit(label).alias("period"), f.alias("frequency"), half.alias("half_width"))

    both = F.explode(F.array(side("previous", "freq_prev", n_prev), side("current", "freq_curr", n_curr)))
    return frequencies.withColumn("_f", both).select("feature", "_f.*")


def condition_dependent_tasks(accepted: DataFrame, coefficients: DataFrame, yearly: DataFrame, k: int) -> DataFrame:
    """Shifted tasks with a condition among the k largest or smallest coefficients and no label shift.

    ``coefficients`` are those of the year before; ``yearly`` holds samples and
    positives of both years per task.
    """
    high = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("coefficient"), "feature"))
    low = F.row_number().over(Window.partitionBy("task").orderBy("coefficient", F.desc("feature")))
    ranked = coefficients.withColumn("_high", high).withColumn("_low", low)
    top = ranked.where(
        (F.least("_high", "_low") <= k)
        & (name_part(2, "feature") == "condition")
        & (F.abs("coefficient") > TOP_COEFFICIENT)
    )
    table = yearly.withColumn("neg_prev", F.col("n_prev") - F.col("pos_prev")).withColumn(
        "neg_curr", F.col("n_curr") - F.col("pos_curr")
    )
    tested = hy.chi2_2x2(table, "neg_prev", "pos_prev", "neg_curr", "pos_curr")
    stable = tested.where(F.col("chi2_p_value") > LABEL_SHIFT_P)
    return accepted.join(top, "task", "left_semi").join(stable, "task", "left_semi")


# --------------------------------------------------------------- imputation


def impute_missing_feature(samples: DataFrame, feature: str, predicted: str, threshold: float = 0.5) -> DataFrame:
    """Keep observed presence; elsewhere take the predicted label."""
    filled = F.when(F.col(feature) == 1, 1).otherwise((F.col(predicted) >= threshold).cast("int"))
    return samples.withColumn(f"{feature}_imputed", filled)


def cell_rates(train: DataFrame, by: Sequence[str], cell: str, label: str) -> DataFrame:
    """The saturated logistic regression of a 0/1 label on one indicator: ``rate``, and ``balanced`` for balanced classes, per group and cell."""
    cells = train.groupBy(*by, cell).agg(F.sum(label).alias("_a"), F.sum(1 - F.col(label)).alias("_b"))
    sizes = train.groupBy(*by).agg(F.sum(label).alias("_n1"), F.sum(1 - F.col(label)).alias("_n0"))
    a, b = F.col("_a") * F.col("_n0"), F.col("_b") * F.col("_n1")
    rates = [ratio(F.col("_a"), F.col("_a") + F.col("_b")).alias("rate"), ratio(a, a + b).alias("balanced")]
    return join_on(cells, sizes, list(by)).select(*by, cell, *rates)


def by_fit(samples: DataFrame, fitted: DataFrame) -> DataFrame:
    """Every sample once for the fit of its own year (``fit`` 'current') and once for that of the year before ('previous'), where there is one."""
    lags = F.array(*[F.struct(F.lit(n).alias("fit"), (F.col("year") - k).alias("fit_year")) for k, n in enumerate(("current", "previous"))])
    both = samples.withColumn("_l", F.explode(lags)).select("*", "_l.*").drop("_l")
    return both.join(fitted.select(F.col("year").alias("fit_year")).distinct(), "fit_year", "left_semi")


def with_rate(samples: DataFrame, fitted: DataFrame, cell: str, rate: str, name: str) -> DataFrame:
    """Samples of ``by_fit`` with the rate of their cell in that year's fit; 0 for a cell that the fit never met."""
    rates = fitted.select(F.col("year").alias("fit_year"), cell, F.col(rate).alias(name))
    return samples.join(rates, ["fit_year", cell], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def imputation_counts(samples: DataFrame, feature: str, by: Sequence[str]) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.sum(feature).alias("num_before"), F.sum(f"{feature}_imputed").alias("num_after"), F.count(F.lit(1)).alias("num_samples")
    )


def variants(scores: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Several score columns in long form: ``variant`` and ``score`` (raw and imputed, old and new model, ...)."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("score")) for n, c in columns.items()]))
    return scores.withColumn("_v", stacked).select("*", "_v.*").drop("_v")


def three_way_evaluation(scores: DataFrame, year: int, by: Sequence[str] = ()) -> DataFrame:
    """Old model on the old year, old model on the new year, new model on the new year."""
    old, new = scores.where(F.col("year") == year - 1), scores.where(F.col("year") == year)

    def part(df: DataFrame, score: str, name: str) -> DataFrame:
        return df.select(*by, "y", F.col(score).alias("score"), F.lit(name).alias("pair"))

    rows = part(old, "s_curr", "old on old").unionByName(part(new, "s_prev", "old on new"))
    return auc(rows.unionByName(part(new, "s_curr", "new on new")), "score", [*by, "pair"])


# ------------------------------------------------------------------ weights


def importance_weights(scores: DataFrame, p: str, bounds: tuple[float, float] = WEIGHT_BOUNDS) -> DataFrame:
    """Odds of the later year, clipped; a probability of one takes the upper bound."""
    odds = F.when(F.col(p) >= 1, F.lit(float(bounds[1]))).otherwise(F.col(p) / (1 - F.col(p)))
    return scores.withColumn("weight", clip(odds, *bounds))


# The percentiles reported for a weight distribution.
WEIGHT_PERCENTILES = (0.025, 0.25, 0.5, 0.75, 0.975)


def weight_percentiles(weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact percentiles with minimum and maximum as probabilities 0 and 1."""
    return exact_percentiles(weights, "weight", [0.0, *WEIGHT_PERCENTILES, 1.0], by=by)


def weight_histogram(weights: DataFrame, by: Sequence[str], bins: int = 100, bounds: tuple[float, float] = WEIGHT_BOUNDS) -> DataFrame:
    """Counts in bins of equal width on the log scale."""
    low, high = float(np.log10(bounds[0])), float(np.log10(bounds[1]))
    index = bin_index(F.round(F.log10("weight"), 9), low, high, bins)
    return weights.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("num_samples"))


# ------------------------------------------------------- conditional rates


def rate_with_and_without(samples: DataFrame, present: DataFrame, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Samples, positives and rate per year, with and without a feature."""
    flagged = samples.join(present.withColumn("_has", F.lit(1)), list(keys), "left")
    return flagged.groupBy("year", F.coalesce("_has", F.lit(0)).alias("has_feature")).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.sum("y").alias("num_positive"),
        F.avg(F.col("y").cast("double")).alias("rate"),
    )


def any_of_features(long: DataFrame, features: Sequence[str], keys: Sequence[str] = SAMPLE) -> DataFrame:
    return long.where(F.col("feature").isin(*features)).select(*keys).distinct()


def age_histogram(samples: DataFrame, bins: int = 20, by: Sequence[str] = ("year",)) -> DataFrame:
    index = bin_index(F.col("age").cast("double"), 0, 100, bins)
    return samples.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("num_samples"))


def outcomes_by_age_band(samples: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    band = age_band("end_date", "year_of_birth")
    return samples.groupBy(*by, band.alias("age_range")).agg(
        F.count(F.lit(1)).alias("num_samples"), F.sum("y").alias("num_positive")
    )


def subpopulation_filter(
    samples: DataFrame,
    long: DataFrame | None,
    features: Sequence[str],
    relation: str,
    keys: Sequence[str] = SAMPLE,
    complement: bool = False,
) -> DataFrame:
    """Samples with all (AND) or any (OR) of the features, or the other samples.

    Without ``long`` the samples have their features themselves, as the array ``present``.
    """
    need = len(set(features)) if relation == "AND" else 1
    if long is None:
        inside = F.size(F.array_intersect("present", F.array(*map(F.lit, features)))) >= need
        return samples.where(~inside if complement else inside)
    hits = long.where(F.col("feature").isin(*features)).groupBy(*keys).agg(F.countDistinct("feature").alias("_n"))
    members = hits.where(F.col("_n") >= need).select(*keys)
    return samples.join(members, list(keys), "left_anti" if complement else "left_semi")


def subpopulation_rate(subpopulation: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """Outcome rate on train and validation rows; zero if there are none."""
    rows = subpopulation.where(F.col("split").isin("train", "valid"))
    return rows.groupBy(*by).agg(F.avg(F.col("y").cast("double")).alias("rate"), F.count(F.lit(1)).alias("num_samples"))


def recalibration_weight(rates: DataFrame, year_source: int, year_target: int, by: Sequence[str]) -> DataFrame:
    """Target over source rate per sub-population; a source of zero gives 1 or 2."""

    def at(year: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("year") == year, F.col("rate"))), F.lit(0.0))

    both = rates.groupBy(*by).agg(at(year_source).alias("source_rate"), at(year_target).alias("target_rate"))
    source, target = F.col("source_rate"), F.col("target_rate")
    weight = F.when(source != 0, target / source).otherwise(F.when(target == 0, 1.0).otherwise(2.0))
    return both.withColumn("weight", weight)


def recalibrate_scores(scores: DataFrame, memberships: DataFrame, weights: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Multiply a score by the weight of every group it belongs to, then clip to [0, 1]."""
    factors = memberships.join(weights.select("subpopulation", "weight"), "subpopulation")
    compound = factors.groupBy(*keys).agg(F.product("weight").alias("_factor"))
    joined = scores.join(compound, list(keys), "left")
    raised = F.col(score) * F.coalesce("_factor", F.lit(1.0))
    return joined.withColumn("recalibrated", clip(raised, 0, 1)).drop("_factor")


# ------------------------------------------------------------- coefficients


def _two_years(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select("feature", *[F.col(c).alias(f"{c}_{tag}") for c in columns])

    return named(first, "1").join(named(second, "2"), "feature")


def sign_stable_features(first: DataFrame, second: DataFrame) -> DataFrame:
    both = _two_years(first, second, ["coefficient"])
    return both.where(F.col("coefficient_1") * F.col("coefficient_2") >= 0)


def ci_stable_features(first: DataFrame, second: DataFrame) -> DataFrame:
    both = _two_years(first, second, ["ci_low", "ci_high"])
    above = (F.col("ci_low_1") > 0) & (F.col("ci_low_2") > 0)
    below = (F.col("ci_high_1") < 0) & (F.col("ci_high_2") < 0)
    return both.where(above | below)


def significant_sign_changes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Interval wholly above zero in one year and wholly below in the next, or the other way round."""
    both = _two_years(first, second, ["ci_low", "ci_high"])
    falls = (F.col("ci_low_1") > 0) & (F.col("ci_high_2") < 0)
    rises = (F.col("ci_high_1") < 0) & (F.col("ci_low_2") > 0)
    return both.where(falls | rises).withColumn("direction", F.when(falls, "falls").otherwise("rises"))


def drop_lab_value_features(catalog: DataFrame) -> DataFrame:
    """Of the measurement features only 'ordered' stays."""
    return catalog.where((F.col("type") != "lab") | (F.col("variant") == "ordered"))


def chi2_select(long: DataFrame, samples: DataFrame, k: int, by: Sequence[str] = ("year",)) -> DataFrame:
    """Top k features per year by chi-squared of the feature sums per class; ties at the k-th value stay."""
    classes = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_n1")
    )
    counts = long.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("total"), F.sum("y").alias("observed_1"))
    joined = counts.join(classes, list(by))
    share = F.col("_n1").cast("double") / F.col("_n")
    expected1, expected0 = F.col("total") * share, F.col("total") * (1 - share)
    gap = F.col("observed_1") - expected1
    scored = joined.withColumn("chi2", F.round(gap * gap / expected1 + gap * gap / expected0, 9))
    per_value = scored.where("chi2 IS NOT NULL").withColumn("_neg", -F.col("chi2"))
    sizes = per_value.groupBy(*by, "_neg").agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_sums(sizes, order="_neg", sums=["_c"], by=by).where(F.col("_c_below") < k)
    return join_on(per_value, ranks.select(*by, "_neg"), [*by, "_neg"], "left_semi").select(*by, "feature", "total", "chi2")


def min_frequency_both_years(long: DataFrame, years: tuple[int, int], least: int = MIN_YEAR_FREQUENCY) -> DataFrame:
    """Training frequency above the least in both years."""
    rows = long.where((F.col("split") == "train") & F.col("year").isin(*years))

    def count(year: int) -> Column:
        return F.sum(F.when(F.col("year") == year, 1).otherwise(0))

    counts = rows.groupBy("feature").agg(count(years[0]).alias("freq_1"), count(years[1]).alias("freq_2"))
    return counts.where((F.col("freq_1") > least) & (F.col("freq_2") > least))


def _least_common(n: Column, f: Column, g: Column, r: float) -> Column:
    """Least number of common samples with which features of f and g among n samples correlate above r."""
    bound = (r * F.sqrt(f * (n - f)) * F.sqrt(g * (n - g)) + f * g) / n
    return F.greatest(F.floor(bound - 1e-6) + 1, F.lit(1))  # the margin is for rounding: it only lets more pairs through


def feature_prefixes(long: DataFrame, sizes: DataFrame, gap: int, r: float, by: str, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """The rarest samples of each feature: two features that correlate above r share one of them.

    Returns by, keys, feature, n, f, and below, the number of samples of the feature that
    are surely earlier in the order. Samples are ordered by how many features they have, then by
    hash; a feature of f samples whose partners have at least t in common with it needs the
    first f - t + 1. The order is cut into steps, so nothing is sorted: the step in which that many are
    reached belongs to the prefix as a whole.
    """
    # the features of a sample meet once, as one array, which also tells how many they are
    held = long.groupBy(by, *keys).agg(F.collect_list("feature").alias("_held"))
    step = F.size("_held").cast("long") * 64 + F.pmod(F.xxhash64(*keys), F.lit(64))
    # a table of its own, so that the join can split a feature that very many rows have
    stepped = materialize(held.select(by, *keys, F.explode("_held").alias("feature"), step.alias("step")))
    counts = stepped.groupBy(by, "feature", "step").agg(F.count(F.lit(1)).alias("c"))
    along = Window.partitionBy(by, "feature")
    before = along.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("f", F.sum("c").over(along)).withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0)))
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    counts = counts.join(sizes, by).where("f < n")  # what every sample has correlates with nothing
    # the common samples are at most the smaller feature, which bounds a partner's size on both sides
    least = F.greatest(F.lit(1.0), f - gap, F.floor(r * r * f * n / (n - f + r * r * f)))
    most = F.least(n - 1, f + gap, F.ceil(f * n / (f + r * r * (n - f))))
    # between the two sizes the number needed in common is concave, so it is least at one of them
    common = F.least(_least_common(n, f, least, r), _least_common(n, f, most, r))
    steps = materialize(counts.where(F.col("below") <= f - common).select(by, "feature", "step", "n", "f", "below"))
    return stepped.join(steps, [by, "feature", "step"]).drop("step")


def candidate_pairs(prefixes: DataFrame, gap: int, r: float, by: str, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Pairs of features (by name) that share a prefix sample, and whose sizes and places there leave room for a correlation above r."""
    named = [F.col(c).alias(f"{c}_1") for c in ("feature", "f", "below")]
    other = [F.col(c).alias(f"{c}_2") for c in ("feature", "f", "below")]
    met = prefixes.select(by, *keys, "n", *named).join(prefixes.select(by, *keys, *other), [by, *keys])
    n, f1, f2 = (F.col(c).cast("double") for c in ("n", "f_1", "f_2"))
    room = F.least(f1 - F.col("below_1"), f2 - F.col("below_2"))  # had this been the first common sample
    fits = (F.col("feature_1") < F.col("feature_2")) & (F.abs(f1 - f2) <= gap) & (_least_common(n, f1, f2, r) <= room)
    return met.where(fits).select(by, "feature_1", "feature_2", "n", "f_1", "f_2").distinct()


def co_occurrence(long: DataFrame, pairs: DataFrame, by: str, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """n_both, the samples in which both features of a pair occur, for the given pairs (all their columns are kept)."""
    first = long.select(by, *keys, F.col("feature").alias("feature_1"))
    second = long.select(by, *keys, F.col("feature").alias("feature_2"))
    both = pairs.select(by, "feature_1", "feature_2").join(first, [by, "feature_1"]).join(second, [by, "feature_2", *keys])
    counts = both.groupBy(by, "feature_1", "feature_2").agg(F.count(F.lit(1)).alias("n_both"))
    return pairs.join(counts, [by, "feature_1", "feature_2"])


def correlated_pairs(
    long: DataFrame, samples: DataFrame, features: DataFrame | None, gap: int = FREQUENCY_GAP, r: float = CORRELATION, by: str = "year"
) -> DataFrame:
    """Pairs of features with close frequencies and correlation above r in some year; of all features of a stored ``long`` if none are given.

    A set-similarity join: features meet in the rarest samples that they have, pairs whose
    sizes or places there rule the correlation out are dropped, and common samples are counted
    for the pairs left. ``long`` has a sample and feature once. ``feature_2`` is the
    one to leave out: the less frequent of the two, by name on ties.
    """
    sizes = samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    if features is not None:
        long = materialize(long.join(features.select("feature").distinct(), "feature", "left_semi").select(by, *SAMPLE, "feature"))
    pairs = materialize(candidate_pairs(feature_prefixes(long, sizes, gap, r, by), gap, r, by))
    f1, f2, n = (F.col(c).cast("double") for c in ("f_1", "f_2", "n"))
    phi = (n * F.col("n_both") - f1 * f2) / F.sqrt(f1 * (n - f1) * f2 * (n - f2))
    close = co_occurrence(long, pairs, by).withColumn("correlation", phi).where(F.col("correlation") > r)
    swap = f2 > f1
    kept = F.when(swap, F.col("feature_2")).otherwise(F.col("feature_1"))
    left_out = F.when(swap, F.col("feature_1")).otherwise(F.col("feature_2"))
    return close.select(by, kept.alias("feature_1"), left_out.alias("feature_2"), "n_both", "correlation")


def correlated_pairs_prune(features: DataFrame, pairs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Features that remain: one is left out if a partner that is better over all years remains.

    ``frequencies`` has feature and f, its number of samples over all years. Of two
    partners the more frequent one is better, by name on ties: one order for all years,
    so that features whose order flips between years cannot block each other. Decided
    in rounds; each decides at least the best undecided feature.
    """
    sizes = frequencies.groupBy("feature").agg(F.sum("f").alias("f"))

    def named(tag: str) -> DataFrame:
        return sizes.select(F.col("feature").alias(f"feature_{tag}"), F.col("f").alias(f"f{tag}"))

    linked = pairs.select("feature_1", "feature_2").distinct().join(named("1"), "feature_1").join(named("2"), "feature_2")
    first = (F.col("f1") > F.col("f2")) | ((F.col("f1") == F.col("f2")) & (F.col("feature_1") < F.col("feature_2")))
    partner = F.when(first, F.col("feature_1")).otherwise(F.col("feature_2"))
    worse = F.when(first, F.col("feature_2")).otherwise(F.col("feature_1"))
    better = materialize(linked.select(partner.alias("partner"), worse.alias("feature")).distinct())
    undecided = materialize(features.select("feature").distinct())
    open_count = undecided.count()
    remaining = undecided.limit(0)
    while open_count:
        blocked = better.join(undecided.select(F.col("feature").alias("partner")), "partner", "left_semi")
        free = undecided.join(blocked.select("feature"), "feature", "left_anti")
        remaining = materialize(remaining.unionByName(free))
        beaten = better.join(remaining.select(F.col("feature").alias("partner")), "partner", "left_semi").select("feature")
        undecided = materialize(undecided.join(remaining, "feature", "left_anti").join(beaten, "feature", "left_anti"))
        before, open_count = open_count, undecided.count()
        if open_count == before:
            raise ValueError("the order of the features has a cycle")
    return remaining


def _named_coefficients(coefficients: DataFrame) -> DataFrame:
    """Lower-cased concept part of the name; names with few parts stay as they are."""
    parts = F.split("feature", SEPARATOR)
    inner = F.lower(F.array_join(F.slice(parts, F.lit(3), F.size(parts) - 3), SEPARATOR))
    name = F.when(F.size(parts) < 4, F.col("feature")).otherwise(inner)
    return coefficients.withColumn("name", name).withColumn("type", F.when(F.size(parts) >= 2, parts[1]))


def appearing_coefficients(before: DataFrame, after: DataFrame, k: int, stop_words: Sequence[str] = DRUG_STOP_WORDS) -> DataFrame:
    """Top-k positive coefficients of ``after`` with no equal or similar positive feature in ``before``.

    Similar means the same first 30 characters of the name, or for drugs a
    significant word of the name that occurs in the other name.
    """
    top = _named_coefficients(after).orderBy(F.desc("coefficient"), "feature").limit(k)
    top = materialize(top.where(F.col("coefficient") >= LARGE_COEFFICIENT))
    positive = _named_coefficients(before).where(F.col("coefficient") >= SMALL_COEFFICIENT).select("feature", "name")
    fresh = top.join(positive.select("feature"), "feature", "left_anti")
    has_type = F.col("type").isNotNull()
    is_drug = has_type & (F.col("type") == "drug")

    heads = top.where(has_type & ~is_drug).select("feature", F.substring("name", 1, PREFIX_CHARS).alias("head"))
    # every prefix of up to 30 characters of the other names, so that the prefix test is an equality
    longest = F.least(F.length("name"), F.lit(PREFIX_CHARS))
    prefixes = F.transform(F.sequence(F.lit(1), longest), lambda size: F.substr("name", F.lit(1), size))
    prefixes = positive.where(F.length("name") > 0).select(F.explode(prefixes).alias("head")).distinct()
    same_head = heads.join(prefixes, "head", "left_semi").select("feature")

    words = top.where(is_drug).select("feature", F.explode(F.split("name", " ")).alias("word"))
    stop = F.lit(False)
    for w in stop_words:
        stop = stop | F.col("word").contains(w)
    words = materialize(words.where((F.length("word") > 3) & ~stop).distinct())
    # at most a few words per row of the top-k list: one scan of the other names looks for all of them
    listed = F.array(*[F.lit(row["word"]) for row in words.select("word").distinct().collect()]).cast("array<string>")
    found = F.filter(listed, lambda w: F.col("name").contains(w))
    same_word = words.join(positive.select(F.explode(found).alias("word")).distinct(), "word", "left_semi").select("feature")
    similar = same_head.unionByName(same_word).distinct()
    return fresh.join(similar, "feature", "left_anti").select("feature", "name", "coefficient")


# ------------------------------------------------------------- distributions


def nll(score: Column, y: Column) -> Column:
    """Negative log-likelihood of one prediction."""
    return -F.when(y == 1, F.log(score)).otherwise(F.log(1 - score))


def nll_difference_distribution(
    scores: DataFrame, first: str, second: str, bins: int = 40, limit: float = 0.4, by: Sequence[str] = ("year",)
) -> DataFrame:
    """Histogram of the difference of two models' negative log-likelihoods per sample."""
    floor = 1e-9

    def safe(c: str) -> Column:
        return clip(F.col(c), floor, 1 - floor)

    gap = F.round(nll(safe(first), F.col("y")) - nll(safe(second), F.col("y")), 9)
    return scores.groupBy(*by, bin_index(gap, -limit, limit, bins).alias("bin")).agg(F.count(F.lit(1)).alias("num_samples"))


def additive_scores(samples: DataFrame, long: DataFrame, coefficients: DataFrame, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Score of every sample by the coefficients of its own year and of the year before: the sum over its features.

    Columns keys, y, model_year, eval_year and score, in millionths, so that the order of additions does not matter.
    """
    units = coefficients.select("feature", F.col("year").alias("model_year"), F.round(F.col("coefficient") * 1e6).cast("long").alias("_units"))
    models = units.select("model_year").distinct()
    lagged = F.explode(F.array(F.col("year"), F.col("year") - 1)).alias("model_year")
    rows = samples.select(*keys, "y", F.col("year").alias("eval_year"), lagged).join(models, "model_year", "left_semi")
    points = long.select(*keys, "feature").join(units, "feature").groupBy(*keys, "model_year").agg(F.sum("_units").alias("score"))
    return rows.join(points, [*keys, "model_year"], "left").withColumn("score", F.coalesce("score", F.lit(0)))


def feature_window_comparison(short: DataFrame, long: DataFrame) -> DataFrame:
    """AUC gain of the current over the previous year's model, for two feature windows side by side."""

    def gain(metrics: DataFrame, name: str) -> DataFrame:
        own = metrics.where("model_year = eval_year").select("eval_year", F.col("auc").alias("_own"))
        old = metrics.where("model_year = eval_year - 1").select("eval_year", F.col("auc").alias("_old"))
        return own.join(old, "eval_year").select("eval_year", (F.col("_own") - F.col("_old")).alias(name))

    return gain(short, "gain_short").join(gain(long, "gain_long"), "eval_year")


def auc_series_with_ci(scores: DataFrame, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Per year: AUC of both models with bootstrap errors, and two differences with their 90 % intervals.

    ``actual_diff`` compares the models on the year; ``baseline_diff`` the year before's
    model on its own year and on this one, null where the year before has no rows.
    """
    keys = [*by, "year"]
    entries = materialize(rs.two_models(scores, keys))
    replicates = materialize(rs.bootstrap_aucs(entries, keys, n, seed))
    errors = replicates.groupBy(*keys).agg(F.stddev_pop("auc_1").alias("se_curr"), F.stddev_pop("auc_2").alias("se_prev"))
    interval = rs.pivotal_ci(replicates, rs.actual_difference(entries, keys), keys)
    renamed = interval.withColumnRenamed("actual_1", "auc_curr").withColumnRenamed("actual_2", "auc_prev")
    years = scores.select(*keys).distinct()
    paired = join_on(years, years.withColumn("year", F.col("year") + 1), keys, "left_semi")
    across = materialize(join_on(hy.year_entries(scores, by, True), paired, keys, "left_semi"))
    baseline = rs.pivotal_ci(rs.bootstrap_aucs(across, keys, n, seed), rs.actual_difference(across, keys), keys)
    names = {"actual_diff": "baseline_diff", "ci_low": "baseline_ci_low", "ci_high": "baseline_ci_high"}
    baseline = baseline.select(*keys, *[F.col(c).alias(name) for c, name in names.items()])
    return join_on(join_on(renamed.drop("above_zero"), errors, keys), baseline, keys, "left")


