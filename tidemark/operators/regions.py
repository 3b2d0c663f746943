"""Sub-population (region) discovery data, region indicators, and the check inside a region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import hash32, ratio
from tidemark.functions.ranking import exact_percentiles, hash_rank, join_on
from tidemark.operators import hypothesis as hy
from tidemark.operators import resampling as rs
from tidemark.operators.metrics import auc, eval_predictions
from tidemark.operators.models import Leaf, leaves_text
from tidemark.session import materialize

# Least rows per label in test and in train + valid, and the region's share of the samples.
MIN_LABEL_ROWS = 10
VALID_SHARE = 0.25
MIN_REGION_SHARE = 0.001
MAX_REGION_SHARE = 0.75


# ------------------------------------------------------------- error labels


def calibration_error_label(scores: DataFrame) -> DataFrame:
    """1 where the previous model is farther from the outcome than the current one."""
    worse = F.abs(F.col("s_prev") - F.col("y")) > F.abs(F.col("s_curr") - F.col("y"))
    return scores.withColumn("label", worse.cast("int"))


def _right(score: str, threshold: float) -> Column:
    return ((F.col(score) >= threshold).cast("int") == F.col("y")).cast("int")


def threshold_error_label(scores: DataFrame, threshold_prev: float, threshold_curr: float) -> DataFrame:
    """Among samples the current model gets right: 1 where the previous model is wrong."""
    judged = scores.withColumn("prev_right", _right("s_prev", threshold_prev)).withColumn(
        "curr_right", _right("s_curr", threshold_curr)
    )
    return judged.where("curr_right = 1").withColumn("label", 1 - F.col("prev_right"))


def threshold_error_counts(
    scores: DataFrame, threshold_prev: float, threshold_curr: float, by: Sequence[str]
) -> DataFrame:
    """Four-way table of right and wrong of both models, with shares of the group."""
    judged = scores.withColumn("prev_right", _right("s_prev", threshold_prev)).withColumn(
        "curr_right", _right("s_curr", threshold_curr)
    )
    cells = judged.groupBy(*by, "prev_right", "curr_right").agg(F.count(F.lit(1)).alias("num_samples"))
    total = F.sum("num_samples").over(Window.partitionBy(*by))
    return cells.withColumn("share", F.col("num_samples") / total)


def error_dataset(labelled: DataFrame, by: Sequence[str], min_rows: int = MIN_LABEL_ROWS) -> DataFrame:
    """Groups with enough test rows of both labels, and four times as many to learn from."""
    is_test = F.col("split") == "test"

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    enough = labelled.groupBy(*by).agg(
        count(is_test & (F.col("label") == 1)).alias("_t1"),
        count(is_test & (F.col("label") == 0)).alias("_t0"),
        count(~is_test & (F.col("label") == 1)).alias("_l1"),
        count(~is_test & (F.col("label") == 0)).alias("_l0"),
    )
    kept = enough.where((F.least("_t0", "_t1") >= min_rows) & (F.least("_l0", "_l1") >= 4 * min_rows)).select(*by)
    return labelled.join(kept, list(by), "left_semi")


def label_stratified_resplit(
    labelled: DataFrame, ids: Sequence[str], by: Sequence[str], share: float = VALID_SHARE, seed: int = 0
) -> DataFrame:
    """Pool train and valid, then hold out the same share of each label by hash rank."""
    pool = labelled.where(F.col("split").isin("train", "valid"))
    ranked = hash_rank(pool, ids, by=[*by, "label"], seed=seed)
    valid = F.col("rank") <= F.floor(F.col("group_size") * F.lit(share))
    return ranked.withColumn("split", F.when(valid, "valid").otherwise("train")).drop("rank", "group_size")


def timepoint_dataset(samples: DataFrame, year: int, share: float = VALID_SHARE, seed: int = 0) -> DataFrame:
    """Label 0 for the previous and 1 for the current year; a random share of the pool is held out."""
    both = samples.where(F.col("year").isin(year - 1, year))
    held = hash32(seed, "sample_id") < F.lit(int(share * 2**32))
    split = F.when(F.col("split") == "test", "test").when(held, "valid").otherwise("train")
    return both.withColumn("label", (F.col("year") == year).cast("int")).withColumn("split", split)


# ------------------------------------------------------------------ regions


def model_region(samples: DataFrame, score: str, threshold: float = 0.5, soft: bool = False) -> DataFrame:
    """Indicator of a region model, or its probability."""
    value = F.col(score) if soft else (F.col(score) >= threshold).cast("int")
    return samples.withColumn("region", value)


def single_feature_region(samples: DataFrame, present: DataFrame, keys: Sequence[str], sign: int) -> DataFrame:
    """Samples with the feature (positive sign), or without it (negative sign)."""
    flagged = samples.join(present.select(*keys).distinct().withColumn("_has", F.lit(1)), list(keys), "left")
    has = F.coalesce("_has", F.lit(0))
    return flagged.withColumn("region", has if sign > 0 else 1 - has).drop("_has")


def age_region(samples: DataFrame, bound: float, sign: int) -> DataFrame:
    age = F.col("age")
    return samples.withColumn("region", (age >= bound if sign > 0 else age <= bound).cast("int"))


def top_features(
    coefficients: DataFrame, by: Sequence[str] = (), k: int = 5, skip: Sequence[str] = ("Y",), year: str = "year"
) -> DataFrame:
    """Per group and year those of the k features with the largest absolute non-zero coefficient that make a new region.

    Skipped names keep their place among the k. A region, a feature with the sign of its
    coefficient, is new in the first year that has it among its k: what a later year
    finds again was either used or found in the year before, so the first year decides.
    """
    order = Window.partitionBy(*by, year).orderBy(F.desc(F.abs("coefficient")), "feature")
    placed = coefficients.where(F.col("coefficient") != 0).withColumn("position", F.row_number().over(order))
    found = placed.where((F.col("position") <= k) & ~F.col("feature").isin(*skip))
    again = Window.partitionBy(*by, "feature", F.col("coefficient") > 0)
    return found.withColumn("_first", F.min(year).over(again)).where(F.col("_first") == F.col(year)).drop("_first")


def age_bound(samples: DataFrame, sign: int, by: Sequence[str] = ()) -> DataFrame:
    """80th percentile rounded up for a positive, 20th rounded down for a negative coefficient."""
    q = exact_percentiles(samples, "age", [0.8 if sign > 0 else 0.2], by=by)
    value = F.ceil("percentile") if sign > 0 else F.floor("percentile")
    return q.select(*by, value.cast("double").alias("age_bound"))


def region_catalog(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per single-feature region and one for its complement, with readable labels."""
    named = features.join(catalog.select("feature", "label", "negated_label", "file_key"), "feature")
    positive = F.col("coefficient") > 0

    def side(inside: bool) -> Column:
        with_feature = positive if inside else ~positive
        return F.struct(
            F.lit(1 if inside else 0).alias("inside"),
            F.when(with_feature, F.col("label")).otherwise(F.col("negated_label")).alias("region_label"),
            F.when(with_feature, "present").otherwise("absent").alias("rule"),
        )

    rows = named.withColumn("_r", F.explode(F.array(side(True), side(False))))
    return rows.select("year", "feature", "file_key", "_r.inside", "_r.region_label", "_r.rule")


def leaf_region_catalog(session: SparkSession, trees: dict[int, Sequence[Leaf]], names: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Both sides of the region of each year's tree: the leaves at or above the threshold, and all others.

    year, inside, region_label, file_key, leaves (their numbers) and rule (their paths).
    """
    rows = []
    for year, leaves in trees.items():
        for inside in (1, 0):
            side = [leaf for leaf in leaves if (leaf.probability >= threshold) == bool(inside)]
            word = "in" if inside else "not in"
            key = f"pred_{word.replace(' ', '_')}_{year}"
            rows.append((year, inside, f"predicted {word} {year}", key, [leaf.number for leaf in side], leaves_text(side, names)))
    schema = "year int, inside int, region_label string, file_key string, leaves array<int>, rule string"
    return session.createDataFrame(rows, schema)


def age_region_catalog(bounds: DataFrame) -> DataFrame:
    """Both sides of each age region, from rows with coefficient and age_bound: label, file key and rule."""
    bound = F.col("age_bound").cast("bigint").cast("string")
    upward = F.col("coefficient") > 0

    def side(inside: bool) -> Column:
        sign = F.when(upward, ">=" if inside else "<").otherwise("<=" if inside else ">")
        word = F.when(upward, "atleast" if inside else "below").otherwise("atmost" if inside else "above")
        return F.struct(
            F.lit(1 if inside else 0).alias("inside"),
            F.concat_ws(" ", F.lit("age"), sign, bound).alias("region_label"),
            F.concat_ws("_", F.lit("age"), word, bound).alias("file_key"),
        )

    rows = bounds.withColumn("_r", F.explode(F.array(side(True), side(False))))
    return rows.select(*[c for c in bounds.columns], "_r.inside", "_r.region_label", "_r.file_key")


# --------------------------------------------------------------- statistics


def region_metrics(scores: DataFrame, by: Sequence[str], threshold: float = 0.5, soft: bool = False) -> DataFrame:
    """Metrics inside and outside a region; a soft region weighs samples by w inside and 1 - w outside."""
    if not soft:
        return eval_predictions(scores, "score", threshold, [*by, "region"])
    parts = F.array(
        F.struct(F.lit(1).alias("region"), F.col("region").alias("weight")),
        F.struct(F.lit(0).alias("region"), (1 - F.col("region")).alias("weight")),
    )
    sides = scores.withColumn("_s", F.explode(parts)).drop("region").select("*", "_s.region", "_s.weight").drop("_s")
    return eval_predictions(sides, "score", threshold, [*by, "region"], "weight")


def region_statistics(labelled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Size, share of samples, errors, and share of all errors (1 if there are none)."""
    region, label = F.col("region"), F.col("label")
    stats = labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.sum(region).alias("region_size"),
        F.sum(label).alias("num_errors"),
        F.sum(region * label).alias("region_errors"),
    )
    return stats.withColumn("region_share", ratio(F.col("region_size"), F.col("num_samples"))).withColumn(
        "error_share", F.coalesce(ratio(F.col("region_errors"), F.col("num_errors")), F.lit(1.0))
    )


def region_cohort_rate(samples: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """Cohort size and outcome rate inside the region and overall; soft regions are rounded."""
    inside = F.round("region").cast("int")
    y = F.col("y")
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg(y.cast("double")).alias("rate"),
        F.sum(inside).alias("region_size"),
        ratio(F.sum(inside * y), F.sum(inside)).alias("region_rate"),
    )


def interpretable_leaves(
    leaves: DataFrame, max_depth: int, min_size: int = 20, min_share: float = 0.75, unwanted: str = "No matching concept"
) -> DataFrame:
    """Shallow, large, mostly miscalibrated leaves without unmapped features, with the path as text."""
    readable = ~F.exists("path", lambda step: step.contains(unwanted))
    share = ratio(F.col("valid_positive"), F.col("valid_size"))
    kept = leaves.where(
        (F.size("path") <= max_depth) & (F.col("valid_size") > min_size) & (share > min_share) & readable
    )
    return kept.withColumn("rule", F.concat_ws(" AND ", "path")).withColumn("share", share)


# -------------------------------------------------------------- region check


def _region_facts(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and year: persons by outcome inside and outside, sizes, and AUCs overall and inside."""
    keys = [*by, "year"]
    persons = scores.where(F.col("split").isin("valid", "test")).groupBy(*keys, "split", "region", "person_id").agg(
        F.max("y").alias("_pos"), F.max(1 - F.col("y")).alias("_neg"), F.count(F.lit(1)).alias("_rows")
    )

    def total(split: str, region: int, column: str) -> Column:
        at = (F.col("split") == split) & (F.col("region") == region)
        return F.sum(F.when(at, F.col(column)).otherwise(0))

    sides = {"in": 1, "out": 0}
    counts = [
        total(s, r, f"_{o}").alias(f"{s}_{side}_{o}") for s in ("valid", "test") for side, r in sides.items() for o in ("pos", "neg")
    ]
    sizes = [total("valid", r, "_rows").alias(f"valid_{side}_rows") for side, r in sides.items()]
    facts = persons.groupBy(*keys).agg(*counts, *sizes)
    valid = scores.where("split = 'valid'")
    facts = join_on(facts, auc(valid, "s_curr", keys).withColumnRenamed("auc", "valid_auc"), keys, "left")
    inside = auc(valid.where("region = 1"), "s_curr", keys).withColumnRenamed("auc", "valid_in_auc")
    return join_on(facts, inside, keys, "left")


def region_nonstationarity_check(
    scores: DataFrame,
    by: Sequence[str] = (),
    n: int = rs.REPLICATES,
    seed: int = 0,
    min_valid: int = hy.MIN_VALID_PERSONS,
    min_test: int = hy.MIN_TEST_PERSONS,
    least_auc: float = hy.MIN_AUC,
    baseline: bool = False,
) -> DataFrame:
    """Yearly check inside a region (``region`` 0/1); the shift must not show outside it.

    As in the overall check, each step runs only on what passed the step before.
    An undefined AUC fails its screen.
    """
    keys = [*by, "year"]
    facts = materialize(_region_facts(scores, by))
    pairs = join_on(hy.shifted(facts, by, "curr", 0), hy.shifted(facts, by, "prev", 1), keys)
    size = F.col("curr_valid_in_rows")
    total = size + F.col("curr_valid_out_rows")
    rules = [((size >= MIN_REGION_SHARE * total) & (size <= MAX_REGION_SHARE * total), "region size")]
    for when, year in (("prev", "previous"), ("curr", "current")):
        for side, place in (("in", "inside"), ("out", "outside")):
            for o, word in (("pos", "with"), ("neg", "without")):
                enough = F.col(f"{when}_valid_{side}_{o}") >= min_valid
                rules.append((enough, f"few validation persons {word} outcome {place} in {year} year"))
    rules.append((F.col("prev_valid_auc") >= least_auc, "low AUC of previous model"))
    if baseline:
        rules.append((F.col("prev_valid_in_auc") >= least_auc, "low AUC of previous model inside"))
    else:
        rules.append((F.col("curr_valid_auc") >= least_auc, "low AUC of current model"))
        rules.append((F.col("curr_valid_in_auc") >= least_auc, "low AUC of current model inside"))
    screened = materialize(pairs.withColumn("_screen", hy.first_reason(rules)))

    inner, outer = scores.where("region = 1"), scores.where("region = 0")
    ci_in = hy.bootstrap_screen(inner, screened.where("_screen IS NULL"), by, n, seed, baseline)
    ci_in = materialize(ci_in.select(*keys, "ci_low", F.col("above_zero").alias("_above_in")))
    ci_out = hy.bootstrap_screen(outer, ci_in.where("_above_in"), by, n, seed, baseline)
    passed = join_on(screened, ci_in, keys, "left")
    passed = materialize(join_on(passed, ci_out.select(*keys, F.col("above_zero").alias("_above_out")), keys, "left"))

    years = [("curr", "current")] + ([("prev", "previous")] if baseline else [])
    enough = [
        (F.col(f"{when}_test_in_{o}") >= min_test, f"few test persons {word} outcome inside in {year} year")
        for when, year in years
        for o, word in (("pos", "with"), ("neg", "without"))
    ]
    status = (
        F.when(F.col("_screen").isNotNull(), F.col("_screen"))
        .when(~F.coalesce("_above_in", F.lit(False)), "interval inside not above 0")
        .when(F.coalesce("_above_out", F.lit(False)), "interval outside above 0")
        .otherwise(F.coalesce(hy.first_reason(enough), F.lit("tested")))
    )
    passed = passed.withColumn("status", status)
    p = hy.test_p_values(inner, passed.where("status = 'tested'"), by, n, seed, baseline)
    joined = join_on(passed, p.select(*keys, F.col("p_value").alias("_p")), keys, "left")
    few = F.col("status").startswith("few test")
    return joined.select(*keys, "status", "ci_low", F.when(few, 1.0).otherwise(F.col("_p")).alias("p_value"))
