"""Exact evaluation metrics from counts per distinct score.

Samples are first added up per distinct score (with partial aggregation before
the shuffle); every metric is then a running sum over distinct scores, which
``running_sums`` cuts into ranges when there are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import ratio
from tidemark.functions.ranking import join_on, running_sums

THRESHOLD = 0.5
MIN_OUTCOMES = 10


def score_steps(
    scores: DataFrame, score: str = "score", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Per distinct score: positive and negative weight, the same below it, and the totals."""
    w = F.lit(1) if weight is None else F.col(weight)
    counts = scores.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg")
    )
    return running_sums(counts, order="score", sums=["pos", "neg"], by=by)


def _precision() -> Column:
    above = F.col("pos_total") - F.col("pos_below")
    return ratio(above, above + F.col("neg_total") - F.col("neg_below"))


def _auc() -> Column:
    half = F.col("neg").cast("double") / F.lit(2).cast("double")
    concordant = F.sum(F.col("pos") * (F.col("neg_below") + half))
    return ratio(concordant, F.sum("pos") * F.sum("neg")).alias("auc")


def _average_precision() -> Column:
    return ratio(F.sum(F.col("pos") * _precision()), F.sum("pos")).alias("average_precision")


def _at_threshold(threshold: float) -> dict[str, Column]:
    above = F.col("score") >= threshold
    tp = F.sum(F.when(above, F.col("pos")).otherwise(0))
    fp = F.sum(F.when(above, F.col("neg")).otherwise(0))
    precision = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(ratio(tp, F.sum("pos")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def _brier() -> Column:
    s = F.col("score")
    loss = F.sum(F.col("pos") * (s - 1) * (s - 1) + F.col("neg") * s * s)
    return ratio(loss, F.sum("pos") + F.sum("neg")).alias("brier")


def auc(scores: DataFrame, score: str = "score", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return score_steps(scores, score, by, weight).groupBy(*by).agg(_auc())


def average_precision(
    scores: DataFrame, score: str = "score", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    return score_steps(scores, score, by, weight).groupBy(*by).agg(_average_precision())


def _counted(scores: DataFrame, score: str, by: Sequence[str], weight: str | None) -> DataFrame:
    w = F.lit(1) if weight is None else F.col(weight)
    return scores.select(
        *by, F.col(score).alias("score"), (w * F.col("y")).alias("pos"), (w * (1 - F.col("y"))).alias("neg")
    )


def threshold_metrics(
    scores: DataFrame,
    score: str = "score",
    threshold: float = THRESHOLD,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Precision, recall and F1 at score >= threshold; zero where undefined."""
    metrics = [c.alias(n) for n, c in _at_threshold(threshold).items()]
    return _counted(scores, score, by, weight).groupBy(*by).agg(*metrics)


def brier(scores: DataFrame, score: str = "score", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return _counted(scores, score, by, weight).groupBy(*by).agg(_brier())


def eval_predictions(
    scores: DataFrame,
    score: str = "score",
    threshold: float = THRESHOLD,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """All metrics as one row per group, from one table of distinct scores."""
    at = [c.alias(n) for n, c in _at_threshold(threshold).items()]
    sizes = [F.sum("pos").alias("num_positive"), F.sum("neg").alias("num_negative")]
    return score_steps(scores, score, by, weight).groupBy(*by).agg(*sizes, _auc(), _average_precision(), *at, _brier())


def miss_and_false_alarm_rate(
    scores: DataFrame, score: str = "score", threshold: float = THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """Percent of positives missed and of predicted positives that are false; null if there are none."""
    positive, predicted = F.col("y") == 1, F.col(score) >= threshold
    missed = F.sum((positive & ~predicted).cast("int"))
    false = F.sum((~positive & predicted).cast("int"))
    return scores.groupBy(*by).agg(
        (F.lit(100.0) * ratio(missed, F.sum("y"))).alias("percent_missed"),
        (F.lit(100.0) * ratio(false, F.sum(predicted.cast("int")))).alias("percent_false"),
    )


def precision_recall_curve(
    scores: DataFrame, score: str = "score", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Precision and recall at every distinct score taken as threshold."""
    steps = score_steps(scores, score, by, weight)
    recall = ratio(F.col("pos_total") - F.col("pos_below"), F.col("pos_total"))
    return steps.select(*by, F.col("score").alias("threshold"), _precision().alias("precision"), recall.alias("recall"))


def best_threshold(curve: DataFrame, criterion: str, value: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Threshold by best F1, or by a bound on the false discovery ('fpr') or miss rate ('fnr').

    f1: smallest threshold with the highest F1. fpr: smallest threshold with
    precision >= 1 - value, else 1. fnr: largest threshold with recall >= 1 - value, else 0.
    """
    precision, recall, threshold = F.col("precision"), F.col("recall"), F.col("threshold")
    if criterion == "f1":
        f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(-1.0))
        best = -F.max(F.struct(f1.alias("f1"), (-threshold).alias("t")))["t"]
    elif criterion == "fpr":
        best = F.coalesce(F.min(F.when(precision >= F.lit(1 - value), threshold)), F.lit(1.0))
    elif criterion == "fnr":
        best = F.coalesce(F.max(F.when(recall >= F.lit(1 - value), threshold)), F.lit(0.0))
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    return curve.groupBy(*by).agg(best.alias("threshold"))


def model_scores(scores: DataFrame) -> DataFrame:
    """One row per sample and model: the previous and the current year's model on the sample's year."""
    models = F.array(
        F.struct((F.col("year") - 1).alias("model_year"), F.col("s_prev").alias("score")),
        F.struct(F.col("year").alias("model_year"), F.col("s_curr").alias("score")),
    )
    return (
        scores.withColumn("_m", F.explode(models))
        .withColumn("eval_year", F.col("year"))
        .select("sample_id", "person_id", "split", "y", "eval_year", "_m.model_year", "_m.score")
    )


def cross_year_evaluation(
    scores: DataFrame,
    min_outcomes: int = MIN_OUTCOMES,
    by: Sequence[str] = (),
    threshold: float = THRESHOLD,
    weight: str | None = None,
) -> DataFrame:
    """Every model on its own and later years; pairs with too few of either outcome are skipped."""
    keys = [*by, "model_year", "eval_year"]
    later = scores.where(F.col("eval_year") >= F.col("model_year"))
    evaluated = eval_predictions(later, "score", threshold, keys, weight)
    return evaluated.where((F.col("num_positive") >= min_outcomes) & (F.col("num_negative") >= min_outcomes))


def select_by_validation(candidates: DataFrame, metric: str, position: str, by: Sequence[str] = ()) -> DataFrame:
    """The candidate with the highest metric; the earliest one wins ties."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(position)).alias("p")))
    picked = candidates.groupBy(*by).agg(best.alias("best"))
    return picked.select(*by, (-F.col("best.p")).alias(position), F.col("best.m").alias(metric))


def normalized_ranks(scores: DataFrame, score: str, by: Sequence[str] = (), name: str = "normalized_rank") -> DataFrame:
    """Mid-rank / n of each sample's score within its group."""
    counts = scores.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"))
    run = running_sums(counts, order=score, sums=["_n"], by=by)
    middle = F.col("_n_below") + (F.col("_n") + 1) / F.lit(2).cast("double")
    ranked = run.select(*by, score, (middle / F.col("_n_total")).alias(name))
    return join_on(scores, ranked, [*by, score])


def lag_by_year(metrics: DataFrame, value: str, by: Sequence[str]) -> Column:
    return F.lag(value).over(Window.partitionBy(*by).orderBy("eval_year"))
