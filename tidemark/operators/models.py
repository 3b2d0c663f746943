"""Models on Spark ML, with grids chosen by exact validation AUC.

Training data hold ``features`` (vector), ``y`` and optionally ``weight``. A grid
is fitted on data written once; all candidates are scored in one pass and ranked
by the exact AUC, the earliest candidate winning ties.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import auc, select_by_validation
from tidemark.operators.splits import balanced_weights
from tidemark.session import materialize

# The hyperparameter grids.
CS = (10, 1, 0.1, 0.01, 0.001, 0.0001, 0.00001)
TREE_LEAVES = (10, 25, 100)
FOREST_TREES = (10, 25, 100)
FOREST_LEAVES = (10, 25, 100)
SCAN_FOREST_TREES = (10, 100, 1000)
SCAN_FOREST_LEAVES = (100, 1000, 10000)
BOOST_TREES = (10, 25, 100)
BOOST_DEPTHS = (3, 6, 10)
SCAN_BOOST_TREES = (5, 10, 50)
MAX_DEPTH = 30  # so deep that rows keep their node between levels: else each level sends all trees and walks them from the root
MAX_ITERATIONS = 1000
PARALLEL_FITS = 4
PARALLEL_YEARS = 8  # all years of the library: most of the time of a fit is the wait for its next small job
ROWS_PER_TASK = 50_000
Z95 = 1.96
MAX_INFERENTIAL = 4096  # what the least-squares solver behind the standard errors takes


def score(model: Model, samples: DataFrame, name: str = "score") -> DataFrame:
    """P(y = 1) of every sample."""
    scored = model.transform(samples).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """The written table in no more tasks than its rows need: an iterative fit runs thousands of jobs, each of which starts them all."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def class_weighted(train: DataFrame, weight_col: str | None = None) -> tuple[DataFrame, float]:
    """Balanced class weights, times the sample weight if there is one, and their sum."""
    weighted = balanced_weights(train.drop("weight") if weight_col is None else train.withColumnRenamed(weight_col, "_given"))
    if weight_col is not None:
        weighted = weighted.withColumn("weight", F.col("weight") * F.col("_given")).drop("_given")
    weighted = materialize(weighted)
    total = weighted.agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows")).first()
    return in_few_tasks(weighted, total["rows"]), total["weight"]


def best_of(models: Sequence[Model], valid: DataFrame, weight_col: str | None = None) -> tuple[Model, int, float]:
    """Score all models in one pass and return the best with its position and AUC."""
    columns = ["y"] + ([weight_col] if weight_col else [])
    scored = valid.select("features", *columns)
    for i, model in enumerate(models):
        scored = score(model, scored, f"_s{i}")
    scores = F.array(*[F.col(f"_s{i}") for i in range(len(models))])
    stacked = scored.select(*columns, F.posexplode(scores).alias("candidate", "score"))
    best = select_by_validation(auc(stacked, "score", ["candidate"], weight_col), "auc", "candidate").first()
    return models[best["candidate"]], best["candidate"], best["auc"]


def choose(
    estimators: Sequence[Estimator], train: DataFrame, valid: DataFrame, weight_col: str | None = None
) -> tuple[Model, int, float]:
    """Fit all candidates and return the best with its position and AUC."""
    with ThreadPool(min(PARALLEL_FITS, len(estimators))) as pool:
        return best_of(pool.map(lambda e: e.fit(train), estimators), valid, weight_col)


def train_logreg(
    train: DataFrame,
    valid: DataFrame,
    penalty: str = "l2",
    cs: Sequence[float] = CS,
    weight_col: str | None = None,
) -> tuple[Model, int, float]:
    """Balanced logistic regression; C is the inverse strength on the summed loss."""
    if penalty not in ("l1", "l2"):
        raise ValueError(f"unknown penalty {penalty!r}")
    weighted, total = class_weighted(train, weight_col)
    estimators = [
        LogisticRegression(
            labelCol="y",
            weightCol="weight",
            regParam=1.0 / (c * total),
            elasticNetParam=1.0 if penalty == "l1" else 0.0,
            standardization=False,
            maxIter=MAX_ITERATIONS,
        )
        for c in cs
    ]
    return choose(estimators, weighted, valid, weight_col)


def train_decision_tree(
    train: DataFrame,
    valid: DataFrame,
    leaves: Sequence[int] = TREE_LEAVES,
    weight_col: str | None = None,
    max_depth: int = MAX_DEPTH,
) -> tuple[Model, int, float]:
    weighted, _ = class_weighted(train, weight_col)
    estimators = [
        DecisionTreeClassifier(
            labelCol="y", weightCol="weight", impurity="gini", minInstancesPerNode=n, maxDepth=max_depth, seed=0, cacheNodeIds=True
        )
        for n in leaves
    ]
    return choose(estimators, weighted, valid, weight_col)


def train_forest(
    train: DataFrame,
    valid: DataFrame,
    trees: Sequence[int] = FOREST_TREES,
    leaves: Sequence[int] = FOREST_LEAVES,
    weight_col: str | None = None,
    max_depth: int = MAX_DEPTH,
) -> tuple[Model, int, float]:
    weighted, _ = class_weighted(train, weight_col)
    estimators = [
        RandomForestClassifier(
            labelCol="y", weightCol="weight", numTrees=t, minInstancesPerNode=n, maxDepth=max_depth, seed=0, cacheNodeIds=True
        )
        for t in trees
        for n in leaves
    ]
    return choose(estimators, weighted, valid, weight_col)


def train_boosted(
    train: DataFrame,
    valid: DataFrame,
    trees: Sequence[int] = BOOST_TREES,
    depths: Sequence[int] = BOOST_DEPTHS,
    weight_col: str | None = None,
) -> tuple[Model, int, float]:
    """Boosted trees with positives weighted by negatives over positives, times the sample weight if there is one."""
    given = F.lit(1.0) if weight_col is None else F.col(weight_col)
    sums = F.sum((1 - F.col("y")) * given).alias("n0"), F.sum(F.col("y") * given).alias("n1"), F.count(F.lit(1)).alias("rows")
    sizes = train.agg(*sums).first()
    weight = F.when(F.col("y") == 1, sizes["n0"] / sizes["n1"]).otherwise(1.0)
    weighted = in_few_tasks(materialize(train.withColumn("_weight", weight * given)), sizes["rows"])
    longest = [GBTClassifier(labelCol="y", weightCol="_weight", maxIter=max(trees), maxDepth=d, seed=0, maxMemoryInMB=512) for d in depths]
    with ThreadPool(len(longest)) as pool:
        fitted = pool.map(lambda e: e.fit(weighted), longest)
    return best_of([first_trees(model, t) for t in trees for model in fitted], valid, weight_col)


def first_trees(model: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The model of the first trees: what a fit of so many iterations with the same seed gives, since boosting only appends."""
    jvm = model._java_obj
    gateway = SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for i, (tree, weight) in enumerate(zip(jvm.trees()[:count], jvm.treeWeights()[:count])):
        trees[i], weights[i] = tree, weight
    made = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{count}", trees, weights)
    return GBTClassificationModel(made)


def imputation_models(
    wide: DataFrame, present: DataFrame, important: Sequence[str], keys: Sequence[str] = ("person_id", "end_date"), fit: Callable = train_logreg
) -> dict[str, Model]:
    """A model per important feature that predicts it from other vectors (``features`` of ``wide``), fitted side by side.

    ``present`` has a row per sample and feature. ``important`` is a short list of names.
    """

    def one(feature: str) -> Model:
        has = present.where(F.col("feature") == feature).select(*keys).distinct().withColumn("_has", F.lit(1))
        labelled = materialize(wide.drop("y").join(has, list(keys), "left").withColumn("y", F.coalesce("_has", F.lit(0))).drop("_has"))
        return fit(labelled.where("split = 'train'"), labelled.where("split = 'valid'"))[0]

    with ThreadPool(PARALLEL_FITS) as pool:
        return dict(zip(important, pool.map(one, important)))


def imputed_features(
    wide: DataFrame, present: DataFrame, models: dict[str, Model], threshold: float = 0.5, keys: Sequence[str] = ("person_id", "end_date")
) -> DataFrame:
    """keys and feature, once each: the present features, and the important ones that their models predict in one pass over the samples."""
    scored = wide
    for i, model in enumerate(models.values()):
        scored = score(model, scored, f"_p{i}")
    flags = [F.when(F.col(f"_p{i}") >= threshold, F.lit(name)) for i, name in enumerate(models)]
    predicted = scored.select(*keys, F.explode(F.array_compact(F.array(*flags))).alias("feature"))
    return present.select(*keys, "feature").unionByName(predicted).distinct()


def side_by_side(build: Callable, years: Sequence) -> list:
    """``build(year)`` of every year, in the given order; the years are independent and run at the same time."""
    with ThreadPool(max(1, min(PARALLEL_YEARS, len(years)))) as pool:
        return pool.map(build, years)


def models_per_year(
    samples: DataFrame, years: Iterable[int], fit: Callable[[DataFrame, DataFrame], tuple], min_outcomes: int = 10
) -> dict[int, Model]:
    """One model per year; a year with too few validation rows of either outcome gets none."""
    counts = samples.where("split = 'valid'").groupBy("year").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    enough = {r["year"] for r in counts.collect() if min(r["n0"], r["n1"]) >= min_outcomes}

    def one(year: int) -> Model:
        rows = samples.where(F.col("year") == year)
        return fit(rows.where("split = 'train'"), rows.where("split = 'valid'"))[0]

    fitted = [year for year in years if year in enough]
    return dict(zip(fitted, side_by_side(one, fitted)))


def yearly_scores(samples: DataFrame, models: dict[int, Model], keep: Sequence[str]) -> DataFrame:
    """Score every sample with the model of its own year and of the year before."""
    parts = []
    for year, model in models.items():
        rows = samples.where(F.col("year").isin(year, year + 1))
        scored = score(model, rows).withColumn("model_year", F.lit(year))
        parts.append(scored.select(*keep, "year", "split", "y", "model_year", "score"))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    own = F.max(F.when(F.col("model_year") == F.col("year"), F.col("score")))
    old = F.max(F.when(F.col("model_year") == F.col("year") - 1, F.col("score")))
    return stacked.groupBy(*keep, "year", "split", "y").agg(own.alias("s_curr"), old.alias("s_prev"))


def coefficient_table(model: Model, names: Sequence[str], samples: DataFrame) -> DataFrame:
    """Feature and coefficient, largest first; as long as the model's own coefficient vector."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray())]
    return samples.sparkSession.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc("coefficient"), "feature")


def inferential_logreg(samples: DataFrame, names: Sequence[str]) -> tuple[Model, DataFrame]:
    """Unpenalized fit with a constant: estimate, standard error, p-value and 95 % interval."""
    if len(names) > MAX_INFERENTIAL:
        raise ValueError(f"standard errors are for at most {MAX_INFERENTIAL} features, got {len(names)}")
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y", regParam=0.0, maxIter=100)
    model = glm.fit(samples)
    summary = model.summary
    estimates = [*map(float, model.coefficients.toArray()), float(model.intercept)]
    rows = [
        (n, e, float(s), float(p), e - Z95 * float(s), e + Z95 * float(s))
        for n, e, s, p in zip([*names, "constant"], estimates, summary.coefficientStandardErrors, summary.pValues)
    ]
    schema = "feature string, coefficient double, std_err double, p_value double, ci_low double, ci_high double"
    return model, samples.sparkSession.createDataFrame(rows, schema)


@dataclass(frozen=True)
class Step:
    """One condition on a feature: at most or above a threshold, or (not) among categories."""

    feature: int
    sign: str  # <=, >, in, not in
    value: float | tuple[float, ...]

    def holds(self, values: Column) -> Column:
        """The condition on an array column of feature values."""
        value = values[self.feature]
        if self.sign in ("<=", ">"):
            return value <= self.value if self.sign == "<=" else value > self.value
        among = value.isin(*self.value)
        return among if self.sign == "in" else ~among

    def text(self, names: Sequence[str]) -> str:
        value = self.value if isinstance(self.value, float) else "{" + ",".join(map(str, self.value)) + "}"
        return f"{names[self.feature]} {self.sign} {value}"

    def opposite(self) -> Step:
        return Step(self.feature, {"<=": ">", ">": "<=", "in": "not in", "not in": "in"}[self.sign], self.value)


@dataclass(frozen=True)
class Leaf:
    """A leaf of a fitted tree: its number, the conditions on the way to it, and P(y = 1)."""

    number: int
    steps: tuple[Step, ...]
    probability: float


def _walk(node, steps: tuple[Step, ...]) -> Iterator[tuple[tuple[Step, ...], object]]:
    """The leaves below a node of the model's tree, left to right."""
    if node.subtreeDepth() == 0:
        yield steps, node
        return
    split = node.split()
    if split.getClass().getSimpleName() == "ContinuousSplit":
        left = Step(split.featureIndex(), "<=", float(split.threshold()))
    else:
        left = Step(split.featureIndex(), "in", tuple(float(c) for c in split.leftCategories()))
    yield from _walk(node.leftChild(), (*steps, left))
    yield from _walk(node.rightChild(), (*steps, left.opposite()))


def tree_leaves(model: DecisionTreeClassificationModel) -> list[Leaf]:
    """All leaves, numbered as the model's leaf column numbers them."""
    leaves = []
    for number, (steps, node) in enumerate(_walk(model._java_obj.rootNode(), ())):
        stats = node.impurityStats().stats()
        leaves.append(Leaf(number, steps, stats[1] / (stats[0] + stats[1])))
    return leaves


def in_leaves(leaves: Sequence[Leaf], values: Column, depth: int = 0) -> Column:
    """Whether the array of feature values belongs to one of the leaves: a plain filter, without the model, that tests every condition once."""
    if not leaves or any(len(leaf.steps) == depth for leaf in leaves):
        return F.lit(bool(leaves))
    step = leaves[0].steps[depth]
    with_step = [leaf for leaf in leaves if leaf.steps[depth] == step]
    others = [leaf for leaf in leaves if leaf.steps[depth] != step]
    return F.when(step.holds(values), in_leaves(with_step, values, depth + 1)).otherwise(in_leaves(others, values, depth + 1))


def leaves_text(leaves: Sequence[Leaf], names: Sequence[str]) -> str:
    """The rule of a set of leaves: their paths, one or the other."""
    paths = [" AND ".join(step.text(names) for step in leaf.steps) or "TRUE" for leaf in leaves]
    return paths[0] if len(paths) == 1 else " OR ".join(f"({path})" for path in paths) or "FALSE"


def tree_leaf_counts(model: DecisionTreeClassificationModel, samples: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per leaf: the path, and positives and rows of train and validation."""
    paths = samples.sparkSession.createDataFrame(
        [(leaf.number, [step.text(names) for step in leaf.steps]) for leaf in tree_leaves(model)], "leaf int, path array<string>"
    )
    placed = model.setLeafCol("_leaf").transform(samples).withColumn("leaf", F.col("_leaf").cast("int"))

    def part(split: str, name: str) -> list:
        here = F.col("split") == split
        return [
            F.sum(F.when(here, F.col("y")).otherwise(0)).alias(f"{name}_positive"),
            F.sum(F.when(here, 1).otherwise(0)).alias(f"{name}_size"),
        ]

    counts = placed.groupBy("leaf").agg(*part("train", "train"), *part("valid", "valid"))
    return counts.join(paths, "leaf")
