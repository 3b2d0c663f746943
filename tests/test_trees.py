"""Fitted trees as plain filters, prefixes of boosted trees, and the first year of a region."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators import models, regions


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 4))
    x[:, 3] = draw.integers(0, 3, 600)
    y = ((x[:, 0] * x[:, 1] > 0.2) ^ (x[:, 3] == 1)).astype(int)
    split = ["train", "valid", "test"]
    return spark.createDataFrame(
        [(i, split[i % 3], int(b), Vectors.sparse(4, [(k, float(v)) for k, v in enumerate(a) if v])) for i, (a, b) in enumerate(zip(x, y))],
        ["id", "split", "y", "features"],
    ).cache()


def test_compiled_leaves_equal_the_models(spark, rows):
    indexed = VectorIndexer(inputCol="features", outputCol="f", maxCategories=3).fit(rows).transform(rows).drop("features").withColumnRenamed("f", "features")
    for frame in (rows, indexed):
        model = DecisionTreeClassifier(labelCol="y", maxDepth=6, minInstancesPerNode=3, leafCol="leaf", seed=0).fit(frame)
        leaves = models.tree_leaves(model)
        assert len(leaves) == (model.numNodes + 1) // 2
        values = vector_to_array("features")
        placed = model.transform(frame).withColumn("p", vector_to_array("probability")[1])
        own = F.coalesce(*[F.when(models.in_leaves([leaf], F.col("v")), leaf.number) for leaf in leaves])
        known = F.create_map(*[F.lit(x) for leaf in leaves for x in (leaf.number, leaf.probability)])
        wrong = placed.withColumn("v", values).withColumn("own", own).where((F.col("own") != F.col("leaf")) | (F.abs(known[F.col("own")] - F.col("p")) > 1e-12))
        assert wrong.count() == 0
        region = models.in_leaves([leaf for leaf in leaves if leaf.probability >= 0.5], F.col("v"))
        assert placed.withColumn("v", values).where(region != (F.col("p") >= 0.5)).count() == 0
        assert sum(r.train_size for r in models.tree_leaf_counts(model, rows if frame is rows else frame, list("abcd")).collect()) == 200


def test_catalog_of_leaves(spark):
    low, high = models.Step(0, "<=", 0.5), models.Step(0, ">", 0.5)
    other = models.Step(1, "in", (0.0, 2.0))
    trees = {1999: [models.Leaf(0, (low,), 0.1), models.Leaf(1, (high, other), 0.5), models.Leaf(2, (high, other.opposite()), 0.9)]}
    found = regions.leaf_region_catalog(spark, trees, ["Metformin", "stage"]).orderBy("inside").collect()
    assert [(r.inside, r.region_label, r.file_key, r.leaves, r.rule) for r in found] == [
        (0, "predicted not in 1999", "pred_not_in_1999", [0], "Metformin <= 0.5"),
        (1, "predicted in 1999", "pred_in_1999", [1, 2], "(Metformin > 0.5 AND stage in {0.0,2.0}) OR (Metformin > 0.5 AND stage not in {0.0,2.0})"),
    ]


def test_first_trees_equal_a_shorter_fit(spark, rows):
    train = rows.where("split = 'train'").withColumn("w", F.lit(1.5))
    fit = GBTClassifier(labelCol="y", weightCol="w", maxDepth=3, seed=0)
    longest = fit.copy({fit.maxIter: 8}).fit(train)
    for count in (1, 3, 8):
        short = fit.copy({fit.maxIter: count}).fit(train)
        both = [{r.id: r.score for r in models.score(m, rows).select("id", "score").collect()} for m in (short, models.first_trees(longest, count))]
        assert both[0] == pytest.approx(both[1], abs=1e-12)


def test_boosted_grid_is_the_grid_of_separate_fits(spark, rows):
    train, valid = rows.where("split = 'train'"), rows.where("split = 'valid'")
    model, position, auc = models.train_boosted(train, valid, trees=(2, 5), depths=(2, 4))
    sizes = train.agg(F.sum(1 - F.col("y")), F.sum("y")).first()
    weighted = train.withColumn("w", F.when(F.col("y") == 1, sizes[0] / sizes[1]).otherwise(1.0))
    grid = [GBTClassifier(labelCol="y", weightCol="w", maxIter=t, maxDepth=d, seed=0) for t in (2, 5) for d in (2, 4)]
    assert models.choose(grid, weighted, valid)[1:] == (position, pytest.approx(auc))


def test_a_region_is_used_in_its_first_year_only(spark):
    table = [(1998, "a", 5.0), (1998, "Y", 4.0), (1998, "b", 3.0), (1999, "a", -5.0), (1999, "b", 4.0), (1999, "c", 3.0), (2000, "a", 6.0), (2000, "c", -2.0), (2000, "d", 0.0), (2000, "e", 1.0)]
    frame = spark.createDataFrame(table, "year int, feature string, coefficient double")
    found = sorted((r.year, r.feature, r.position) for r in regions.top_features(frame, k=3).collect())
    assert found == [(1998, "a", 1), (1998, "b", 3), (1999, "a", 1), (1999, "c", 3), (2000, "c", 2), (2000, "e", 3)]
