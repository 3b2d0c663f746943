"""Queries that train models. SQL cannot repeat a fit, so all but the first have no SQL twin."""

from __future__ import annotations

import functools

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import features, models, regions, shift
from tidemark.operators import metrics as me
from tidemark.plans.feature_queries import SQL_LONG, long_samples, sample_sets
from tidemark.plans.metric_queries import REPLICATES, SEED, scores
from tidemark.plans.outcome_queries import samples
from tidemark.plans.registry import query, sql
from tidemark.session import materialize


def assembled(r, min_count=300, windows=(30, 365)):
    """Samples with a sparse vector of the frequent features, and the feature names in column order."""
    sets = materialize(sample_sets(r, windows))
    long = features.one_per_feature(sets)
    frequent = features.frequent_features(long, min_count).orderBy("feature")
    names = [row["feature"] for row in frequent.select("feature").collect()]
    vectors = features.vectorize(sets, names).select("person_id", "end_date", "year", "split", "y", "features")
    return materialize(vectors, by=("year", "split")), names, long


def one_year(data, year):
    rows = data.where(F.col("year") == year)
    return rows.where("split = 'train'"), rows.where("split = 'valid'"), rows.where("split = 'test'")


def all_years(data):
    return [row["year"] for row in data.select("year").distinct().orderBy("year").collect()]


def each_year(data, build):
    """Rows of ``build(train, valid, test, year)`` for every year; the years are independent and run side by side."""
    return functools.reduce(DataFrame.unionByName, models.side_by_side(lambda y: build(*one_year(data, y), y), all_years(data)))


def test_auc(model, test):
    return me.auc(models.score(model, test), "score", ["year"])


@query(
    "f25_assemble",
    sql(
        *SQL_LONG,
        "per_sample AS (SELECT person_id, end_date, count(*) AS k FROM long GROUP BY 1, 2)",
        select="""SELECT s.year, s.split, count(*) AS num_samples, round(CAST(coalesce(sum(p.k), 0) AS DOUBLE), 6) AS num_present
        FROM samples s LEFT JOIN per_sample p ON p.person_id = s.person_id AND p.end_date = s.end_date GROUP BY 1, 2""",
    ),
)
def _(r):
    data, _, _ = assembled(r)
    present = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return data.groupBy("year", "split").agg(F.count(F.lit(1)).alias("num_samples"), F.sum(present).alias("num_present"))


def _fit_query(name, fit):
    @query(name)
    def _(r):
        data, _, _ = assembled(r)

        def fitted(train, valid, test, year):
            model, position, valid_auc = fit(train, valid)
            found = test_auc(model, test)
            return found.select("year", F.lit(position).alias("grid_position"), F.lit(valid_auc).alias("valid_auc"), F.col("auc").alias("test_auc"))

        return each_year(data, fitted)


_fit_query("m01_train_logreg", models.train_logreg)
_fit_query("m01_train_logreg_l1", functools.partial(models.train_logreg, penalty="l1"))
_fit_query("m02_train_decision_tree", models.train_decision_tree)
_fit_query("m03_train_forest", models.train_forest)
_fit_query("m04_train_boosted", models.train_boosted)


def yearly_models(data):
    return models.models_per_year(data, all_years(data), models.train_logreg)


@query("m05_models_per_year")
def _(r):
    data, _, _ = assembled(r)
    fitted = yearly_models(data)
    scored = models.yearly_scores(data.where("split = 'test'"), fitted, ["person_id", "end_date"])
    return me.auc(scored.where("s_curr IS NOT NULL"), "s_curr", ["year"])


@query("m06_coefficient_table")
def _(r):
    data, names, _ = assembled(r)
    tables = [models.coefficient_table(m, names, data).withColumn("year", F.lit(y)) for y, m in yearly_models(data).items()]
    return functools.reduce(lambda a, b: a.unionByName(b), tables)


@query("m07_inferential_logreg")
def _(r):
    data, names, _ = assembled(r)

    def fitted(train, valid, test, year):
        return models.inferential_logreg(train, names)[1].withColumn("year", F.lit(year))

    return each_year(data, fitted)


@query("m08_score")
def _(r):
    data, _, _ = assembled(r)

    def scored(train, valid, test, year):
        model, _, _ = models.train_logreg(train, valid)
        return models.score(model, test).select("person_id", "end_date", "year", "y", "score")

    return each_year(data, scored)


@query("m18_tree_leaf_counts")
def _(r):
    data, names, _ = assembled(r)

    def counted(train, valid, test, year):
        model, _, _ = models.train_decision_tree(train, valid)
        counts = models.tree_leaf_counts(model, train.unionByName(valid), names)
        return counts.select(F.lit(year).alias("year"), "*").withColumn("path", F.concat_ws(" AND ", "path"))

    return each_year(data, counted)


# ------------------------------------------------------------------ regions


def score_samples(r):
    """Score rows with person-level features, and the feature names in column order."""
    rows = scores(r)
    person = r["customer"].select(
        F.col("c_custkey").alias("person_id"),
        F.explode(
            F.array(
                F.concat(F.lit("segment "), "c_mktsegment"),
                F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")),
            )
        ).alias("feature"),
    )
    names = [row["feature"] for row in person.select("feature").distinct().orderBy("feature").collect()]
    by_person = rows.select("sample_id", "person_id").join(person, "person_id").select("sample_id", "feature")
    vectors = features.assemble(rows, by_person, names, numeric=["s_curr"], keys=["sample_id"])
    return materialize(vectors), [*names, "current score"]


def region_pool(data, year):
    """Samples of one year, labelled where the previous model is farther off, split into train and validation; None for too few."""
    labelled = regions.calibration_error_label(data.where(F.col("year") == year))
    enough = regions.error_dataset(labelled, ["year"])
    pool = regions.label_stratified_resplit(enough, ["sample_id"], ["year"], seed=SEED).withColumn("y", F.col("label"))
    return None if pool.isEmpty() else pool


def fit_region(data, year):
    """A tree that predicts where the previous model is farther off in one year."""
    pool = region_pool(data, year)
    return pool and models.train_decision_tree(pool.where("split = 'train'"), pool.where("split = 'valid'"))


def fit_regions(data):
    """The fit of every year that has enough rows of both labels."""
    years = all_years(data)
    fitted = zip(years, models.side_by_side(lambda year: fit_region(data, year), years))
    return {year: fit for year, fit in fitted if fit is not None}


@query("r06_fit_regions")
def _(r):
    data, _ = score_samples(r)
    parts = []
    for year, (model, position, valid_auc) in fit_regions(data).items():
        test = regions.calibration_error_label(data.where((F.col("year") == year) & (F.col("split") == "test")))
        scored = models.score(model, test.withColumn("y", F.col("label")))
        metrics = me.eval_predictions(scored, "score", 0.5, ["year"])
        parts.append(metrics.withColumn("grid_position", F.lit(position)).withColumn("valid_auc", F.lit(valid_auc)))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("r11_leaf_region_catalog")
def _(r):
    data, names = score_samples(r)
    trees = {year: models.tree_leaves(model) for year, (model, _, _) in fit_regions(data).items()}
    catalog = regions.leaf_region_catalog(data.sparkSession, trees, names)
    # the rule of a region as a filter on the samples of its year
    values = data.withColumn("_values", vector_to_array("features"))
    sizes = []
    for year, leaves in trees.items():
        inside = models.in_leaves([leaf for leaf in leaves if leaf.probability >= 0.5], F.col("_values"))
        side = values.where(F.col("year") == year).select("year", inside.cast("int").alias("inside"))
        sizes.append(side.groupBy("year", "inside").agg(F.count(F.lit(1)).alias("num_samples")))
    counts = functools.reduce(DataFrame.unionByName, sizes)
    return catalog.join(counts, ["year", "inside"], "left").withColumn("leaves", F.concat_ws(",", "leaves"))


@query("r18_interpretable_leaves")
def _(r):
    data, names = score_samples(r)
    parts = []
    for year, (model, _, _) in fit_regions(data).items():
        leaves = models.tree_leaf_counts(model, region_pool(data, year).where("split IN ('train', 'valid')"), names)
        kept = regions.interpretable_leaves(leaves, max_depth=models.MAX_DEPTH)
        parts.append(kept.select(F.lit(year).alias("year"), "leaf", "valid_size", "valid_positive", "rule", "share"))
    return functools.reduce(DataFrame.unionByName, parts)


@query("r17_subpopulation_scan")
def _(r):
    data, _ = score_samples(r)
    parts = []
    for year, (model, _, _) in fit_regions(data).items():
        rows = models.score(model, data.where(F.col("year").isin(year - 1, year)), "region_score")
        marked = regions.model_region(rows, "region_score").withColumn("region_year", F.lit(year))
        parts.append(marked.select("sample_id", "person_id", "year", "split", "y", "s_prev", "s_curr", "region", "region_year"))
    stacked = materialize(functools.reduce(lambda a, b: a.unionByName(b), parts))
    return regions.region_nonstationarity_check(stacked, ["region_year"], REPLICATES, SEED)


# -------------------------------------------------------------------- shift


def year_pair(data, prev=1998, curr=1999):
    """The later year as label."""
    both = data.where(F.col("year").isin(prev, curr))
    return both.withColumn("y", (F.col("year") == curr).cast("int"))


@query("x02_domain_classifier")
def _(r):
    data, names, _ = assembled(r, min_count=20, windows=(30,))
    pair = year_pair(data)
    model, _, _ = models.train_logreg(pair.where("split = 'train'"), pair.where("split = 'valid'"), penalty="l1")
    return models.coefficient_table(model, names, data).where("coefficient <> 0")


IMPORTANT = 3


def imputation_task(r, prev=1998, curr=1999):
    """Samples of two years with their present 30-day features, vectors of both windows, the vocabulary, and the features to impute."""
    rows = materialize(samples(r).where(F.col("year").isin(prev, curr)))
    long = materialize(long_samples(r, (30, 365), sampled=rows))
    frequent = features.keep_features(long, features.frequent_features(long, 300))
    short, wide = (materialize(frequent.where(F.col("feature").endswith(f" - {days} days"))) for days in (30, 365))

    def vectors(part):
        names = [row["feature"] for row in part.select("feature").distinct().orderBy("feature").collect()]
        return materialize(features.assemble(rows, part, names)), names

    (raw, names), (other, _) = vectors(short), vectors(wide)
    order = short.where((F.col("year") == prev) & (F.col("split") == "train")).groupBy("feature").count().orderBy(F.desc("count"), "feature")
    return rows, short, raw, other, names, [row["feature"] for row in order.limit(IMPORTANT).collect()]


@query("x06_impute_by_models")
def _(r):
    """How often the most frequent 30-day features occur before and after imputation by models of the earlier year."""
    rows, short, _, wide, _, important = imputation_task(r)
    fitted = models.imputation_models(wide.where("year = 1998"), short, important)
    filled = models.imputed_features(wide, short, fitted).join(rows, ["person_id", "end_date"])

    def counts(long, name):
        return long.where(F.col("feature").isin(important)).groupBy("year", "split", "feature").agg(F.count(F.lit(1)).alias(name))

    sizes = rows.groupBy("year", "split").agg(F.count(F.lit(1)).alias("num_samples"))
    after = counts(filled, "num_after").join(counts(short, "num_before"), ["year", "split", "feature"], "left")
    return after.join(sizes, ["year", "split"]).withColumn("num_before", F.coalesce("num_before", F.lit(0)))


@query("x07_imputation_models_effect")
def _(r):
    """The earlier year's model on both years and the later year's on its own, raw and imputed by models of the same year."""
    rows, short, raw, wide, names, important = imputation_task(r)
    parts = []
    for fit_year, years in ((1998, (1998, 1999)), (1999, (1999,))):
        model, _, _ = models.train_logreg(*one_year(raw, fit_year)[:2])
        fitted = models.imputation_models(wide.where(F.col("year") == fit_year), short, important)
        test = rows.where((F.col("split") == "test") & F.col("year").isin(*years))
        filled = models.imputed_features(wide.join(test.select("person_id", "end_date"), ["person_id", "end_date"], "left_semi"), short, fitted)
        imputed = features.assemble(test, filled, names)
        for variant, frame in (("raw", raw.where((F.col("split") == "test") & F.col("year").isin(*years))), ("imputed", imputed)):
            scored = models.score(model, frame).select("year", "y", "score", F.lit(fit_year).alias("model_year"), F.lit(variant).alias("variant"))
            parts.append(scored)
    return me.eval_predictions(functools.reduce(DataFrame.unionByName, parts), by=["model_year", "year", "variant"])


@query("x10_reweighted_model")
def _(r):
    data, _, _ = assembled(r)
    pair = year_pair(data)
    domain, _, _ = models.train_logreg(pair.where("split = 'train'"), pair.where("split = 'valid'"))
    scored = models.score(domain, data.where("year = 1998"), "p_year")
    weighted = materialize(shift.importance_weights(scored, "p_year").drop("p_year"))
    model, _, valid_auc = models.train_logreg(
        weighted.where("split = 'train'"), weighted.where("split = 'valid'"), weight_col="weight"
    )
    plain, _, _ = models.train_logreg(*one_year(data, 1998)[:2])
    target = data.where("year = 1999 AND split = 'test'")
    variants = [
        models.score(m, target).select("year", "y", "score", F.lit(n).alias("variant"))
        for n, m in (("reweighted", model), ("plain", plain))
    ]
    found = me.auc(variants[0].unionByName(variants[1]), "score", ["year", "variant"])
    return found.withColumn("weighted_valid_auc", F.lit(valid_auc))


@query("x21_robust_feature_retrain")
def _(r):
    """Every two consecutive years on all features, on those whose sign is stable, and on those whose intervals lie on one side of zero in both."""
    data, names, _ = assembled(r)
    place = {name: i for i, name in enumerate(names)}
    fitted = yearly_models(data)
    pairs = [(y, y + 1) for y in fitted if y + 1 in fitted]

    def intervals_of(year):
        return materialize(models.inferential_logreg(one_year(data, year)[0], names)[1].where("feature <> 'constant'"))

    # a year between two others is in two pairs; it is fitted once
    paired = sorted({y for pair in pairs for y in pair})
    inferred = dict(zip(paired, models.side_by_side(intervals_of, paired)))
    parts = []
    for prev, curr in pairs:
        both = data.where(F.col("year").isin(prev, curr))
        signs = [models.coefficient_table(fitted[y], names, data) for y in (prev, curr)]
        chosen = {"stable": shift.sign_stable_features(*signs), "interval stable": shift.ci_stable_features(inferred[prev], inferred[curr])}
        variants = [("all", both, {y: fitted[y] for y in (prev, curr)})]
        for name, found in chosen.items():
            stable = sorted(row["feature"] for row in found.collect())
            if not stable:
                continue
            places = VectorSlicer(inputCol="all", outputCol="features", indices=[place[n] for n in stable])
            robust = materialize(places.transform(both.withColumnRenamed("features", "all")).drop("all"), by=("year", "split"))
            variants.append((name, robust, models.models_per_year(robust, (prev, curr), models.train_logreg)))
        for name, frame, group in variants:
            scored = models.yearly_scores(frame.where("split = 'test'"), group, ["person_id", "end_date"])
            found = shift.three_way_evaluation(scored, curr)
            parts.append(found.withColumn("feature_set", F.lit(name)).withColumn("year", F.lit(curr)))
    return functools.reduce(DataFrame.unionByName, parts)
