"""Person-level splits that keep first-outcome dates balanced, and yearly samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import hash32
from tidemark.functions.ranking import hash_rank
from tidemark.session import materialize

NEVER = "never"
TEST_SHARE = 0.2
FOLDS = 4


def outcome_stratum(outcomes: DataFrame) -> DataFrame:
    """Each person's first positive date as text, or 'never'."""
    first = F.min(F.when(F.col("y") == 1, F.col("end_date")))
    return outcomes.groupBy("person_id").agg(F.coalesce(first.cast("string"), F.lit(NEVER)).alias("stratum"))


def _fold(position: Column, size: Column, folds: int) -> Column:
    """Fold of the 1-based position: sizes differ by at most one and the first folds are larger."""
    base, larger = F.floor(size / folds), size % folds
    in_larger = position <= larger * (base + 1)
    return F.when(in_larger, F.floor((position - 1) / (base + 1))).otherwise(
        larger + F.floor((position - 1 - larger * (base + 1)) / F.greatest(base, F.lit(1)))
    )


def split_people(
    strata: DataFrame, seed: int, folds: int = FOLDS, test_share: float = TEST_SHARE, with_test: bool = True
) -> DataFrame:
    """``is_test`` and ``fold`` per person; strata too small to split stay in train of every fold (fold -1).

    Ranks come from hash slices, so the stratum that holds nearly everybody is
    never sorted in one task.
    """
    ranked = hash_rank(materialize(strata), ["person_id"], by=["stratum"], seed=seed)
    tiny = (F.col("stratum") != NEVER) & (F.col("group_size") < folds + 1)
    held = F.ceil(F.col("group_size") * F.lit(test_share)) if with_test else F.lit(0)
    is_test = ~tiny & (F.col("rank") <= held)
    fold = F.when(tiny | is_test, -1).otherwise(_fold(F.col("rank") - held, F.col("group_size") - held, folds))
    return ranked.select("person_id", "stratum", is_test.cast("int").alias("is_test"), fold.cast("int").alias("fold"))


def test_split(strata: DataFrame, seed: int, folds: int = FOLDS, test_share: float = TEST_SHARE) -> DataFrame:
    return split_people(strata, seed, folds, test_share).select("person_id", "stratum", "is_test")


def k_folds(strata: DataFrame, seed: int, folds: int = FOLDS, test_share: float = TEST_SHARE) -> DataFrame:
    return split_people(strata, seed, folds, test_share).where("is_test = 0").select("person_id", "stratum", "fold")


def yearly_samples(outcomes: DataFrame, people: DataFrame, fold: int, seed: int = 0) -> DataFrame:
    """Person-months with label, year, split for one fold, and a hash to order by."""
    split = F.when(F.col("is_test") == 1, "test").when(F.col("fold") == fold, "valid").otherwise("train")
    return outcomes.join(people, "person_id").select(
        "person_id",
        "end_date",
        F.year("end_date").alias("year"),
        split.alias("split"),
        "y",
        hash32(seed, "person_id", "end_date").alias("order_hash"),
    )


def split_counts(samples: DataFrame, splits: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    return samples.groupBy("year").pivot("split", list(splits)).count().fillna(0)


def person_samples(samples: DataFrame, seed: int = 0) -> DataFrame:
    """Sorted sample positions of each person in each year and split."""
    ranked = hash_rank(samples, ["person_id", "end_date"], by=["year", "split"], seed=seed)
    positions = F.sort_array(F.collect_list(F.col("rank") - 1))
    return ranked.groupBy("person_id", "year", "split").agg(positions.alias("sample_positions"))


def balanced_weights(samples: DataFrame) -> DataFrame:
    """Class weight n / (2 * n_class) on every sample; the two class sizes are scalars."""
    sizes = materialize(samples.agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")))
    n0, n1 = sizes.select("n0").scalar(), sizes.select("n1").scalar()
    in_class = F.when(F.col("y") == 1, n1).otherwise(n0)
    return samples.withColumn("weight", (n0 + n1).cast("double") / (2 * in_class).cast("double"))
