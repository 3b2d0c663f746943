"""Ranks and running sums that never sort a whole group in one task.

A plain ``Window.partitionBy(group).orderBy(x)`` sends all rows of a group to one
task, and a group may hold most of the data (for instance everybody without the
outcome). Both helpers here cut a group into ranges, sort within the ranges, and
add the totals of the ranges before.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import hash32
from tidemark.session import materialize

ROWS_PER_SLICE = 100_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match each other; keeps the left copy of the keys."""
    if not keys:
        raise ValueError("join_on needs at least one key")
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def hash_rank(
    df: DataFrame, ids: Sequence[str], by: Sequence[str] = (), seed: int = 0, buckets: int | None = None
) -> DataFrame:
    """Add ``rank`` (1-based, in hash order within ``by``) and ``group_size``.

    The hash is uniform, so equal slices of it hold equal shares of any group:
    each slice is sorted on its own and only the slice sizes are summed up. The
    number of slices follows the number of rows unless ``buckets`` (a power of two)
    is given. The result depends on the seed and the ids alone, so that lost tasks
    can be computed again.
    """
    df = materialize(df)
    if buckets is None:
        buckets = 1 << min(31, max(0, (df.count() - 1) // ROWS_PER_SLICE).bit_length())
    shift = 32 - int(math.log2(buckets))
    keyed = df.withColumn("_hash", hash32(seed, *ids)).withColumn("_slice", F.shiftright("_hash", shift))
    group = list(by)
    sizes = keyed.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"),
        F.sum("_n").over(whole).alias("group_size"),
    )
    inside = Window.partitionBy(*group, "_slice").orderBy("_hash", *ids)
    ranked = keyed.withColumn("_row", F.row_number().over(inside))
    return (
        join_on(ranked, offsets, [*group, "_slice"])
        .withColumn("rank", F.col("_below") + F.col("_row"))
        .drop("_hash", "_slice", "_below", "_row")
    )


def running_sums(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add ``<s>_below`` (sum over strictly smaller ``order``) and ``<s>_total`` within ``by``.

    ``df`` holds one row per (by, order); ``order`` may have any type that sorts, null
    comes first. Rows are range-partitioned by (by, order), so a large group spans many
    ranges and small groups share one. A range is summed on its own, and the totals of
    the ranges before are added. Spark chooses the number of ranges from the data
    unless ``rows_per_range`` fixes their size.
    """
    group = list(by)
    columns = df.columns
    keys = [*group, order]
    if rows_per_range:
        df = materialize(df)
        ranged = df.repartitionByRange(max(1, math.ceil(df.count() / rows_per_range)), *keys)
    else:
        ranged = df.repartitionByRange(*keys)
    # written, because the bounds of the ranges must be the same for both uses below
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))

    def sums_over(ordering: str, window: Window, names: dict[str, str]) -> list[Column]:
        before = window.orderBy(ordering).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(s).over(before), F.lit(0)).alias(n) for s, n in names.items()]

    totals = [F.sum(s).over(whole).alias(f"{s}_total") for s in sums]
    parts = ranged.groupBy(*group, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = parts.select(*group, "_range", *sums_over("_range", whole, {s: f"_{s}_before" for s in sums}), *totals)
    inside = Window.partitionBy(*group, "_range")
    inner = ranged.select("*", *sums_over(order, inside, {s: f"_{s}_inner" for s in sums}))
    return join_on(inner, offsets, [*group, "_range"]).select(
        *columns,
        *[(F.col(f"_{s}_before") + F.col(f"_{s}_inner")).alias(f"{s}_below") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def ordered_index(df: DataFrame, key: str, within: Sequence[str] = (), name: str = "example_id") -> DataFrame:
    """0-based dense row number in the order (key, within); a key has few rows of its own."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    below = running_sums(counts, order=key, sums=["_n"]).select(key, "_n_below")
    row = F.row_number().over(Window.partitionBy(key).orderBy(*(within or [key])))
    return (
        df.withColumn("_row", row)
        .join(below, key)
        .withColumn(name, F.col("_n_below") + F.col("_row") - 1)
        .drop("_row", "_n_below")
    )


def exact_percentiles(
    df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), discrete: bool = False
) -> DataFrame:
    """Exact percentiles in long form (by, probability, percentile) from counts of distinct values.

    ``discrete`` picks the first value whose cumulative share reaches p; otherwise
    the two values around position p * (n - 1) are interpolated.
    """
    group = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    run = running_sums(counts, order=value, sums=["_n"], by=group)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    run = run.select("*", (F.col("_n_below") + F.col("_n")).alias("_upto"), wanted)
    v = F.col(value).cast("double")
    if discrete:
        target = F.greatest(F.ceil(F.col("probability") * F.col("_n_total")), F.lit(1))
        hit = (F.col("_n_below") < target) & (target <= F.col("_upto"))
        return run.where(hit).select(*group, "probability", v.alias("percentile"))
    position = F.col("probability") * (F.col("_n_total") - 1)
    lower, upper = F.floor(position), F.ceil(position)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_n_below") <= index) & (index < F.col("_upto")), v))

    low_value, high_value = at(lower), at(upper)
    share = F.max(position - lower)
    return run.groupBy(*group, "probability").agg(
        (low_value + (high_value - low_value) * share).alias("percentile")
    )
