"""Person-level bootstraps and permutations of AUC differences.

Replicates are computed side by side, a block of them at a time. Samples of a person
with the same arm, outcome and score are one entry with a multiplicity. The persons of
a group are dealt to blocks, and a task holds the entries of one block: it gets or draws
the replicate weights of its persons, once per person, and adds them up per distinct
score, arm and outcome before anything travels. So what is shuffled are the draws, two
bits each, and sums per block and distinct score in the smallest integers that hold them,
never a vector of weights per entry. The scores of a group are cut into ranges of bounded
size; a second task adds up the blocks of a range, and a running sum puts ranges together.

Every draw is a pure function of seed, replicate and person.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import below, coin, draw62_numpy, key62
from tidemark.functions.ranking import hash_rank, join_on, running_sums
from tidemark.session import materialize

REPLICATES = 2000
ROWS_PER_TASK = 100_000
BLOCK = 4096  # persons whose draws are counted together
REPLICATE_BLOCK = 500  # replicates whose weights are added up at once
DRAWN_TOGETHER = 2  # replicates, at least, whose draws travel in one row
_CELLS = 4_000_000  # entries x replicates held at once in a task
_CACHED = 1 << 16  # draws mixed at once


def person_key(seed: int, person: str = "person_id") -> Column:
    return key62(seed, person)


def two_models(scores: DataFrame, by: Sequence[str], first: str = "s_curr", second: str = "s_prev") -> DataFrame:
    """Entries of two models on the same samples: arm 0 is the first model."""
    arms = F.array(
        F.struct(F.lit(0).alias("arm"), F.col(first).alias("value")),
        F.struct(F.lit(1).alias("arm"), F.col(second).alias("value")),
    )
    return scores.select(*by, "person_id", "y", F.explode(arms).alias("_a")).select(
        *by, "person_id", "y", "_a.arm", F.col("_a.value").cast("double").alias("value")
    )


def two_datasets(first: DataFrame, second: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Entries of one model on two datasets: arm 0 is the first dataset."""

    def side(df: DataFrame, arm: int) -> DataFrame:
        return df.select(*by, "person_id", "y", F.lit(arm).alias("arm"), F.col(score).cast("double").alias("value"))

    return side(first, 0).unionByName(side(second, 1))


def _range_sums(values: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positive and negative weight and concordant pairs of one range, per replicate; rows are sorted by value."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    pos, neg = np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
    below = np.cumsum(neg, axis=0) - neg
    return pos.sum(axis=0), neg.sum(axis=0), (pos * (below + neg / 2)).sum(axis=0)


def _segments(ordered: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """Where a new combination of the columns starts in rows that are sorted by them."""
    new = np.zeros(len(ordered), dtype=bool)
    new[:1] = True
    for name in names:
        values = ordered[name].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _segment_sums(weights: np.ndarray, place: np.ndarray, times: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per segment of entries and replicate: the weights of the entries' persons, times their multiplicity."""
    ends = np.r_[starts[1:], len(place)]
    out = np.empty((len(starts), weights.shape[1]), dtype=np.int64)
    single = ends - starts == 1
    out[single] = weights[place[starts[single]]] * times[starts[single], None]
    rows = max(1, _CELLS // weights.shape[1])
    for i in np.flatnonzero(~single):
        out[i] = 0
        for at in range(starts[i], ends[i], rows):
            to = min(ends[i], at + rows)
            part, many = weights[place[at:to]], times[at:to]
            out[i] += part.sum(axis=0, dtype=np.int64) if (many == 1).all() else many @ part
    return out


def _packed_sums(sums: np.ndarray) -> tuple[str, bytes]:
    """The numbers in the smallest unsigned type; numbers below 16 are worth compressing."""
    kind = np.min_scalar_type(int(sums.max(initial=0)))
    raw = sums.astype(kind).tobytes()
    return (f"z{kind.str}", zlib.compress(raw, 1)) if sums.max(initial=0) < 16 else (kind.str, raw)


def _unpacked_sums(kind: str, raw: bytes, width: int) -> np.ndarray:
    if kind.startswith("z"):
        kind, raw = kind[1:], zlib.decompress(raw)
    return np.frombuffer(raw, dtype=kind).reshape(-1, width)


def _sums_schema(entries: DataFrame, by: Sequence[str]) -> T.StructType:
    binary = [T.StructField(c, T.BinaryType()) for c in ("_values", "_arms", "_ys", "_totals", "_sums")]
    first = T.StructField("_first", T.IntegerType())
    return T.StructType([*[entries.schema[c] for c in [*by, "_range"]], first, *binary, T.StructField("_kind", T.StringType())])


def _block_sums(
    entries: pd.DataFrame, by: Sequence[str], blocks: Sequence[tuple[int, int]], weights: Callable[[int, int], np.ndarray]
) -> Iterator[list]:
    """Weight sums of a block of persons per range, distinct (value, arm, y) and replicate; ``_place`` is a person's row of the weights."""
    names = ["_range", "value", "arm", "y"]
    entries = entries.sort_values(names, kind="stable")
    starts = _segments(entries, names)
    place, times = entries["_place"].to_numpy(), entries["times"].to_numpy(dtype=np.int64)
    totals = np.add.reduceat(times, starts)
    first_rows = entries.iloc[starts]
    cuts = np.r_[_segments(first_rows, ["_range"]), len(starts)]
    head = {c: entries[c].iloc[0] for c in by}
    values, arms, ys = (first_rows[c].to_numpy(dtype=k) for c, k in (("value", np.float64), ("arm", np.uint8), ("y", np.float64)))
    ranges = first_rows["_range"].to_numpy()
    for first, last in blocks:
        drawn = weights(first, last)
        slices = max(1, _CELLS // drawn.shape[1])
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for a in range(low, high, slices):
                b = min(high, a + slices)
                here = slice(starts[a], starts[b] if b < len(starts) else len(place))
                kind, sums = _packed_sums(_segment_sums(drawn, place[here], times[here], starts[a:b] - starts[a]))
                packed = [x[a:b].tobytes() for x in (values, arms, ys, totals)]
                yield [*head.values(), ranges[a], first, *packed, sums, kind]


def _range_aucs(sums: DataFrame, by: Sequence[str], n: int, swap: bool) -> DataFrame:
    """Per (by, range, arm, replicate): pos, neg and concordant pairs within the range, from the sums of all blocks of persons."""
    fields = [sums.schema[c] for c in [*by, "_range"]]
    names = [f.name for f in fields]
    numbers = [T.StructField(c, T.IntegerType()) for c in ("arm", "replicate")]
    schema = T.StructType([*fields, *numbers, *[T.StructField(c, T.DoubleType()) for c in ("pos", "neg", "concordant")]])
    ends = dict(_in_blocks(n))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["_first"].iloc[0])
        width = ends[first] - first + 1
        kinds = (("_values", np.float64), ("_arms", np.uint8), ("_ys", np.float64), ("_totals", np.int64))
        values, arms, ys, totals = (np.frombuffer(b"".join(pdf[c]), dtype=k) for c, k in kinds)
        weights = np.concatenate([_unpacked_sums(k, s, width) for k, s in zip(pdf["_kind"], pdf["_sums"])])
        order = np.argsort(values, kind="stable")
        parts = []
        for a in (0, 1):
            rows = order if swap else order[arms[order] == a]
            if not len(rows):
                continue
            y, step = ys[rows][:, None], max(1, _CELLS // len(rows))
            for start in range(0, width, step):
                weight = weights[rows, start : start + step].astype(np.float64)
                if swap:  # the sums count the coins that move an entry to the other arm
                    weight = np.where((arms[rows] == a)[:, None], totals[rows][:, None] - weight, weight)
                pos, neg, concordant = _range_sums(values[rows], weight * y, weight * (1 - y))
                replicates = np.arange(first + start, first + start + weight.shape[1])
                parts.append(pd.DataFrame({"arm": a, "replicate": replicates, "pos": pos, "neg": neg, "concordant": concordant}))
        out = pd.concat(parts, ignore_index=True)
        for name in names:
            out.insert(0, name, pdf[name].iloc[0])
        return out[[f.name for f in schema.fields]]

    return sums.groupBy(*names, "_first").applyInPandas(merge, schema)


def _merged(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entries with multiplicity (times)."""
    return entries.groupBy(*by, "person_id", "arm", "y", "value").agg(F.count(F.lit(1)).alias("times"))


def _ranged(entries: DataFrame, by: Sequence[str], rows_per_task: int) -> DataFrame:
    """Entries with their group's score range and the entries of the group."""
    counts = entries.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_n"))
    run = running_sums(counts, order="value", sums=["_n"], by=by)
    marks = run.select(*by, "value", F.floor(F.col("_n_below") / rows_per_task).alias("_range"), "_n_total")
    return join_on(entries, materialize(marks), [*by, "value"])


def _aucs(ranged: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUC of both arms and their difference per (by, replicate) from the sums of the ranges."""
    keys = [*by, "arm", "replicate"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    pairs = F.sum(F.col("concordant") + F.col("pos") * F.col("_below"))
    aucs = ranged.withColumn("_below", below).groupBy(*keys).agg(F.try_divide(pairs, F.sum("pos") * F.sum("neg")).alias("auc"))

    def arm(a: int) -> Column:
        return F.max(F.when(F.col("arm") == a, F.col("auc"))).alias(f"auc_{a + 1}")

    paired = aucs.groupBy(*by, "replicate").agg(arm(0), arm(1))
    return paired.withColumn("auc_diff", F.col("auc_1") - F.col("auc_2"))


def _pack_gaps(gaps: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Gaps as small numbers, and where each one ends; the largest number of the type goes on without a draw."""
    top = np.iinfo(kind).max
    skips, rest = np.divmod(gaps, top)
    ends = np.cumsum(skips + 1)
    packed = np.full(ends[-1] if len(ends) else 0, top, dtype=kind)
    packed[ends - 1] = rest
    return packed, ends


def _coded(raw: bytes) -> bytes:
    """Gaps by the frequencies of their bytes: most are small, and only that makes them shorter, since they never repeat in a pattern."""
    coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return coder.compress(raw) + coder.flush()


def _unpack_gaps(raw: bytes, kind: str) -> np.ndarray:
    """The numbers whose gaps were packed."""
    if kind.startswith("z"):
        kind, raw = kind[1:], zlib.decompress(raw)
    gaps = np.frombuffer(raw, dtype=kind)
    return np.cumsum(gaps, dtype=np.int64)[gaps != np.iinfo(gaps.dtype).max]


def _spread_draws(seed: int, group: Sequence[str]):
    """Draws of a run of persons in a few replicates, per block of drawn persons: the gaps between the (person, replicate) cells that were hit."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                stratum, size, first, low, high, start, stop = row[len(group) :]
                width = high - low + 1
                keys, replicates = np.arange(start, stop + 1) * 2 + stratum, np.arange(low, high + 1)
                kind, step = np.uint8 if size < 128 * len(keys) else np.uint16, max(1, _CACHED // width)
                drawers = (keys[at : at + step] for at in range(0, len(keys), step))
                drawn = np.concatenate([below(*draw62_numpy(some, replicates, seed), size) for some in drawers])
                cells = np.sort((drawn * width + np.arange(width)).ravel())
                blocks = cells // (BLOCK * width)
                starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
                hit, gaps = blocks[starts], np.diff(cells, prepend=0)
                gaps[starts] = cells[starts] - hit * (BLOCK * width)
                packed, ends = _pack_gaps(gaps, kind)
                parts = [_coded(x.tobytes()) for x in np.split(packed, ends[starts[1:] - 1])]
                rows = {"_block": hit, "_first": first, "_low": low, "_high": high, "_kind": f"z{np.dtype(kind).str}", "_gaps": parts}
                yield pd.DataFrame({**{c: [v] * len(hit) for c, v in zip(group, row)}, **rows})

    return spread


def _drawn_counts(draws: pd.DataFrame, first: int, last: int) -> np.ndarray:
    """How often each person of a block was drawn by each of the replicates."""
    here = draws[draws["_first"] == first]
    counts = np.zeros((BLOCK, last - first + 1), dtype=np.uint16)
    for low, high, kind, raw in zip(here["_low"], here["_high"], here["_kind"], here["_gaps"]):
        hits = np.bincount(_unpack_gaps(raw, kind), minlength=BLOCK * (high - low + 1))
        counts[:, low - first : high - first + 1] += hits.reshape(BLOCK, -1).astype(np.uint16)
    return counts


def _draws(ranked: DataFrame, by: Sequence[str], blocks: Sequence[tuple[int, int]], seed: int) -> DataFrame:
    """The draws of all replicates, packed by the block of persons they hit.

    A draw depends on its number and its group's size alone, so the work is dealt by replicates: a task makes the draws
    of as many persons as it can hold at once, in few replicates. The cells they hit then lie
    close together in a group of any size, and a gap is some two bits instead of more for every doubling of the group.
    """
    group = [*by, "stratum"]
    sizes = ranked.groupBy(*group).agg(F.max("group_size").alias("group_size"))
    width = F.greatest(F.lit(DRAWN_TOGETHER), F.least(F.lit(REPLICATE_BLOCK), F.floor(F.lit(_CELLS) / F.col("group_size"))))
    ranges = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in blocks]))
    few = sizes.select("*", width.cast("int").alias("_width"), ranges.alias("_r")).select(
        "*", F.explode(F.sequence("_r.first", "_r.last", "_width")).alias("_low")
    )
    run = F.floor(F.lit(_CELLS) / F.col("_width"))
    high = F.least(F.col("_low") + F.col("_width") - 1, F.col("_r.last"))
    runs = few.select("*", high.alias("_high"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("group_size"), run)).alias("_start"))
    stop = F.least(F.col("_start") + run - 1, F.col("group_size")).alias("_stop")
    # each row stands for up to _CELLS draws, so rows are dealt one by one, however small they are
    tasks = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.select(*group, F.col("stratum").alias("_stratum"), "group_size", F.col("_r.first").alias("_first"), "_low", "_high", "_start", stop)
    more = "_block long, _first int, _low int, _high int, _kind string, _gaps binary"
    fields = [*[ranked.schema[c] for c in group], *T.StructType.fromDDL(more).fields]
    return dealt.repartition(tasks).mapInPandas(_spread_draws(seed, group), T.StructType(fields))


def ranked_persons(entries: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    """Persons numbered within two strata per group: those who are ever positive and those who never are."""
    people = entries.groupBy(*by, "person_id").agg(F.max("y").alias("stratum"))
    return materialize(hash_rank(people, ["person_id"], by=[*by, "stratum"], seed=seed))


def bootstrap_draws(ranked: DataFrame, by: Sequence[str], first: int, last: int, seed: int) -> DataFrame:
    """For each person, how often each of the replicates first..last drew them, two bytes per replicate.

    Each replicate draws as many persons from a stratum as it has, with replacement.
    Person number i of a stratum makes the i-th draw of every replicate; the drawn
    number is a hash of (i, stratum, replicate). Draws travel packed, two bits each, to the block of persons they hit.
    """
    group = [*by, "stratum"]
    counted = T.StructType([*[ranked.schema[c] for c in group], *T.StructType.fromDDL("rank long, weights binary").fields])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = _drawn_counts(pdf, first, last)
        hit = np.flatnonzero(counts.any(axis=1))
        out = {c: [pdf[c].iloc[0]] * len(hit) for c in group}
        weights = [row.tobytes() for row in counts[hit]]
        return pd.DataFrame({**out, "rank": pdf["_block"].iloc[0] * BLOCK + hit + 1, "weights": weights})

    counts = _draws(ranked, by, [(first, last)], seed).groupBy(*group, "_block").applyInPandas(count, counted)
    return join_on(ranked, counts, [*group, "rank"]).select(*by, "person_id", "weights")


def _in_blocks(n: int) -> list[tuple[int, int]]:
    return [(k + 1, min(n, k + REPLICATE_BLOCK)) for k in range(0, n, REPLICATE_BLOCK)]


def bootstrap_aucs(
    entries: DataFrame, by: Sequence[str] = (), n: int = REPLICATES, seed: int = 0, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """AUC of both arms per stratified person-level bootstrap replicate."""
    merged = materialize(_merged(entries, by))
    ranked = ranked_persons(merged, by, seed)
    keys = [*by, "stratum", "_block"]
    place = F.pmod(F.col("rank") - 1, F.lit(BLOCK)).cast("int")
    places = ranked.select(*by, "person_id", "stratum", F.floor((F.col("rank") - 1) / BLOCK).alias("_block"), place.alias("_place"))
    placed = join_on(_ranged(merged, by, rows_per_task), places, [*by, "person_id"]).select(*keys, "_place", "_range", "value", "arm", "y", "times")
    blocks, schema = _in_blocks(n), _sums_schema(placed, by)

    def weigh(held: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        rows = _block_sums(held, by, blocks, functools.partial(_drawn_counts, draws)) if len(held) else ()
        return pd.DataFrame(rows, columns=schema.names)

    drawn = _draws(ranked, by, blocks, seed)
    sums = placed.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInPandas(weigh, schema)
    return _aucs(_range_aucs(sums, by, n, False), by)


def permutation_aucs(
    entries: DataFrame, by: Sequence[str] = (), n: int = REPLICATES, seed: int = 0, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """AUC of both arms when a fair coin per person and replicate swaps the person's arms."""
    keyed = _merged(entries, by).withColumn("person_key", person_key(seed))
    ranged = _ranged(materialize(keyed), by, rows_per_task)
    block = F.pmod(F.xxhash64("person_key"), F.ceil(F.col("_n_total") / rows_per_task))
    placed = ranged.select(*by, block.alias("_block"), "person_key", "_range", "value", "arm", "y", "times")
    blocks, schema = _in_blocks(n), _sums_schema(placed, by)

    def toss(held: pd.DataFrame) -> pd.DataFrame:
        people, place = np.unique(held["person_key"].to_numpy(), return_inverse=True)

        def coins(first: int, last: int) -> np.ndarray:
            replicates, step = np.arange(first, last + 1), max(1, _CELLS // (last - first + 1))
            parts = [people[at : at + step] for at in range(0, len(people), step)]
            return np.concatenate([coin(draw62_numpy(part, replicates, seed)[1]).astype(np.uint8) for part in parts])

        return pd.DataFrame(_block_sums(held.assign(_place=place), by, blocks, coins), columns=schema.names)

    sums = placed.groupBy(*by, "_block").applyInPandas(toss, schema)
    return _aucs(_range_aucs(sums, by, n, True), by)


def actual_difference(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC of both arms without resampling."""
    from tidemark.operators.metrics import auc

    per_arm = auc(entries, "value", [*by, "arm"])
    wide = per_arm.groupBy(*by).agg(
        F.max(F.when(F.col("arm") == 0, F.col("auc"))).alias("actual_1"),
        F.max(F.when(F.col("arm") == 1, F.col("auc"))).alias("actual_2"),
    )
    return wide.withColumn("actual_diff", F.col("actual_1") - F.col("actual_2"))


def pivotal_ci(replicates: DataFrame, actual: DataFrame, by: Sequence[str], level: float = 0.90) -> DataFrame:
    """Pivotal interval [2 a - q_high, 2 a - q_low] of the difference; the screen asks for a lower end above 0."""
    tail = (1 - level) / 2
    q = replicates.groupBy(*by).agg(
        F.expr(f"percentile(auc_diff, array({tail:.6f}D, {1 - tail:.6f}D))").alias("q"),
    )
    a = F.col("actual_diff")
    joined = join_on(actual, q, list(by))
    return (
        joined.withColumn("ci_low", 2 * a - F.col("q")[1])
        .withColumn("ci_high", 2 * a - F.col("q")[0])
        .withColumn("above_zero", (a > 0) & (F.col("ci_low") > 0))
        .drop("q")
    )


def bootstrap_se(replicates: DataFrame, by: Sequence[str] = (), value: str = "auc_1") -> DataFrame:
    return replicates.groupBy(*by).agg(F.stddev_pop(value).alias("auc_se"))


def permutation_p_value(replicates: DataFrame, actual: DataFrame, by: Sequence[str]) -> DataFrame:
    """(1 + replicates at least as large as the actual difference) / (1 + replicates)."""
    joined = join_on(replicates, actual.select(*by, "actual_diff"), list(by))
    larger = F.sum((F.col("auc_diff") >= F.col("actual_diff")).cast("int"))
    p = (larger + 1).cast("double") / (F.count(F.lit(1)) + 1).cast("double")
    return joined.groupBy(*by).agg(F.max("actual_diff").alias("actual_diff"), p.alias("p_value"))
