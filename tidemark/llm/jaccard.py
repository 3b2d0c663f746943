"""Near duplicates by exact Jaccard similarity of sets of word shingles.

Equal sets are one from the start. MinHash bands only propose: a pair of similarity s
shares a band with probability 1 - (1 - s ** ROWS) ** BANDS, that is all but 6 in a
million at 0.8 and more above it. Sets that bands connect form a cluster, and each set
travels once, to its cluster's task. There the Gray-order index over fingerprints of
the sets drops groups of sets whose bits differ too much, at a distance so wide that a
pair of similarity 0.8 is beyond it once in a hundred million, and every pair left whose
ends are not yet connected is confirmed on the whole sets: a link is never an estimate.

A cluster too large for one task is met by its smallest member first, which connects
near copies of one text. Then, in each band, a few pivots meet all others that are not
connected to them, leave the group, and what is still unconnected goes on with four times as many.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.simhash import LOWER, GrayIndex
from tidemark.llm.text import text_slices
from tidemark.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
SEED = 42
SMALL_GROUP = 16
CLUSTER_SETS = 4096
CLUSTER_HASHES = 1 << 22
#: Differing bits of fingerprints: two sets of similarity 0.8 differ in 9.7 of 64 on average, in more than this once in 1e8.
WIDE = 28
PAIRS = 1 << 19  # fingerprints compared at once in a task
BLOCK = 512
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
XOR, ODD = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words; all words of a shorter text are one run; empty without words."""
    words = text.translate(LOWER).split()  # bytes split at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(0, len(words) - shingle) + 1
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), stops)), np.uint64, count))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band of the smallest values under ROWS hash functions each; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(low, ((hashes[at : at + BLOCK] ^ XOR) * ODD).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches, "text"):
        ids, sizes, bands = [], [], []
        for text in texts:
            hashes = shingle_set(text, shingle)
            ids.append(set_id(hashes))
            sizes.append(len(hashes))
            bands.append(band_keys(hashes))
        marks = pa.array(np.array(ids, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([part.column(0), marks, pa.array(sizes, pa.int64()), _longs(bands)], ["doc_id", "set_id", "size", "bands"])


def set_fingerprint(hashes: np.ndarray) -> int:
    """64 bits: a bit is set if more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The sets of the texts that have the set_id given with them, with their clusters."""
    for part, texts in text_slices(batches, "text"):
        found = []
        for wanted, cluster, large, text in zip(*(part.column(i).to_pylist() for i in range(3)), texts):
            hashes = shingle_set(text, shingle)
            if set_id(hashes) == wanted & (1 << 64) - 1:
                found.append((wanted, cluster, large, hashes))
        if found:
            ids, clusters, larges, sets = zip(*found)
            columns = [pa.array(ids, pa.int64()), pa.array(clusters, pa.int64()), pa.array(larges, pa.bool_()), _longs(list(sets))]
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "cluster", "large", "hashes"])


def connected(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[int]:
    """For each set the smallest id that pairs of at least the similarity reach."""
    index = GrayIndex(np.array([set_fingerprint(h) for h in sets], np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    roots = np.arange(len(ids))
    step = max(1, PAIRS // len(ids))

    def find(k: int) -> int:
        while roots[k] != k:
            roots[k] = k = roots[roots[k]]
        return k

    for start in range(0, len(ids), step):
        i, j = index.pairs(start, min(len(ids), start + step), WIDE)
        i, j = index.order[i], index.order[j]
        while (up := roots[roots]).tobytes() != roots.tobytes():
            roots = up
        near = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j])
        keep = near & (roots[i] != roots[j])  # most copies of one text are connected after a few rows
        for a, b in zip(i[keep].tolist(), j[keep].tolist()):
            ra, rb = find(a), find(b)
            if ra == rb:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if common / (sizes[a] + sizes[b] - common) >= similarity:
                roots[max(ra, rb)] = min(ra, rb)
    lows: dict[int, int] = {}
    for k, one in enumerate(ids):
        root = find(k)
        lows[root] = min(lows.get(root, one), one)
    return [lows[find(k)] for k in range(len(ids))]


def _solve(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, set_id): the components of each cluster."""
    ids: list[int] = []
    sets: list[np.ndarray] = []
    current = None

    def solved() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(connected(ids, sets, similarity), pa.int64())], ["node", "root"])

    for batch in batches:
        hashes = batch.column(2)
        for k, (one, cluster) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if cluster != current:
                if ids:
                    yield solved()
                ids, sets, current = [], [], cluster
            if not ids or ids[-1] != one:  # rows that repeat a text are one set
                ids.append(one)
                sets.append(hashes[k].values.to_numpy().view(np.uint64).copy())
    if ids:
        yield solved()


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least the similarity."""
    sides = pairs.join(sets.select(F.col("set_id").alias("u"), F.col("hashes").alias("a")), "u")
    sides = sides.join(sets.select(F.col("set_id").alias("v"), F.col("hashes").alias("b")), "v")
    common = sides.select("u", "v", (F.size("a") + F.size("b")).alias("both"), F.size(F.array_intersect("a", "b")).alias("n"))
    return common.where(F.col("n") / (F.col("both") - F.col("n")) >= similarity).select("u", "v")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after further links (u, v); only what the links touch is solved again."""
    if roots is None:
        return materialize(connected_components(links))
    ends = links
    for end in ("u", "v"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    moved = materialize(connected_components(materialize(ends.where("u <> v"))))
    higher = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(old.unionByName(moved.join(roots, "node", "left_anti")))


def _components(shared: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the sets in ``shared`` (band, set_id, size, cluster) that confirmed pairs connect."""
    # one pair per set to begin with
    heads = shared.where(F.col("set_id") != F.col("cluster")).select(F.col("cluster").alias("u"), F.col("set_id").alias("v")).distinct()
    roots = _joined(None, materialize(confirmed(heads, sets, similarity)))

    def rooted(rows: DataFrame) -> DataFrame:
        named = rows.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
        return materialize(named.select("band", "set_id", "size", F.coalesce("root", "set_id").alias("root")))

    members = rooted(shared)
    slots = 1
    while True:
        groups = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("first"), F.max("root").alias("last"))
        # tables of their own, so that the joins can split a band that very many sets share
        mixed = materialize(groups.where("first <> last").select("band", "n"))
        slot = F.when(F.col("n") <= SMALL_GROUP, F.col("set_id")).otherwise(F.pmod(F.xxhash64("set_id"), F.lit(slots)))
        live = materialize(members.join(mixed, "band").withColumn("slot", slot).drop("n"))
        if not live.take(1):
            return roots
        picked = live.groupBy("band", "slot").agg(
            F.min("set_id").alias("pivot"), F.min_by("size", "set_id").alias("pivot_size"), F.min_by("root", "set_id").alias("pivot_root")
        )
        pivots = materialize(picked.drop("slot"))
        near = F.least("size", "pivot_size") / F.greatest("size", "pivot_size") >= similarity  # else no such similarity is possible
        met = live.join(pivots, "band").where((F.col("root") != F.col("pivot_root")) & near)
        pairs = materialize(met.select(F.least("set_id", "pivot").alias("u"), F.greatest("set_id", "pivot").alias("v")).distinct())
        roots = _joined(roots, materialize(confirmed(pairs, sets, similarity)))
        members = rooted(live.drop("root").join(pivots.select("band", F.col("pivot").alias("set_id")), ["band", "set_id"], "left_anti"))
        slots *= 4


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    cluster_sets: int = CLUSTER_SETS,
    cluster_hashes: int = CLUSTER_HASHES,
) -> DataFrame:
    """One row per input row: doc_id, set_id, component_id.

    Texts whose sets of word shingles have a Jaccard similarity of at least ``similarity``
    are linked, and component_id is the smallest doc_id that links can reach. The bands
    suit similarities of 0.8 and above. A cluster of more than ``cluster_sets`` sets or
    ``cluster_hashes`` shingles is solved by joins instead of in one task. Texts without
    words (null, empty) are equal to each other and to nothing else; very long texts are
    compared whole. Repeated rows are rows of the same component; a null doc_id never names a
    component unless it has no other. Other columns are ignored; an empty table gives no rows.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, set_id long, size long, bands array<long>"
    marked = materialize(given.mapInArrow(functools.partial(_sketches, shingle=shingle), schema))
    # all texts of a set are one from here on
    distinct = materialize(marked.groupBy("set_id").agg(F.min("doc_id").alias("low"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    banded = distinct.select("set_id", "size", F.explode("bands").alias("band"))
    several = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("set_id").alias("first")).where("n > 1").drop("n"))
    shared = banded.join(several, "band")
    edges = shared.where(F.col("set_id") != F.col("first")).select(F.col("set_id").alias("u"), F.col("first").alias("v")).distinct()
    clusters = materialize(connected_components(edges))
    members = distinct.select("set_id", "low", "size").join(clusters, F.col("set_id") == F.col("node")).select("set_id", "low", "size", F.col("root").alias("cluster"))
    sums = members.groupBy("cluster").agg(((F.count(F.lit(1)) > cluster_sets) | (F.sum("size") > cluster_hashes)).alias("large"))
    # a table of its own, so that the join can split a cluster that very many sets are in
    wanted = materialize(members.join(materialize(sums), "cluster").select("set_id", "low", "cluster", "large"))
    texts = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("low"))).select("set_id", "cluster", "large", "text")
    sets = materialize(texts.mapInArrow(functools.partial(_sets, shingle=shingle), "set_id long, cluster long, large boolean, hashes array<long>"))
    dealt = sets.where("NOT large").select("set_id", "cluster", "hashes").repartition("cluster").sortWithinPartitions("cluster", "set_id")
    solved = dealt.mapInArrow(functools.partial(_solve, similarity=similarity), "node long, root long")
    if wanted.where("large").take(1):
        heavy = wanted.where("large").select("set_id", "cluster")
        rest = materialize(shared.drop("first").join(heavy, "set_id").select("band", "set_id", "size", "cluster"))
        solved = solved.unionByName(_components(rest, materialize(sets.where("large").dropDuplicates(["set_id"])), similarity))
    rooted = distinct.join(materialize(solved), F.col("set_id") == F.col("node"), "left").select("set_id", "low", F.coalesce("root", "set_id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # a table of its own, so that the join below can split a set that very many rows share
    by_set = materialize(rooted.join(named, "root").select("set_id", "component_id"))
    return marked.join(by_set, "set_id").select("doc_id", "set_id", "component_id")
