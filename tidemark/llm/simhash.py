"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Two fingerprints that differ in at most d bits agree in at least one of d + 1
blocks of bits. That routes each distinct fingerprint to d + 1 groups; a group that
is too large is routed again by blocks of the bits that are still free, so that no
group grows with the data. Inside a task a group is sorted by Gray rank, runs of
neighbours become nodes that hold the bits all their members share, and a search
adds up differences from the upper nodes down and drops whole nodes beyond d.
A group returns one link per fingerprint to the smallest one it reaches, never pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.components import connected_components
from tidemark.llm.text import text_slices
from tidemark.session import materialize

SHINGLE = 4
DISTANCE = 4
SEED = 42
GROUP_LIMIT = 4096
FANOUT = 16
QUERY_BLOCK = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: a bit is set if more than half of the shingle hashes have it; 0 without words."""
    words = text.translate(LOWER).split()  # bytes split at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - shingle)
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[: last + 1].tolist(), stops)), np.uint64, last + 1
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches, "text"):
        values = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; null and wordless texts have 0."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(functools.partial(_fingerprints, shingle=shingle), f"doc_id {kind}, fp long")


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position in Gray order: the number whose reflected Gray code the bits are."""
    rank = bits.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits shared below them.

    A level has for each node the shared bits not yet held above it (mask) and their value.
    """

    def __init__(self, bits: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(bits), kind="stable")
        self.bits = bits[self.order]
        low, high = [self.bits], [self.bits]  # AND and OR of the members of each node
        while len(low[-1]) > FANOUT:
            cuts = np.arange(0, len(low[-1]), FANOUT)
            low.append(np.bitwise_and.reduceat(low[-1], cuts))
            high.append(np.bitwise_or.reduceat(high[-1], cuts))
        held = None
        self.levels = []
        for ands, ors in zip(reversed(low), reversed(high)):
            shared = ~(ands ^ ors)
            mask = shared if held is None else shared & ~np.repeat(held, FANOUT)[: len(shared)]
            self.levels.append((mask, ands & mask))
            held = shared

    def pairs(self, start: int, stop: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (i, j), start <= i < stop and i < j, of fingerprints within the distance."""
        n = stop - start
        top = len(self.levels[0][0])
        query = np.repeat(np.arange(start, stop), top)
        node = np.tile(np.arange(top), n)
        spent = np.zeros(len(query), np.uint8)
        for depth, (mask, value) in enumerate(self.levels):
            spent = spent + np.bitwise_count((self.bits[query] ^ value[node]) & mask[node])
            width = FANOUT ** (len(self.levels) - 1 - depth)  # members of a node
            keep = (spent <= distance) & ((node + 1) * width > query)
            query, node, spent = query[keep], node[keep], spent[keep]
            if depth + 1 < len(self.levels):
                size = len(self.levels[depth + 1][0])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                query, spent = np.repeat(query, FANOUT), np.repeat(spent, FANOUT)
                inside = node < size
                query, node, spent = query[inside], node[inside], spent[inside]
        later = node > query
        return query[later], node[later]


def _merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[k] and b[k] for all k; ``roots`` points every member at its set's smallest position."""
    while len(a):
        ra, rb = roots[a], roots[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := roots[roots]).tobytes() != roots.tobytes():
            roots[:] = up


def group_links(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, representative) that connect whatever is within the distance in a group."""
    index = GrayIndex(bits)
    roots = np.arange(len(bits))
    for start in range(0, len(bits), QUERY_BLOCK):
        _merge(roots, *index.pairs(start, min(len(bits), start + QUERY_BLOCK), distance))
    linked = np.flatnonzero(roots != np.arange(len(bits)))
    return index.bits[linked], index.bits[roots[linked]]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, key): search each group when its last row has come."""
    held: list[np.ndarray] = []
    current = None

    def emit(groups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = [group_links(g, distance) for g in groups if len(g) > 1]
        u = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
        v = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.uint64)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        mask, key, fp = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(fp)]
        done = []
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            if (mask[a], key[a]) != current:
                if held:
                    done.append(np.concatenate(held))
                held, current = [], (mask[a], key[a])
            held.append(fp[a:b].view(np.uint64))
        yield from emit(done)
    if held:
        yield from emit([np.concatenate(held)])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer_masks(mask: int, distance: int) -> list[int]:
    """The mask with each of ``distance`` + 1 blocks of its free bits added: close fingerprints agree under one of them."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // (distance + 1) for i in range(distance + 2)]
    return sorted({mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])})


def near_links(prints: DataFrame, distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect all within ``distance`` differing bits.

    Groups above ``group_limit`` are split by further blocks until all bits are used; none is cut.
    """
    level = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    masks = [0]
    small = []
    while masks:
        finer = F.create_map(
            *[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in finer_masks(m, distance)]))]
        )
        routed = materialize(
            level.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        )
        sizes = routed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit).drop("n")
        large = materialize(sizes)
        masks = [r[0] & (1 << 64) - 1 for r in large.select("mask").distinct().collect()]  # at most 5 a level of refinement and mask
        masks = [m for m in masks if m != (1 << 64) - 1]
        small.append(routed.join(large, ["mask", "key"], "left_anti") if masks else routed)
        if masks:
            level = routed.join(large, ["mask", "key"], "left_semi").select("fp", "mask")
    groups = functools.reduce(DataFrame.unionByName, small)
    dealt = groups.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(functools.partial(_links, distance=distance), "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """One row per input row: doc_id, fp, component_id.

    Fingerprints of ``distance`` or fewer differing bits link their documents, and
    component_id is the smallest doc_id that links can reach. Texts without words
    (null, empty) have fingerprint 0, linked like any other. Repeated rows are rows of
    the same component; a null doc_id is in its component but never names it unless
    it has no other. Other columns are ignored; an empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, doc_id, text, shingle))
    # all copies of a fingerprint are one from here on
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    members = connected_components(materialize(near_links(distinct.select("fp"), distance)))
    rooted = distinct.join(members, distinct["fp"] == members["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # a table of its own, so that the join below can split a fingerprint that very many rows share
    by_print = materialize(rooted.join(named, "root").select("fp", "component_id"))
    return marked.join(by_print, "fp").select("doc_id", "fp", "component_id")
