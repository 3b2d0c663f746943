"""Compression of vectors to short codes: one small codebook per part, nearest entries by equal-average search.

By the inequality of Cauchy and Schwarz two vectors of k components whose sums differ
by g are at least g * g / k apart (squared). The search sorts a codebook by component
sum, starts at the entry whose sum is nearest to the part's, and goes outward to the
nearer sum on either side until that bound strictly exceeds the best distance; equal
distances are thus all seen and the lower index wins. All numbers are integers, so the
result does not depend on the order of additions.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components up to this size are computed with 64 bits, larger ones with Python's integers.
PLAIN = 1 << 26
LARGEST = (1 << 63) - 1
LIMB = 40
ROWS = 4096

Codebooks = list[list[list[int]]]  # part, entry, component


class EqualAverageIndex:
    """A codebook in the order of component sums."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]
        self.measured = 0  # distances computed so far

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part; of equally near ones the lowest index."""
        n, width = parts.shape
        count = len(self.sums)
        sums = parts.sum(axis=1)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        index = np.full(n, count)
        best = np.zeros(n, parts.dtype)
        active = np.arange(n)
        while len(active):
            here, lo, hi = sums[active], left[active], right[active]
            gap_left = here - self.sums[np.maximum(lo, 0)]
            gap_right = self.sums[np.minimum(hi, count - 1)] - here
            take_left = (lo >= 0) & ((hi >= count) | (gap_left <= gap_right))
            gap = np.where(take_left, gap_left, gap_right)
            seen = index[active] < count
            going = ((lo >= 0) | (hi < count)) & ~(seen & (gap * gap > best[active] * width).astype(bool))
            active, take_left = active[going], take_left[going]
            if not len(active):
                break
            place = np.where(take_left, left[active], right[active])
            left[active] -= take_left
            right[active] += ~take_left
            entry = self.order[place]
            apart = parts[active] - self.entries[entry]
            distance = (apart * apart).sum(axis=1)
            self.measured += len(active)
            nearer = (index[active] == count) | (distance < best[active]) | ((distance == best[active]) & (entry < index[active]))
            nearer = nearer.astype(bool)
            index[active[nearer]] = entry[nearer]
            best[active[nearer]] = distance[nearer]
        return index, best


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value), exactly: scaling by a power of two does not round."""
    if len(values) and np.abs(values).max() >= 1 << 50:
        return np.array([int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE) for x in values.tolist()], object)
    return np.floor(values * SCALE).astype(np.int64)


def _integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The valid rows and their scaled components as integers, short vectors filled with zeros."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(vectors)), lengths)
    finite = np.isfinite(values)  # nulls became NaN
    valid = np.asarray(vectors.is_valid()) & (np.bincount(owner[~finite], minlength=len(vectors)) == 0)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = valid[owner]
    whole = _whole(values[kept])
    out = np.zeros((len(vectors), width), whole.dtype)
    out[owner[kept], place[kept]] = whole
    rows = np.flatnonzero(valid)
    return rows, out[rows]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The number as signed digits of base 2 ** 40, so that Spark can add up numbers of any size as longs."""
    place = 0
    while True:
        digit = value if abs(value) < 1 << LIMB else value & (1 << LIMB) - 1
        yield place, digit
        value = (value - digit) >> LIMB
        if not value:
            return
        place += 1


def _plain(numbers: np.ndarray) -> np.ndarray:
    """64-bit numbers if squares of differences cannot overflow, else Python's integers."""
    small = not numbers.size or max(abs(int(numbers.max())), abs(int(numbers.min()))) < PLAIN
    return numbers.astype(np.int64) if small else numbers.astype(object)


def _lists(numbers: np.ndarray) -> pa.ListArray:
    n, width = numbers.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(numbers.ravel()))


def _scaled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            keep, numbers = _integers(part.column(2), width)
            rows = pa.array(keep)
            # decimal text keeps what does not fit 64 bits
            plain = numbers.dtype != object
            small = _lists(numbers) if plain else pa.nulls(len(keep), pa.list_(pa.int64()))
            large = pa.array([None] * len(keep) if plain else [",".join(map(str, row)) for row in numbers.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), small, large], ["vec_id", "label", "small", "large"])


def _numbers(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and integer components of slices of rows."""
    names = batch.schema.names
    small, large = batch.column(names.index("small")), batch.column(names.index("large"))
    for at in range(0, batch.num_rows, ROWS):
        some, other = small.slice(at, ROWS), large.slice(at, ROWS)
        if other.null_count == len(other):
            yield at, _plain(some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), width))
        else:
            rows = [a if b is None else [int(x) for x in b.split(",")] for a, b in zip(some.to_pylist(), other.to_pylist())]
            yield at, _plain(np.array(rows, object).reshape(len(rows), width))


def _assigned(numbers: np.ndarray, indexes: list[np.ndarray], parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part: its components, nearest entries and squared distances."""
    width = numbers.shape[1] // parts
    for p, entries in enumerate(indexes):
        piece = numbers[:, p * width : (p + 1) * width]
        dtype = object if object in (piece.dtype, entries.dtype) else np.int64
        yield (piece, *EqualAverageIndex(entries.astype(dtype)).nearest(piece.astype(dtype)))


def _books(codebooks: Codebooks) -> list[np.ndarray]:
    return [_plain(np.array(book, object)) for book in codebooks]


def _sums(batches: Iterator[pa.RecordBatch], codebooks: Codebooks, width: int) -> Iterator[pa.RecordBatch]:
    """One row per part, entry and component of a task: how many parts the entry has, and their sum."""
    books = _books(codebooks)
    shape = (len(books), len(books[0]), width // len(books))
    counts = np.zeros(shape[:2], np.int64)
    sums = np.zeros(shape, object)
    for batch in batches:
        for _, numbers in _numbers(batch, width):
            for p, (piece, index, _) in enumerate(_assigned(numbers, books, len(books))):
                counts[p] += np.bincount(index, minlength=shape[1])
                for entry in np.unique(index).tolist():
                    sums[p, entry] += piece[index == entry].sum(axis=0)
    found = [
        (p, entry, position, place, int(counts[p, entry]), digit)
        for p, entry in np.argwhere(counts).tolist()
        for position, total in enumerate(sums[p, entry].tolist())
        for place, digit in _limbs(int(total))
    ]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["part", "entry", "position", "place", "n", "digit"])


def _encode(batches: Iterator[pa.RecordBatch], codebooks: Codebooks, width: int) -> Iterator[pa.RecordBatch]:
    books = _books(codebooks)
    for batch in batches:
        for at, numbers in _numbers(batch, width):
            error = np.zeros(len(numbers), object)
            code = np.empty((len(numbers), len(books)), "<U2")
            hexes = np.array([f"{i:02x}" for i in range(256)])
            for p, (_, index, distance) in enumerate(_assigned(numbers, books, len(books))):
                code[:, p] = hexes[index]
                error += distance
            errors = np.minimum(error, LARGEST).astype(np.int64)
            some = batch.slice(at, len(numbers))
            codes = pa.array(["".join(row) for row in code.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), codes, pa.array(errors)], ["vec_id", "label", "code", "error"])


def codebooks_digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components in order, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def fit_codebooks(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of rows (vec_id, small, large) of ``width`` components, fitted on all rows; empty for no rows.

    The driver holds the codebooks, parts x entries x components, and sends them with each
    round. A round returns sums per entry from each task, which Spark adds up.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "small", "large").limit(entries)
    rows = [r.small if r.large is None else [int(x) for x in r.large.split(",")] for r in first.select("small", "large").collect()]
    size = width // parts
    codebooks = [[row[p * size : (p + 1) * size] for row in rows] for p in range(parts)]
    if not rows:
        return []
    given = vectors.select("small", "large")
    schema = "part long, entry long, position long, place long, n long, digit long"
    for _ in range(rounds):
        sums = given.mapInArrow(functools.partial(_sums, codebooks=codebooks, width=width), schema)
        # a part's first digit is always there, so its rows count all of the entry's parts
        added = sums.groupBy("part", "entry", "position", "place").agg(F.sum("n").alias("n"), F.sum("digit").alias("digit")).collect()
        totals: dict[tuple, int] = {}
        counts = {}
        for r in added:
            key = (r.part, r.entry, r.position)
            totals[key] = totals.get(key, 0) + (r.digit << LIMB * r.place)
            if r.place == 0:
                counts[key] = r.n
        for (p, entry, position), total in totals.items():
            codebooks[p][entry][position] = total // counts[p, entry, position]
    return codebooks


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """The codes (vec_id, label, code, error) of all kept rows, and the codebooks.

    Rows whose vector is null or has a null or non-finite component are left out. A vector
    shorter than the longest is filled with zeros, and so is the last part where the length
    is no multiple of ``parts``. Codebooks start with the ``entries`` rows of smallest
    vec_id (null last; then by components); repeated rows count as often as they occur. An
    error above the largest long is given as that. An empty table gives no rows and no
    codebooks; other columns are ignored. ``entries`` may be 256 at most.
    """
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    longest = given.where(finite).agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    ids = f"vec_id {given.schema['vec_id'].dataType.simpleString()}, label {given.schema['label'].dataType.simpleString()}"
    scaled = materialize(given.mapInArrow(functools.partial(_scaled, width=width), f"{ids}, small array<long>, large string"))
    codebooks = fit_codebooks(scaled, width, parts, entries, rounds)
    if not codebooks:
        return scaled.select("vec_id", "label", F.col("large").alias("code"), F.lit(0).cast("long").alias("error")), codebooks
    return scaled.mapInArrow(functools.partial(_encode, codebooks=codebooks, width=width), f"{ids}, code string, error long"), codebooks
