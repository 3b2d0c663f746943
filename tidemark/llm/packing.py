"""Packing documents into token sequences in the order of a space-filling curve.

A document's byte 4-grams are hashed into a vector, a fixed random projection takes
the vector to a few coordinates, and the position of that point on a Hilbert curve is
the document's key. Documents are range-partitioned and sorted by key, so neighbours
in a sequence are alike and every partition is a stretch of the curve. A partition is
then one stream of tokens, cut wherever a sequence is full: no padding. What is left
at the end of a partition, less than one sequence, is cut into sequences whose
lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import array
import functools
import gc
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import text_slices

SEQUENCE = 1024
END = 0
BUCKETS = 256
DIMENSIONS = 4
BITS = 15  # per dimension, so that a key fits a signed long
SEED = 42
GRAM_BLOCK = 1 << 20
TEXT_BLOCK = 1 << 20
SLICE_BYTES = 6 << 20  # texts whose words a task looks up at once
#: Words of a generation whose ids a Python worker remembers; it holds two.
CACHE_WORDS = 300_000
#: Where a text can be cut without changing its tokens: a word and the space before it are never joined to what precedes.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
LINE_BREAK = re.compile(r"(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
LATIN_END = "\u0250"
PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PROJECTION = np.random.default_rng(SEED).choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))


def hashed_vector(text: bytes) -> np.ndarray:
    """Unit vector of the hashed 4-grams of the bytes; zero for texts under four bytes."""
    data = np.frombuffer(text, np.uint8)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(data) - 3, GRAM_BLOCK):
        part = data[at : at + GRAM_BLOCK + 3].astype(np.uint32)
        grams = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
        counts += np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=BUCKETS)
    norm = np.sqrt((counts * counts).sum())
    return counts / norm if norm else counts


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of coordinates, each below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    # undo the rotations and reflections of each level, from the largest cells down
    for level in range(bits - 1, 0, -1):
        cell, below = 1 << level, (1 << level) - 1
        for i in range(n):
            inside = (x[i] & cell) != 0
            swapped = np.where(inside, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(inside, x[0] ^ below, x[0] ^ swapped)
            if i:
                x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity = np.where((x[n - 1] >> level) & 1, parity ^ ((1 << level) - 1), parity)
    x ^= parity
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level) & 1
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert key of each text."""
    vectors = np.array([hashed_vector(t) for t in texts]).reshape(len(texts), BUCKETS)
    # a unit vector's projections lie within the root of BUCKETS on either side of zero
    side = np.sqrt(BUCKETS)
    cells = ((vectors @ _PROJECTION) / side + 1) / 2 * (1 << BITS)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve_keys(texts)), part.column(1)], ["doc_id", "curve", "text"])


def safe_blocks(text: str) -> Iterator[str]:
    """The text in blocks of about ``TEXT_BLOCK`` characters that end at safe cuts, where it has any."""
    start = 0
    while len(text) - start > TEXT_BLOCK and (cut := SAFE_CUT.search(text, start + TEXT_BLOCK)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def split_parts(text: str) -> list[str]:
    """The text cut before every space; safe unless a part is ``unsafe``."""
    first, *rest = text.split(" ")
    return [first, *[" " + word for word in rest]]


def unsafe(parts: set[str]) -> set[str]:
    """Those with white space beside the space at which they were cut: their neighbours may belong to one token."""
    return {part for part in parts if not part or len(part.strip()) != len(part) - (part[0] == " ") or part == " "}


def atoms(part: str) -> list[str]:
    """The part cut further: at line breaks between words, and before stops and commas that end a Latin word."""
    found = []
    for piece in LINE_BREAK.split(part) if "\n" in part else (part,):
        word = piece.rstrip(".,")
        if word and word != piece and word[-1].isalpha() and word[-1] < LATIN_END:
            found += (word, piece[len(word) :])
        else:
            found.append(piece)
    return found


class WordTokens:
    """Token ids of texts as little-endian 32-bit numbers; the ids of words met lately are remembered.

    Tokens are bytes, so their lengths tell where a word's ids end.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        words = self.model.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(words.values()) + 1, np.int64)
        for word, i in words.items():
            self.sizes[i] = len(word)  # a byte-level vocabulary has one character per byte
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text: those of its parts between safe cuts, one after the other."""
        found: list[bytes | None] = []
        held = []
        for text in texts:
            if len(text) > TEXT_BLOCK:
                found.append(b"".join(self._joined([block])[0] for block in safe_blocks(text)))
            else:
                held.append(text)
                found.append(None)
        whole = iter(self._joined(held))
        return [next(whole) if ids is None else ids for ids in found]

    def _joined(self, texts: list[str]) -> list[bytes]:
        parts = [split_parts(text) for text in texts]
        need = set().union(*parts)
        new = self._unknown(need)
        if wide := unsafe(new):
            parts = [p if wide.isdisjoint(p) else SAFE_CUT.split(text) for p, text in zip(parts, texts)]
            need = set().union(*parts)
            new = self._unknown(need)
        cut = {part: pieces for part in new if part and (part[-1] in ".," or "\n" in part) and len(pieces := atoms(part)) > 1}
        self._learn(new.difference(cut) | self._unknown(set().union(*cut.values())))
        for part, pieces in cut.items():
            self.known[part] = b"".join(map(self.known.__getitem__, pieces))
        joined = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        if len(self.known) > CACHE_WORDS:
            self.older = {part: ids for part, ids in self.known.items() if len(part) <= 64}
            self.known = {}
        return joined

    def _unknown(self, need: set[str]) -> set[str]:
        """Those without ids; those met a generation ago are among the known ones again."""
        new = need - self.known.keys()
        if again := new & self.older.keys():
            self.known.update(zip(again, map(self.older.__getitem__, again)))
            new -= again
        return new

    def _learn(self, new: set[str]) -> None:
        """Add the ids of these parts. Parts that begin with a space are encoded together: cuts before them are safe."""
        odd = unsafe(new)
        spaced = [part for part in new if part[:1] == " " and part not in odd]
        for at in range(0, len(spaced), 1024):
            some = spaced[at : at + 1024]
            (encoded,) = self.model.encode_batch_fast(["".join(some)], add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            ends = np.cumsum([len(part.encode()) for part in some])
            cuts = 4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)
            data, start = ids.tobytes(), 0
            for part, stop in zip(some, cuts.tolist()):
                self.known[part] = data[start:stop]
                start = stop
        others = list(new.difference(spaced))
        for part, encoded in zip(others, self.model.encode_batch_fast(others, add_special_tokens=False)):
            self.known[part] = array.array("I", encoded.ids).tobytes()


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class Packer:
    """Cuts a stream of documents into sequences; ``rows`` are the finished pieces, with their ids or without."""

    def __init__(self, length: int, first_id: int, with_ids: bool) -> None:
        self.length, self.next_id, self.with_ids = length, first_id, with_ids
        self.open: list[tuple] = []  # pieces (doc_id, start, ids, doc_tokens) of the sequence that is not full yet
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        while start < total:
            size = min(total - start, self.length - self.filled)
            self.open.append((doc_id, start, ids[4 * start : 4 * (start + size)], total))
            start += size
            self.filled += size
            if self.filled == self.length:
                self._close([self.length])

    def _close(self, lengths: list[int]) -> None:
        """Give the open pieces to sequences of these lengths, cut where one ends."""
        pieces = iter(self.open)
        piece = None
        for length in lengths:
            offset = 0
            while offset < length:
                doc_id, start, ids, total = piece or next(pieces)
                size = min(len(ids) // 4, length - offset)
                here = ids[: 4 * size]
                row = (doc_id, start, size, zlib.crc32(here), total, self.next_id, offset)
                self.rows.append((*row, here) if self.with_ids else row)
                offset += size
                piece = (doc_id, start + size, ids[4 * size :], total) if 4 * size < len(ids) else None
            self.next_id += 1
        self.open, self.filled = [], 0

    def finish(self) -> None:
        self._close(_powers(self.filled))


def _pack(
    batches: Iterator[pa.RecordBatch], path: str, length: int, end: int, kind: pa.DataType, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    types = [kind, *[pa.int64()] * 6, pa.binary()][: 8 if with_ids else 7]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(types)]
    packer = Packer(length, TaskContext.get().partitionId() << 40, with_ids)
    tokens = _tokens(path)
    last = np.array([end], "<u4").tobytes()
    gc.disable()  # strings and bytes make no cycles, and going through millions of them takes a tenth of the time

    def ready() -> pa.RecordBatch:
        columns = zip(*packer.rows)
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)
        packer.rows = []
        return batch

    for part, texts in text_slices(batches, "text", SLICE_BYTES):
        for doc_id, ids in zip(part.column(0).to_pylist(), tokens.ids([t.decode() for t in texts])):
            packer.add(doc_id, ids + last)
            if len(packer.rows) >= 4096:
                yield ready()
    packer.finish()
    gc.enable()
    if packer.rows:
        yield ready()


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = SEQUENCE, end: int = END, with_ids: bool = True
) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    ``tokenizer`` is the path of a byte-level tokenizer file on every executor; ``end`` is the
    id that closes each document; ``ids`` holds the ids of a piece as little-endian 32-bit
    numbers. Sequences hold ``length`` ids; the last ones of a partition hold a power of
    two. A null or empty text is the closing id alone, and a very long text goes through
    as many sequences as it needs, tokenized between safe cuts. Rows with a repeated or
    null doc_id are documents of their own; equal keys are ordered by doc_id (null
    first) and text hash. An empty table gives no pieces; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType
    keyed = given.mapInArrow(_keyed, f"doc_id {kind.simpleString()}, curve long, text string")
    # the hash parts rows of one key and id, so that a third of all rows in one cell are still many ranges
    keys = [F.col("curve"), F.col("doc_id"), F.xxhash64("text")]
    along = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pieces = functools.partial(_pack, path=tokenizer, length=length, end=end, kind=to_arrow_type(kind), with_ids=with_ids)
    return along.mapInArrow(pieces, PIECE.format(kind=kind.simpleString()) + (", ids binary" if with_ids else ""))
