"""Benchmark passages in documents, up to an edit budget, by pigeonhole pieces and bit-parallel verification.

A test item of m words may be changed by k = floor(rate * m) word edits. It is cut
into k + 1 pieces, at least one of which any copy within the budget holds
unchanged. One automaton finds all pieces in a document; around each hit Myers'
bit-parallel algorithm, with words as letters, computes the distance of the whole
item. Documents are scanned, never shuffled. The benchmark is cut into blocks of a
checked size, and each block is sent to the tasks and matched against all documents.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.text import text_slices
from tidemark.session import materialize

RATE = 0.2
BLOCK_BYTES = 1 << 20
#: Scripts that are written without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORDS = re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; each code point of a script without spaces is a word."""
    return WORDS.findall(text.lower())


def pieces_of(words: list[str], budget: int) -> list[tuple[int, tuple[str, ...]]]:
    """``budget`` + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(words) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, tuple(words[a:b])) for a, b in zip(cuts, cuts[1:])]


def edit_profile(pattern: list[str], text: list[str], anchored: bool = False) -> list[int]:
    """Distance of the pattern to some part of the text that ends at each position (anchored: that starts at 0)."""
    m, full = len(pattern), (1 << len(pattern)) - 1
    top = 1 << (m - 1)
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    plus, minus, score, scores = full, 0, m, []
    for w in text:
        eq = at.get(w, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up = (up << 1) & full | (1 if anchored else 0)
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        scores.append(score)
    return scores


def best_match(pattern: list[str], text: list[str], budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest part of the text, the first of ties; None beyond the budget."""
    scores = edit_profile(pattern, text)
    if not scores or min(scores) > budget:
        return None
    distance = min(scores)
    end = scores.index(distance) + 1
    back = edit_profile(pattern[::-1], text[:end][::-1], anchored=True)
    return distance, end - (back.index(distance) + 1) if distance in back else end, end


class Matcher:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        self.items, where = [], {}
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            budget = int(rate * len(words))
            self.items.append((key, words, budget))
            for offset, piece in pieces_of(words, budget):
                where.setdefault(f" {' '.join(piece)} ", []).append((len(self.items) - 1, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item, distance, budget, start, end) in words, the closest place of each item found."""
        if not self.items:
            return []
        words = words_of(text)
        joined = f" {' '.join(words)} "
        starts = None
        tried: set[tuple[int, int]] = set()
        found: dict[int, tuple[int, int, int]] = {}
        for last, (length, places) in self.automaton.iter(joined):
            if starts is None:
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                starts = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))
            position = int(np.searchsorted(starts, last - length + 2))
            for item, offset in places:
                begin = position - offset
                if (item, begin) in tried:
                    continue
                tried.add((item, begin))
                _, pattern, budget = self.items[item]
                low = max(0, begin - budget)
                hit = best_match(pattern, words[low : max(0, begin + len(pattern) + budget)], budget)
                if hit:
                    place = (hit[0], low + hit[1], low + hit[2])
                    found[item] = min(found.get(item, place), place)
        return [(self.items[i][0], d, self.items[i][2], a, b) for i, (d, a, b) in sorted(found.items())]


def _scan(batches: Iterator[pa.RecordBatch], items: list, rate: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(items, rate)
    for part, texts in text_slices(batches, "text"):
        rows, columns = [], ([], [], [], [], [])
        for i, text in enumerate(texts):
            for hit in matcher.search(text.decode("utf-8", "replace")):
                rows.append(i)
                for column, value in zip(columns, hit):
                    column.append(value)
        if rows:
            arrays = [part.column(0).take(pa.array(rows))] + [pa.array(c, schema.field(k + 1).type) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, distance, budget, start_word, end_word.

    Words are runs of letters and digits, lower-cased; in a script without spaces each code
    point is one. An item is found where a part of the document is within ``rate`` word
    edits per item word, rounded down, so items of a few words are found unchanged only; the closest
    place counts, the first of ties. Equal item texts are searched once. Null items and
    items without a word are not found. Null or empty documents hold nothing; very long ones
    are searched whole; repeated documents and repeated items give repeated rows. Other
    columns are ignored. No item or no document: no rows.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where("item_text IS NOT NULL")
    items = items.withColumn("key", F.sha2("item_text", 256))
    texts = materialize(items.groupBy("key").agg(F.first("item_text").alias("item_text")))
    total = texts.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_kind = given.schema["doc_id"].dataType
    out = f"doc_id {id_kind.simpleString()}, key string, distance int, budget int, start_word int, end_word int"
    schema = pa.schema([("doc_id", to_arrow_type(id_kind)), ("key", pa.string()), *[(n, pa.int32()) for n in ("distance", "budget", "start_word", "end_word")]])
    results = []
    for block in range(blocks):
        here = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect()
        listed = sorted((r.key, r.item_text) for r in here)
        results.append(given.mapInArrow(functools.partial(_scan, items=listed, rate=rate, schema=schema), out))
    found = functools.reduce(DataFrame.unionByName, results)
    return found.join(items.select("key", "item_id"), "key").select("doc_id", "item_id", "distance", "budget", "start_word", "end_word")
