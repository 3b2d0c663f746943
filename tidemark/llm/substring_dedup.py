"""Repeated passages across documents, located by sharded automata of recurring phrases.

A window is 13 consecutive words. Its mark is the smallest hash of its 5-word parts,
so equal windows have equal marks, and neighbouring windows mostly share theirs: a
run of them is a unit of some 17 words. The work goes in three steps.

1. Candidates. Every document sends its distinct marks; those that two documents
   have come back. A task first settles marks that several of its own documents
   hold, so that a passage of a third of all documents travels once per task.
2. Phrases. Units with such a mark are dealt to shards by mark. A shard confirms
   which windows really recur, word by word, compiles them into an Aho-Corasick
   automaton whose letters are words, and streams the units through it, which
   locates every occurrence with the smallest document that holds the phrase.
3. Every document drops the words that located windows of smaller documents cover.

Marks of more than ``HOT_DOCS`` documents would fill one shard. Their windows are
dealt one by one under 128-bit digests, summed up before the shuffle, and joined back.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import text_slices
from tidemark.session import materialize

WINDOW = 13
PART = 5
HOT_DOCS = 200_000
SHARD_UNITS = 20_000
SHARD_BYTES = 1 << 24
#: Words that letters can stand for: all code points but 0 and the surrogates.
LETTERS = 0x10FFFF - 0x800
LAST_ID = 2**63 - 1
STEP = np.uint64(0x9E3779B97F4A7C15)
ODD = 0x100000001B3


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(ODD, -1, 2**64)
    up, down = np.full(n, ODD, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _size(n: int) -> int:
    return 1 << max(10, int(n).bit_length())


def _spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:stop]."""
    up, down = _powers(_size(len(values)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return _mix((total[stops] - total[starts]) * down[starts] + STEP * (stops - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, words per text)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return _spans(data.astype(np.uint64) + np.uint64(1), starts, stops), np.diff(np.searchsorted(starts, bounds), prepend=0)


def units_of(words: np.ndarray, counts: np.ndarray, window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in it, windows, mark) of each run of neighbouring windows with the same mark."""
    n = len(words)
    if n < window:
        none = np.empty(0, np.int64)
        return none, none, none, none
    at = np.arange(n - part + 1)
    parts = _spans(words, at, at + part)
    width = window - part + 1
    low, have = parts, 1
    while have < width:  # smallest of the next `width` parts by doubling
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    owner = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    mark, text = low[whole], owner[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], offset[whole[first]], np.diff(np.append(first, len(whole))), mark[first].view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch], window: int, part: int) -> Iterator[pa.RecordBatch]:
    """Distinct (mark, document) of a slice; a mark of several documents is settled here and goes out once, the rest dealt anywhere."""
    for slice_, texts in text_slices(batches, "text"):
        ids = slice_.column(0).to_numpy()
        text, _, _, mark = units_of(*word_hashes(texts), window, part)
        if not len(text):
            continue
        order = np.lexsort((ids[text], mark))
        mark, doc = mark[order], ids[text][order]
        keep = np.ones(len(mark), bool)
        keep[1:] = (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])
        mark, doc = mark[keep], doc[keep]
        head = np.ones(len(mark), bool)
        head[1:] = mark[1:] != mark[:-1]
        group = np.cumsum(head) - 1
        known = (np.bincount(group) > 1)[group]
        salt = np.where(head, 0, 1 + np.arange(len(mark)) % 1021).astype(np.int16)
        yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(salt), pa.array(doc), pa.array(known)], ["mark", "salt", "doc", "known"])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (mark, salt): those of a mark that has two documents or is known to recur."""
    held = None  # first row of the open group, until the group proves to recur
    last = (None, None)  # the open group
    first_doc, proven = None, False
    for batch in batches:
        mark, salt, doc, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(mark):
            continue
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (salt[1:] != salt[:-1])
        carries = (mark[0], salt[0]) == last
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        firsts = doc[starts]
        sure = np.logical_or.reduceat(known, starts)
        if carries:
            firsts[0], sure[0] = first_doc, sure[0] or proven
        sure |= np.logical_or.reduceat(doc != firsts[group], starts)
        keep = sure[group]
        out_mark, out_doc = mark[keep], doc[keep]
        if carries and held is not None and sure[0]:
            out_mark, out_doc = np.append(out_mark, np.repeat(mark[0], len(held))), np.append(out_doc, held)
        if len(starts) > 1 or not carries:
            held = None
        rest = doc[starts[-1] :]
        # an unproven group has one document only, so one row stands for it
        held = None if sure[-1] else rest[:1] if held is None else held
        last, first_doc, proven = (mark[-1], salt[-1]), firsts[-1], bool(sure[-1])
        if len(out_mark):
            yield pa.RecordBatch.from_arrays([pa.array(out_doc), pa.array(out_mark)], ["doc", "mark"])


def _units(batches: Iterator[pa.RecordBatch], window: int, part: int, hot: bool) -> Iterator[pa.RecordBatch]:
    """Units of candidate marks with their text, or (hot) the digest of each of their windows."""
    for slice_, texts in text_slices(batches, "text"):
        ids, rows = slice_.column(0).to_numpy(), slice_.column(1).to_numpy()
        wanted = [np.sort(np.asarray(w, np.int64)) for w in slice_.column(3).to_numpy(zero_copy_only=False)]
        words, counts = word_hashes(texts)
        text, first, windows, mark = units_of(words, counts, window, part)
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        picks = [a + np.flatnonzero(np.isin(mark[a:b], w)) for w, a, b in zip(wanted, bounds, bounds[1:])]
        pick = np.concatenate(picks) if picks else np.empty(0, np.int64)
        if not len(pick):
            continue
        text, first, windows, mark = text[pick], first[pick], windows[pick], mark[pick]
        if hot:
            base = np.cumsum(counts) - counts
            each = np.repeat(np.arange(len(pick)), windows)
            at = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(windows) - windows, windows)
            digest = _spans(words, base[text[each]] + at, base[text[each]] + at + window).view(np.int64)
            columns = [mark[each], digest, ids[text[each]], rows[text[each]], at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mark", "digest", "doc", "row", "start"])
            continue
        phrases, current, own = [], -1, []
        for t, a, n in zip(text.tolist(), first.tolist(), windows.tolist()):
            if t != current:
                current, own = t, texts[t].split()
            phrases.append(b" ".join(own[a : a + n + window - 1]))
        columns = [pa.array(mark), pa.array(ids[text]), pa.array(rows[text]), pa.array(first.astype(np.int32)), pa.array(phrases, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["mark", "doc", "row", "start", "phrase"])


def locate(units: list[tuple[int, int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """(doc, row, start, stop) of the words that phrases of smaller documents cover, for units (doc, row, start, text) of whole marks."""
    same: dict[bytes, list[int]] = {}
    for k, unit in enumerate(units):
        same.setdefault(unit[3], []).append(k)
    split = [text.split() for text in same]
    letters = {w: k + 1 if k < 0xD7FF else k + 0x801 for k, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(split)))}
    # one letter per word; a shard with more words than there are letters spells with numbers
    plain = len(letters) <= LETTERS
    if plain:
        letters = {w: chr(n) for w, n in letters.items()}
    spelled, lows, often = [], [], []
    owner: dict[str | tuple, int] = {}
    several: set[str | tuple] = set()
    shared: set[str | tuple] = set()  # windows that start more than once in the distinct texts
    for words, members in zip(split, same.values()):
        docs = {units[k][0] for k in members}
        low = min(docs)
        word = "".join([letters[w] for w in words]) if plain else tuple([letters[w] for w in words])
        spelled.append(word)
        lows.append(low)
        often.append(len(docs) > 1)
        for i in range(len(word) - window + 1):
            phrase = word[i : i + window]
            before = owner.get(phrase)
            if before is None:
                owner[phrase] = low
                if often[-1]:
                    several.add(phrase)
                continue
            shared.add(phrase)
            if before != low or often[-1]:
                several.add(phrase)
                owner[phrase] = min(before, low)
    if not several:
        return []
    automaton = ahocorasick.Automaton() if plain else ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase in shared & several:
        automaton.add_word(phrase, (window, owner[phrase]))
    for word, low in itertools.compress(zip(spelled, lows), often):
        # neighbouring windows of this text alone are one phrase: a fifth of the letters
        windows = len(word) - window + 1
        cuts = [i for i in range(windows) if word[i : i + window] in shared] if shared else []
        for a, b in itertools.pairwise((-1, *cuts, windows)):
            if b - a > 1:
                automaton.add_word(word[a + 1 : b - 1 + window], (b - a - 2 + window, low))
    automaton.make_automaton()

    found = []
    for word, low, members in zip(spelled, lows, same.values()):
        hits = [(end - length + 1, end + 1, first) for end, (length, first) in automaton.iter(word)]
        if not hits:
            continue
        later, earlier = _joined(hits), _joined([h for h in hits if h[2] < low])
        for k in members:
            doc, row, start, _ = units[k]
            found += [(doc, row, start + a, start + b) for a, b in (later if doc > low else earlier)]
    return found


def _joined(hits: list[tuple[int, int, int]]) -> list[list[int]]:
    """Spans that overlap or touch, as one."""
    spans: list[list[int]] = []
    for a, b, _ in hits:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return spans


def _locate(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by mark: an automaton for each stretch of whole marks."""

    def shards() -> Iterator[list]:
        shard: list[tuple[int, int, int, bytes]] = []
        last = None
        size = 0
        for batch in batches:
            for mark, *unit in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (len(shard) >= SHARD_UNITS or size >= SHARD_BYTES) and mark != last:
                    yield shard
                    shard, size = [], 0
                shard.append(tuple(unit))
                size += len(unit[3])
                last = mark
        if shard:
            yield shard

    for shard in shards():
        if found := locate(shard, window):
            doc, row, start, stop = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
                ["doc", "row", "start", "stop"],
            )


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of a document and join the words outside them."""
    for slice_, texts in text_slices(batches, "text"):
        n_words, removed, kept_texts = [], [], []
        for text, starts, stops in zip(texts, slice_.column(3).to_pylist(), slice_.column(4).to_pylist()):
            words = text.split()
            merged = _joined(sorted(zip(starts or [], stops or [], itertools.repeat(0))))
            kept, at = [], 0
            for a, b in merged:
                kept += words[at:a]
                at = b
            kept += words[at:]
            n_words.append(len(words))
            removed.append([{"start": a, "stop": b} for a, b in merged])
            kept_texts.append(b" ".join(kept))
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [slice_.column(5), pa.array(n_words, pa.int64()), pa.array(removed, span), pa.array(kept_texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "removed", "kept_text"],
        )


def drop_repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, part: int = PART, hot_docs: int = HOT_DOCS
) -> DataFrame:
    """One row per input row: doc_id, n_words, removed (spans of words), kept_text (kept words joined by one space).

    Words are runs of anything but ASCII white space. A word goes if a window of
    ``window`` consecutive words covers it whose sequence also starts in a document with a
    smaller doc_id, judged on the input. doc_id is a whole number; null counts as larger
    than any other. Rows that repeat a doc_id are one document and never remove from
    each other. Null and empty texts have no words and an empty kept_text. Other
    columns are ignored; an empty table gives no rows.
    """
    given = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(doc_id).alias("doc_id"),
    )
    marks = given.select("doc", "text").mapInArrow(
        functools.partial(_marks, window=window, part=part), "mark long, salt short, doc long, known boolean"
    )
    candidates = materialize(
        marks.repartition("mark", "salt").sortWithinPartitions("mark", "salt").mapInArrow(_recurring, "doc long, mark long")
    )
    hot = materialize(candidates.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_docs).select("mark"))
    any_hot = bool(hot.take(1))

    def units(of: DataFrame, hot: bool, schema: str) -> DataFrame:
        wanted = of.groupBy("doc").agg(F.collect_list("mark").alias("marks"))
        # the same columns as in the last join, so that both use one shuffle of the texts
        joined = given.join(wanted, "doc").select("doc", "row", "text", "marks", "doc_id")
        return joined.mapInArrow(functools.partial(_units, window=window, part=part, hot=hot), schema)

    cold = candidates.join(hot, "mark", "left_anti") if any_hot else candidates
    phrases = units(cold, False, "mark long, doc long, row long, start int, phrase binary")
    spans = (
        phrases.repartition("mark")
        .sortWithinPartitions("mark")
        .mapInArrow(functools.partial(_locate, window=window), "doc long, row long, start int, stop int")
    )
    if any_hot:
        windows = materialize(
            units(candidates.join(hot, "mark", "left_semi"), True, "mark long, digest long, doc long, row long, start int")
        )
        owners = materialize(windows.groupBy("mark", "digest").agg(F.min("doc").alias("owner")))
        later = windows.join(owners, ["mark", "digest"]).where("owner < doc")
        spans = spans.unionByName(later.select("doc", "row", "start", (F.col("start") + window).alias("stop")))
    gathered = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    per_doc = gathered.groupBy("doc").agg(F.collect_list(F.struct("row", "spans")).alias("rows"))
    final = given.join(per_doc, "doc", "left").select(
        "doc", "row", "text", F.filter("rows", lambda r: r["row"] == F.col("row"))[0]["spans"].alias("spans"), "doc_id"
    )
    kind = docs.schema[doc_id].dataType.simpleString()
    return final.select("doc", "row", "text", "spans.start", "spans.stop", "doc_id").mapInArrow(
        _keep, f"doc_id {kind}, n_words long, removed array<struct<start:int,stop:int>>, kept_text string"
    )
