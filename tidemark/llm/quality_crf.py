"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its own bytes and words and those of the lines before
and after it. A chain with the two states good and bad is fitted on lines of
labelled documents, all of which carry their document's label. Forward-backward
marginals of the good state, weighted by line length, add up to the score.
Scoring is one scan; documents are independent. The fit reads a sample of labelled
documents of a fixed size per label and runs in one task on their features.
"""

from __future__ import annotations

import functools
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import text_slices

SAMPLE_PER_LABEL = 2000
SAMPLE_LINES = 64
SLICE_BYTES = 512 << 10  # texts whose features a task holds at once
THRESHOLD = 0.3
FOLDS = 5
STEPS = 300
RATE = 0.15
PENALTY = 1e-5

OWN = 17
WIDTH = 3 * OWN + 3  # own, before, after; first, last, always

# classes of bytes
UPPER, LOWER, DIGIT, SPACE, STOP, COMMA, BANG, PIPE, SYMBOL, HIGH = range(10)
KIND = np.full(256, SYMBOL, np.uint8)
KIND[128:] = HIGH
for _kind, _bytes in (
    (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (LOWER, b"abcdefghijklmnopqrstuvwxyz"),
    (DIGIT, b"0123456789"),
    (SPACE, b" \t\n\x0b\f\r"),
    (STOP, b".?;:"),
    (COMMA, b",'\"-()"),
    (BANG, b"!"),
    (PIPE, b"|"),
):
    KIND[list(_bytes)] = _kind


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, lines per document) of all lines; a text has one line more than newlines."""
    lines, counts, extra = [], np.empty(len(texts), np.int64), []
    for k, text in enumerate(texts):
        own = text.split(b"\n")
        counts[k] = len(own)
        lines += own
        seen = Counter(own)
        before: set[bytes] = set()
        for line in own:
            words = line.split()
            distinct = set(words)
            n = len(words)
            extra.append(
                (
                    n,
                    1 - len(distinct) / n if n else 0.0,
                    seen[line] > 1 and len(line) >= 20,
                    len(distinct & before) / len(distinct) if n else 0.0,
                    sum(map(operator.eq, words, words[1:])) / n if n else 0.0,
                )
            )
            before = distinct
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"".join(lines), np.uint8)
    kinds = np.bincount(np.repeat(np.arange(len(lines)) * 10, sizes) + KIND[data], minlength=10 * len(lines)).reshape(-1, 10)
    more = np.array(extra, np.float64).reshape(-1, 5)
    size = np.maximum(1, sizes)[:, None]
    share = kinds / size
    letters = np.maximum(1, kinds[:, UPPER] + kinds[:, LOWER])
    own = np.empty((len(lines), OWN))
    own[:, 0] = kinds[:, UPPER] / letters
    own[:, 1] = share[:, DIGIT]
    own[:, 2] = share[:, SPACE]
    own[:, 3] = share[:, HIGH]
    own[:, 4:9] = np.minimum(1, 10 * share[:, [STOP, COMMA, BANG, PIPE, SYMBOL]])
    own[:, 9] = np.minimum(2, sizes / np.maximum(1, more[:, 0]) / 10)
    own[:, 10] = np.log1p(sizes) / 8
    own[:, 11] = more[:, 1]
    own[:, 12] = more[:, 2]
    own[:, 13] = more[:, 3]
    own[:, 14] = sizes < 20
    own[:, 15] = sizes == 0
    own[:, 16] = np.minimum(1, 2 * more[:, 4])
    x = np.zeros((len(lines), WIDTH))
    x[:, :OWN] = own
    ends = np.cumsum(counts)
    first, last = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    first[ends - counts] = True
    last[ends - 1] = True
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[first, OWN : 2 * OWN] = 0
    x[last, 2 * OWN : 3 * OWN] = 0
    x[:, -3], x[:, -2], x[:, -1] = first, last, 1
    continuation = np.bincount(np.repeat(np.arange(len(lines)), sizes), weights=(data & 0xC0) == 0x80, minlength=len(lines))
    return x, sizes - continuation + 1.0, counts


def forward_backward(unary: np.ndarray, counts: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward messages (lines x 2) and log partition per document.

    ``unary`` is the score of good over bad; ``links[i, j]`` that of state i before j. Documents
    advance together, line by line, the longest first.
    """
    ends = np.cumsum(counts)
    order = np.argsort(-counts, kind="stable")
    starts, sizes = (ends - counts)[order], counts[order]
    n = len(unary)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # documents longer than t
    for t, k in enumerate(active):
        at = starts[:k] + t
        if t == 0:
            ahead[at, 1] = unary[at]
        else:
            before = ahead[at - 1]
            ahead[at, 0] = np.logaddexp(before[:, 0] + links[0, 0], before[:, 1] + links[1, 0])
            ahead[at, 1] = unary[at] + np.logaddexp(before[:, 0] + links[0, 1], before[:, 1] + links[1, 1])
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        after = back[at + 1]
        good = unary[at + 1] + after[:, 1]
        back[at, 0] = np.logaddexp(links[0, 0] + after[:, 0], links[0, 1] + good)
        back[at, 1] = np.logaddexp(links[1, 0] + after[:, 0], links[1, 1] + good)
    total = np.logaddexp(ahead[ends - 1, 0], ahead[ends - 1, 1])
    return ahead, back, total


def marginals(unary: np.ndarray, counts: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Probability of the good state of each line."""
    ahead, back, total = forward_backward(unary, counts, links)
    return np.exp(ahead[:, 1] + back[:, 1] - np.repeat(total, counts))


def fit(x: np.ndarray, counts: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights and the four link scores that maximise the likelihood of the documents' line labels (Adam steps)."""
    lines = np.repeat(good, counts).astype(float)
    scale = np.maximum(x.std(axis=0), 1e-3)
    scale[-1] = 1.0
    x = x / scale
    params = np.zeros(WIDTH + 4)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    ends = np.cumsum(counts)
    inner = np.ones(len(x), bool)
    inner[ends - 1] = False
    left = np.flatnonzero(inner)
    observed = np.zeros((2, 2))
    for state in (0, 1):
        observed[state, state] = (lines[left] == state).sum()
    for step in range(1, STEPS + 1):
        unary, links = x @ params[:WIDTH], params[WIDTH:].reshape(2, 2)
        ahead, back, total = forward_backward(unary, counts, links)
        z = np.repeat(total, counts)
        slope = np.empty_like(params)
        slope[:WIDTH] = x.T @ (lines - np.exp(ahead[:, 1] + back[:, 1] - z))
        for i in (0, 1):
            for j in (0, 1):
                pair = ahead[left, i] + links[i, j] + back[left + 1, j] - z[left]
                expected = np.exp(pair + unary[left + 1] if j else pair).sum()
                slope[WIDTH + 2 * i + j] = observed[i, j] - expected
        slope = slope / len(counts) - PENALTY * params
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        params += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    params[:WIDTH] /= scale
    return params


def scores(texts: list[bytes], params: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each text."""
    x, weights, counts = line_features(texts)
    good = marginals(x @ params[:WIDTH], counts, params[WIDTH:].reshape(2, 2))
    owner = np.repeat(np.arange(len(texts)), counts)
    mass = np.bincount(owner, weights=weights, minlength=len(texts))
    return np.clip(np.bincount(owner, weights=good * weights, minlength=len(texts)) / mass, 0.0, 1.0)


def sample_window(text: bytes) -> bytes:
    """The text, or of more than ``SAMPLE_LINES`` lines as many neighbours, from a place that the text's hash chooses."""
    lines = text.split(b"\n")
    if len(lines) <= SAMPLE_LINES:
        return text
    start = xxhash.xxh64_intdigest(text) % (len(lines) - SAMPLE_LINES + 1)
    return b"\n".join(lines[start : start + SAMPLE_LINES])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the labelled documents, a window of the lines of long ones."""
    for part, texts in text_slices(batches, "text", SLICE_BYTES):
        x, _, counts = line_features([sample_window(t) for t in texts])
        parts = np.split(x.astype(np.float32), np.cumsum(counts)[:-1])
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts), pa.array([p.tobytes() for p in parts], pa.binary())], ["good", "n_lines", "x"]
        )


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    good, counts, parts = [], [], []
    for batch in batches:
        good += batch.column(0).to_pylist()
        counts += batch.column(1).to_pylist()
        parts += [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in batch.column(2).to_pylist()]
    if good:
        params = fit(np.concatenate(parts).astype(float), np.array(counts), np.array(good))
        yield pa.RecordBatch.from_arrays([pa.array([params.tolist()], pa.list_(pa.float64()))], ["params"])


def held_out(doc_id: Column) -> Column:
    """Rows that the fit never sees: crc32 of the doc_id as text leaves 0 modulo ``FOLDS``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> list[float]:
    """Weights of the chain, fitted on at most ``SAMPLE_PER_LABEL`` documents of each label.

    The sample holds the documents with the smallest hashes of their ids that are not
    held out. A document of more than ``SAMPLE_LINES`` lines teaches with that many
    neighbouring ones. Ids with both labels, null labels and labels without a document are
    left out; of rows that repeat an id the text that sorts first is taken, null as empty. Other
    columns are ignored. Without any labelled document all weights are 0: every score is 1/2.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = (
        labels.where(~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).alias("good"), F.max(label).alias("high"))
        .where("good = high AND good IN (0, 1) AND doc_id IS NOT NULL")
        .select("doc_id", F.col("good").cast("int").alias("good"))
        .join(given.select("doc_id"), "doc_id", "left_semi")
    )
    picks = [
        known.where(F.col("good") == state).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_LABEL) for state in (0, 1)
    ]
    sample = picks[0].unionByName(picks[1])
    texts = given.join(sample, "doc_id").groupBy("doc_id").agg(F.first("good").alias("good"), F.min("text").alias("text"))
    rows = texts.select("good", "text").mapInArrow(_featurise, "good int, n_lines long, x binary")
    # the order of the sum must not depend on the cluster
    fitted = rows.repartition(1).sortWithinPartitions("good", "n_lines", "x").mapInArrow(_train, "params array<double>").first()
    return fitted["params"] if fitted else [0.0] * (WIDTH + 4)


def _score(batches: Iterator[pa.RecordBatch], params: list[float]) -> Iterator[pa.RecordBatch]:
    weights = np.array(params)
    for part, texts in text_slices(batches, "text", SLICE_BYTES):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(texts, weights))], ["doc_id", "score"])


def score_documents(docs: DataFrame, params: list[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher is better), good (score of ``THRESHOLD`` or more).

    Null is the empty text, which is one empty line and gets a score like any other. All lines
    of a very long text count. Repeated rows are each scored; a null doc_id stays null; other columns are ignored.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    found = given.mapInArrow(functools.partial(_score, params=params), f"doc_id {kind}, score double")
    return found.withColumn("good", F.col("score") >= THRESHOLD)
