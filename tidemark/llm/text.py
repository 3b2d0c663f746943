"""Text helpers that the operators of this package share.

Words are runs of anything but ASCII white space, and only the letters A-Z are
lower-cased, so that every engine agrees on them to the byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SLICE_BYTES = 2 << 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def squeezed(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of record batches whose texts add up to ``limit`` bytes at most (or are one text), with the texts as bytes.

    Keeps the memory of a Python task bounded by the largest text, however many rows a batch has: only the
    texts of one part are copied. Null is empty.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not len(texts):
            continue
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + limit, side="right")) - 1)
            part = texts.slice(start, stop - start).cast(pa.large_binary() if wide else pa.binary())
            yield batch.slice(start, stop - start), [t or b"" for t in part.to_pylist()]
            start = stop
