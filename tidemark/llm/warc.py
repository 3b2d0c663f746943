"""Web archives: write pages as WARC records, read the archives back, and merge their indexes.

Of records with equal payloads the one with the largest id is a response and the
others revisit it. Records are written by Spark's own text writer, whose line
separator is the pair of line ends that closes a record, so archives can lie in any
store that Spark reaches. Reading back parses each archive by its stated lengths and
checks every digest. An archive's index entries are a run sorted by (url key, time);
runs are cut at common key ranges, and each range merges its runs with a loser tree,
which gives capture histories in one global order.
"""

from __future__ import annotations

import base64
import calendar
import gzip
import hashlib
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, scratch_path

ARCHIVE_BYTES = 16 << 20
ENTRIES_PER_RANGE = 200_000
END = "\r\n"
# Alphabet of base32, and the profile of the WARC standard for equal payloads.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = (
    "run string, url_key string, captured long, id string, record_type string, refers_to string, "
    "payload_bytes long, payload_digest string, offset long, length long"
)


def base32_of(hex_digest: Column) -> Column:
    """Base32 of a SHA-1 digest given in hex: 5 hex digits are 4 letters."""
    chunk = lambda i: F.conv(F.substring(hex_digest, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("long")
    letter = lambda i: F.floor(chunk(i) / F.pow(F.lit(32), 3 - i % 4)) % 32
    return F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(BASE32), (letter(i) + 1).cast("int"), F.lit(1))), ""
    )


def _header_value(c: Column) -> Column:
    """A value that cannot end its header line."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(pages: DataFrame, folder: str, page_id: str, url: str, html: str, captured: Column) -> None:
    """Write one record per row into gzipped WARC files of some ``ARCHIVE_BYTES`` of records under ``folder``."""
    rows = pages.select(
        F.col(page_id).alias("id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
        F.coalesce(captured.cast("long"), F.lit(0)).alias("captured"),
    ).withColumn("digest", F.sha1("payload"))
    # a table of its own, so that the join below can split a digest that very many rows share
    leaders = materialize(
        rows.groupBy("digest").agg(F.max("id").alias("leader"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("payload")).alias("size"))
    )
    totals = leaders.agg(F.sum("n"), F.sum("size")).first()
    per_file = max(1, ARCHIVE_BYTES * (totals[0] or 1) // max(1, (totals[1] or 0) + 600 * (totals[0] or 1)))
    joined = rows.join(leaders.select(F.col("digest").alias("_digest"), "leader"), F.col("digest") == F.col("_digest"))
    revisit = ~F.col("id").eqNullSafe(F.col("leader"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(END * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    when = F.date_format(F.to_utc_timestamp(F.timestamp_seconds("captured"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "), _urn(F.col("id")),
        F.lit(f"{END}WARC-Target-URI: "), _header_value(F.col("url")),
        F.lit(f"{END}WARC-Date: "), when,
        F.lit(f"{END}WARC-Payload-Digest: sha1:"), base32_of(F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Profile: {SAME_PAYLOAD}{END}WARC-Refers-To: "), _urn(F.col("leader")))).otherwise(""),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END * 2), F.col("block"),
    ]
    records = joined.withColumn("block", block).select(F.concat(*fields).alias("value"))
    records.write.option("lineSep", END * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(folder)


def url_key(url: str) -> str:
    """Sort key of a url: host labels from the top level down, then the rest, lower-cased."""
    rest = url.split("://", 1)[-1].lower()
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def records_of(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record; a record that is cut short is an error."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : max(head, at)].split(b"\r\n")
        if head < 0 or not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        headers = {k.strip().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines)}
        stop = head + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at offset {at} does not end where it says")
        yield at, stop + 4 - at, headers, data[head + 4 : stop]
        at = stop + 4


def _epoch(date: str) -> int:
    return calendar.timegm(time.strptime(date, "%Y-%m-%dT%H:%M:%SZ"))


def index_run(name: str, data: bytes) -> list[tuple]:
    """Index entries of an archive, sorted by (url key, time, id); every stored payload is checked against its digest."""
    entries = []
    for offset, length, headers, block in records_of(data):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b":")[2])
        digest = headers["WARC-Payload-Digest"].partition(":")[2]
        kind = headers["WARC-Type"]
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{name}: the payload at offset {offset} does not have its digest")
        own, other = (headers.get(k, "")[len("<urn:page:") : -1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
        key, when = url_key(headers["WARC-Target-URI"]), _epoch(headers["WARC-Date"])
        entries.append((name, key, when, own, kind, other or None, size, digest, offset, length))
    return sorted(entries, key=lambda e: (e[1], e[2], e[3], e[8]))


def _rows(entries: list[tuple]) -> pa.RecordBatch:
    names = [f.strip().split() for f in ENTRY.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    columns = zip(*entries)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            if entries := index_run(batch.column(0)[i].as_py(), gzip.decompress(batch.column(1)[i].as_py())):
                yield _rows(entries)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of all archives in a folder; those of one archive are a sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(folder)
    return files.select("path", "content").mapInArrow(_index, ENTRY)


class LoserTree:
    """Merge of sorted runs: each inner node keeps the loser of its match, so the next winner costs one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = len(runs)
        self.losers = [-1] * max(1, k)
        for run in range(k):
            self._replay(run)

    def _beats(self, a: int, b: int) -> bool:
        """Does run a come before run b? An ended run is last; equal heads go by the run's place."""
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, run: int) -> None:
        node, winner = (run + len(self.runs)) // 2, run
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner  # the other side has not come yet
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[run := self.losers[0]]) is not None:
            yield head
            self.heads[run] = next(self.runs[run], None)
            self._replay(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a key range, as they came from the archives, merged into one order."""
    runs: list[list[tuple]] = []
    last: dict[str, tuple[int, tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key = (row[1], row[2], row[3], row[0], row[8])
            at, before = last.get(row[0], (-1, None))
            if before is None or key < before:  # another archive, or its rows did not come in order
                at = len(runs)
                runs.append([])
            runs[at].append((key, row))
            last[row[0]] = (at, key)
    merged: list[tuple] = []
    for _, row in LoserTree([iter(r) for r in runs]):
        merged.append(row)
        if len(merged) == 10_000:
            yield _rows(merged)
            merged = []
    if merged:
        yield _rows(merged)


def merge_index(entries: DataFrame) -> DataFrame:
    """All entries in the global order (url_key, captured, id): partitions are key ranges, each merged from its runs.

    The ranges are cut by the whole key, so one url with very many captures spans several.
    """
    ranges = max(1, -(-entries.count() // ENTRIES_PER_RANGE))
    return entries.repartitionByRange(ranges, "url_key", "captured", "id", "run", "offset").mapInArrow(_merge, ENTRY)


def archive_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None
) -> DataFrame:
    """Write all rows to archives in the shared folder and return their merged index, one row per input row.

    Columns: page_id, url_key, captured (epoch seconds), record_type, refers_to, payload_bytes,
    payload_digest (bare base32 SHA-1), archive, and offset and length in the
    unpacked archive. A null html is an
    empty payload and counts among equal payloads like any other; a null url is
    empty, a null time is 0. Rows that repeat the largest id of a payload are each
    a response; a null id is smaller than any other. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder, page_id, url, html, F.lit(0) if captured is None else captured)
    index = merge_index(materialize(read_index(spark, folder)))
    kind = pages.schema[page_id].dataType
    as_id = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return index.select(
        as_id("id").alias("page_id"), "url_key", "captured", "record_type", as_id("refers_to").alias("refers_to"),
        "payload_bytes", "payload_digest", F.col("run").alias("archive"), "offset", "length",
    )
