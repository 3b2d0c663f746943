"""One query per operator over the whole table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.conversation_repair import digests, find_repairs, repaired_rows
from tidemark.llm.decontamination import benchmark_matches
from tidemark.llm.exact_dedup import equal_groups, marked
from tidemark.llm.html_extraction import extract_text
from tidemark.llm.line_dedup import drop_shared_lines
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.quality_crf import held_out, score_documents, train
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.substring_dedup import drop_repeated_passages
from tidemark.llm.url_filter import judge_urls, rule_table
from tidemark.llm.vector_codes import codebooks_digest, compress
from tidemark.llm.warc import archive_pages
from tidemark.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed values of the contract: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, check: str | None = None) -> Callable:
    def register(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn

    return register


@query(
    "op3_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> s.keeper, false) AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_shared_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op4_url_filter",
    r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, r_host, r_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ranked AS (
  SELECT p.*, r.r_host || r.r_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.r_host || r.r_path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE k = 1
""",
)
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), rule_table(spark, URL_RULES))


@query(
    "op9_exact_dedup",
    r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
""",
)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    groups = equal_groups(docs)
    # the contract wants a digest of every text, also of those that the refinement never had to read
    digests = marked(docs).select("doc_id", F.unhex(F.sha2("content", 256)).alias("digest"))
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return digests.join(groups, "digest", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    params = train(docs, table(spark, folder, "labels"))
    return score_documents(docs, params).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.col("good").cast("int").alias("predicted")
    )


@query(
    "op2_substring_dedup",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, x.i AS i, x.k AS k FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: {'i': i, 'k': array_to_string(ws[i:i + 12], ' ')})) AS x
    FROM w WHERE len(ws) >= 13)),
owners AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM windows JOIN owners USING (k) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (
  SELECT doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (g.pos IS NULL) AS kept
  FROM words LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
""",
)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_repeated_passages(table(spark, folder, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["stop"] - span["start"])
    return kept.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op5_warc_index_merge",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(floor(i / 4) AS INT) * 5 + 1, 5) AS BIGINT) // CAST(power(32, 3 - i % 4) AS BIGINT)) % 32 AS INT) + 1, 1)), '')
    AS payload_digest FROM p),
t AS (SELECT payload_digest, max(page_id) AS top FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM d JOIN t USING (payload_digest)
""",
)
def op5_warc_index_merge(spark: SparkSession, folder: str) -> DataFrame:
    # pages have no capture time: one second a page from the first of 2020, within a year
    when = F.lit(1577836800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31536000))
    index = archive_pages(table(spark, folder, "pages"), captured=when)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_mixing")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by a checksum of conversation and turn a row goes, loses its text or its full stops, comes twice, or becomes the user's."""
    given = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    fate = given.withColumn("fate", F.crc32(key.cast("binary")) % 20).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    return fate.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    rows = damaged(given)
    repairs = materialize(find_repairs(rows))
    hashes = digests(repaired_rows(rows, repairs))
    every = given.select("conv_id").distinct()
    found = every.join(repairs, every["conv_id"].eqNullSafe(repairs["conv_id"]), "left")
    found = found.join(hashes, every["conv_id"].eqNullSafe(hashes["conv_id"]), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return found.select(every["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"), sha)


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and averages as one CTE each."""
    nearest = """
near{r} AS MATERIALIZED (
  SELECT row, part, entry, d FROM (
    SELECT p.row, p.part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
      row_number() OVER (PARTITION BY p.row, p.part ORDER BY d, c.entry) AS k
    FROM pieces p JOIN book{r} c USING (part)) WHERE k = 1)"""
    update = """
sums{r} AS (
  SELECT part, entry, i, sum(x) AS s, count(*) AS n
  FROM (SELECT n.part, n.entry, unnest(p.v) AS x, unnest(range(1, len(p.v) + 1)) AS i FROM near{r} n JOIN pieces p USING (row, part))
  GROUP BY ALL),
means{r} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM sums{r} GROUP BY ALL),
book{q} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN means{r} m USING (part, entry))"""
    steps = "".join("," + nearest.format(r=r) + ("," + update.format(r=r, q=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
    list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, len(embedding) // {parts} AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT row, vec_id, part, v[part * w + 1:(part + 1) * w] AS v FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM pieces WHERE row <= {entries}){steps},
coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY row),
totals AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (row) GROUP BY label),
digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM book{rounds}))
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN kept USING (row) JOIN totals ON totals.label IS NOT DISTINCT FROM kept.label CROSS JOIN digest
"""


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes, codebooks = compress(table(spark, folder, "embeddings"))
    codes = materialize(codes)
    # a table of its own, so that the join can split a label that a third of all rows have
    totals = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    return codes.join(totals, codes["label"].eqNullSafe(totals["label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")
    )


@query("op13_packing")
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
