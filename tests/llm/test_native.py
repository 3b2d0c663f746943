"""Operators made of DataFrame functions only: exact and line dedup, URL rules, mixing."""

import hashlib
import re
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.line_dedup import drop_shared_lines, keep_bitmaps
from tidemark.llm.url_filter import judge_urls, rule_table
from tidemark.llm.queries import URL_RULES

DOCS = "doc_id long, text string"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def test_exact_groups(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (5, None), (4, ""), (7, "a b"), (7, "a b"), (None, "a b"), (None, "z"), (9, "c" * 5000), (8, "c" * 4999 + "d")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs_of(spark, rows)).collect()}
    assert got == {
        (3, 1, 5, False), (1, 1, 5, True), (7, 1, 5, False), (None, 1, 5, False),
        (2, 2, 1, True), (5, 4, 2, False), (4, 4, 2, True), (None, None, 1, True), (9, 9, 1, True), (8, 8, 1, True),
    }
    assert exact_duplicates(docs_of(spark, rows)).count() == len(rows)


def test_exact_ignores_clashing_columns_and_takes_empty_tables(spark):
    rows = [(1, "a", 9, "x"), (2, "a", 9, "y")]
    df = docs_of(spark, rows, DOCS + ", length int, digest string")
    assert {(r.doc_id, r.keep_id) for r in exact_duplicates(df).collect()} == {(1, 1), (2, 1)}
    assert exact_duplicates(docs_of(spark, [])).count() == 0


LONG = "This Line is longer than forty code points, it is."


def lines_by_hand(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= min_docs and doc != max(h, key=lambda d: (d is not None, d or 0)) for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def test_lines_match_a_plain_version(spark):
    rows = [(i, f"{LONG}\nshort\n  {LONG.upper()} \nown line {i} that nobody else has, though it is long\n{LONG}") for i in range(5)]
    rows += [(5, LONG), (5, f"x\n{LONG}"), (6, None), (7, ""), (8, "\n\n"), (None, f"{LONG}\nb"), (9, "é" * 40), (10, f"{'é' * 39}\n" * 3)]
    rows += [(20 + i, f"{'é' * 39}\r\n{'é' * 40}\r") for i in range(6)]
    df = docs_of(spark, rows)
    got = sorted((tuple(r) for r in drop_shared_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)
    assert got == lines_by_hand(rows)


def test_bitmaps_are_runs(spark):
    rows = [(i, f"a\n{LONG}\n{LONG}\nb\n{LONG}") for i in range(5)]
    kept = {r["doc"]: [(x["start"], x["length"]) for x in r["keep"]] for r in keep_bitmaps(docs_of(spark, rows)).collect()}
    assert set(kept) == {0, 1, 2, 3}
    assert kept[0][:2] == [(0, 1), (3, 1)] and kept[0][2][0] == 5


def test_lines_of_an_empty_table_and_clashing_columns(spark):
    assert drop_shared_lines(docs_of(spark, [])).count() == 0
    df = docs_of(spark, [(1, "a\nb", "p", 7)], DOCS + ", line string, n_lines int")
    row = drop_shared_lines(df).first()
    assert (row["line"], row["n_lines"], row["n_dropped"], row["kept_text"]) == ("p", 2, 0, "a\nb")


def url_by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_match_a_plain_version(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/",
        "http://example.com/en", "http://notexample.com/en/a", "http://a.b.net/es/", "http://net/fr/", "http://net/fr?x=://y.net/es/",
        "http://x.org/en/", "a://b.net/es/\nq", "http://ex.com?x", "http://ex.net#f", "http://a..com/", "http://com./", "x\n://net/es/1",
        "http://" + "a." * 3000 + "net/es/" + "p/" * 3000,
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, None), (None, "http://net/es/")]
    pages = docs_of(spark, rows, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1))
    got = Counter(tuple(r) for r in judge_urls(pages, rule_table(spark, URL_RULES)).collect())
    assert got == Counter((i, *url_by_hand(u)) for i, u in rows)
    assert judge_urls(pages.limit(0), rule_table(spark, URL_RULES)).count() == 0


def test_rules_tie_break_and_bad_rules(spark):
    rules = rule_table(spark, [("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", None, "/"), ("allow", "", "/"), ("block", "b.com", None)])
    pages = docs_of(spark, [(1, "http://a.com/xy"), (2, "http://b.com/")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules).collect()} == {1: ("a.com/x", "block"), 2: (None, "allow")}
    none = judge_urls(pages, rules.limit(0), default="block").collect()
    assert {r.verdict for r in none} == {"block"}


def targets_by_hand(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        weights = sum(weight[s] for s in free)
        shares = {s: (total - sum(fixed.values())) * weight[s] / weights for s in free}
        over = [s for s in free if shares[s] > 3 * sizes[s]]
        if not over:
            return fixed | shares
        fixed |= {s: 3 * sizes[s] for s in over}


MIXED = "doc_id long, text string, source string"


def mixed_rows(n=400):
    sources = ["hot"] * 6 + ["b", "é", "Z", None, "tiny"]
    return [(i, "w " * (1 + i * 7919 % 97), sources[i % 11] if i % 11 < 10 or i < 12 else "hot") for i in range(n)]


def test_mix_meets_targets_and_is_repeatable(spark):
    df = docs_of(spark, mixed_rows(), MIXED)
    got = mixing.mix(df, shards=3, block_docs=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7), shards=3, block_docs=16).collect()))
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len(mixed_rows()[r.doc_id][1].split()) and r.taken == r["size"] * len(r.shards) and r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = targets_by_hand(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.005 * want[s]) or len([r for r in got if r.source == s]) < 4


def test_copies_of_a_block_go_to_exact_quotas(spark):
    quotas = spark.createDataFrame([("a", 50), ("b", 7), (None, 1), ("c", 0)], "source string, slots long")
    got = mixing.split_quotas(quotas, 5).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r.source] += r.slots
        by_shard[r.shard] += r.slots
    assert by_source == {"a": 50, "b": 7, None: 1}
    assert set(by_shard) == set(range(5)) and max(by_shard.values()) - min(by_shard.values()) <= 2


def test_the_draw_is_hypergeometric(spark):
    n = 4000
    c = lambda x: F.lit(x).cast("long")
    uniform = (F.col("id") + 0.5) / n
    got = dict(spark.range(n).select(mixing._draw(c(30), c(12), c(10), uniform).alias("k")).groupBy("k").count().collect())
    for k in range(11):
        assert abs(got.get(k, 0) / n - comb(12, k) * comb(18, 10 - k) / comb(30, 10)) < 1e-3


def test_mix_of_odd_tables(spark):
    assert mixing.mix(docs_of(spark, [], MIXED)).count() == 0
    rows = [(1, None, None), (2, "", None), (None, "a b", "x"), (3, "a", "y"), (3, "a", "y"), (4, "a b c d e f g", "z")]
    df = docs_of(spark, rows, MIXED).withColumn("size", F.lit(99)).withColumn("block", F.lit("clash"))
    got = mixing.mix(df, shards=3)
    assert got.count() == 6 and got.where("size = 99").count() == 0
    placed = mixing.placements(got)
    assert placed.count() == sum(len(r.shards) for r in got.collect())


def test_queries_give_digests(spark):
    from tidemark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    row = {r.doc_id: r for r in QUERIES["op9_exact_dedup"](spark, folder).collect()}
    text = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 1").first().text
    assert row[1].text_sha256 == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text).encode()).hexdigest()
