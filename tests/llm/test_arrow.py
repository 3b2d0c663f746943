"""Operators with numpy or automata inside tasks, against plain versions of them."""

import base64
import hashlib
import random
import types

import ahocorasick
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontamination, quality_crf, simhash, substring_dedup, warc
from tidemark.llm.components import connected_components
from tidemark.llm.html_extraction import extract_text, main_text

DOCS = "doc_id long, text string"


# html


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<", "<"), ("<p", ""), ("<p>a", "a"), ("<!-- x", ""),
        ("<script>var a='<p>no</p>'", ""), ("<article>a<article class=comment>b</article></article>", "a"),
        ("<div>" * 2000 + "deep", "deep"),
        ("<body><nav>menu</nav><article><h1>T</h1><p><b>one<br><p>two\n  three</p></article><footer>f</footer>", "T\n\none\n\ntwo three"),
        ("<body><article><p>x &amp; y&quot;<p>&am</article>", 'x & y"\n\n&am'),
        ("<article><p>a</p><aside>side</aside><form>f<input></form><style>p{}</style><div class='cookie-notice'>n</div><ul><li>i<li>j</ul></article>", "a\n\ni\n\nj"),
        ("<article><p title='a > b'>q</p><p hidden>h</p></article>", "q"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_density_finds_the_content_without_an_article_element():
    body = "".join(f"<p>Paragraph {i} of the story goes on for quite some words, with a full stop at its end.</p>" for i in range(4))
    links = "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(30))
    page = f"<html><body class='with-sidebar'><div id=top><ul>{links}</ul></div><div id=story>{body}</div><div class=comments><p>{'Great post! ' * 50}</p></div></body></html>"
    assert main_text(page).split("\n\n") == [f"Paragraph {i} of the story goes on for quite some words, with a full stop at its end." for i in range(4)]


def test_extraction_keeps_every_row(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract_text(df)
    assert sorted((r.page_id or 0, len(r.text)) for r in got.collect()) == [(0, 0), (1, 1), (1, 1), (2, 999_999)]
    assert extract_text(df.limit(0)).count() == 0


# repeated passages


def passages_by_hand(rows, window=13):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out)


def passages(df, **limits):
    n = F.aggregate("removed", F.lit(0), lambda a, s: a + s["stop"] - s["start"])
    return sorted(map(tuple, substring_dedup.drop_repeated_passages(df, **limits).select("doc_id", "n_words", n, "kept_text").collect()))


def passage_rows(seed=3, n=150):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice("abc") if r.random() < 0.97 else r.choice("xyzuvw") for _ in range(r.randint(0, 60)))) for i in range(n)]
    rows += [(1000 + i, "el " * r.randint(0, 300)) for i in range(6)]
    common = " ".join(f"w{i}" for i in range(40))
    rows += [(1100 + i, f"own{i} {common}\tend{i}\n{common}" if i % 3 else common) for i in range(20)]
    return [*rows, (2000, None), (2001, ""), (2002, "caf\u00e9 \u2028 \x1c x")]


@pytest.mark.parametrize("limits", [{}, {"hot_docs": 3}])
def test_passages_match_a_plain_version(spark, limits):
    rows = passage_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("row", F.lit("clash"))
    assert passages(df, **limits) == passages_by_hand(rows)


def test_passages_of_odd_tables(spark):
    assert passages(spark.createDataFrame([], DOCS)) == []
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(5, text), (5, text), (5, "other"), (None, text + " z"), (7, "p " + text)]
    got = substring_dedup.drop_repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept_text) for r in got) == [(0, 21, "z"), (5, 1, "other"), (5, 20, text), (5, 20, text), (7, 21, "p")]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_recurring_marks_do_not_depend_on_batches(size):
    r = random.Random(size)
    rows = sorted({(r.randint(0, 12), r.choice([0, 0, 0, 1, 2]), r.randint(0, 5)) for _ in range(60)})
    rows = [(m, s, d, s > 0 or m == 3) for m, s, d in rows]
    groups = {}
    for m, s, d, known in rows:
        groups.setdefault((m, s), []).append((d, known))
    want = sorted((d, m) for (m, s), g in groups.items() for d, _ in g if any(k for _, k in g) or len({x for x, _ in g}) > 1)
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.int16(), pa.int64(), pa.bool_()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["mark", "salt", "doc", "known"])
    parts = [batch.slice(i, size) for i in range(0, batch.num_rows, size)]
    got = sorted((d, m) for b in substring_dedup._recurring(iter(parts)) for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert got == want


# archives


def test_loser_tree_merges():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted((r.randint(0, 20),) for _ in range(r.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_archives_round_trip(spark):
    rows = [
        (1, "http://a.b/x", "p\r\n\r\nq"), (2, None, None), (3, "x\r\nWARC-Type: y", ""), (None, "u", "p\r\n\r\nq"), (5, "http://a.b/x", "é\x00"),
        (6, "http://a.b/x", "WARC/1.1\r\n\r\n" * 1000), (7, "http://c.b/", "p\r\n\r\nq"), (7, "http://c.b/", "p\r\n\r\nq"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = warc.archive_pages(df, captured=F.col("page_id"))
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        top = max(p for p, _, h in rows if (h or "").encode() == payload and p is not None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page, len(payload), digest, "response" if page == top else "revisit", None if page == top else top))
    found = got.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == sorted(want, key=repr)
    order = [(r.url_key, r.captured, str(r.page_id)) for r in found]
    assert order == sorted(order)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_damaged_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.records_of(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


# benchmark passages


def distances(pattern, text):
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (p != t)))
        before = now
    return before[1:]


def test_bit_parallel_distance():
    r = random.Random(1)
    for _ in range(500):
        p = [r.choice("abc") for _ in range(r.randint(1, 9))]
        t = [r.choice("abc") for _ in range(r.randint(1, 14))]
        assert decontamination.edit_profile(p, t) == distances(p, t)
        d, a, b = decontamination.best_match(p, t, len(p))
        assert d == min(distances(p, t)) and 0 <= a <= b <= len(t)


def test_items_within_the_budget_are_found(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(5, 40)))) for i in range(25)] + [(90, "w1 w2"), (91, None), (None, "q " * 9)]
    docs = []
    for i in range(120):
        body = [r.choice(words) for _ in range(r.randint(0, 40))]
        inner = items[r.randrange(25)][1].split()
        for _ in range(r.randint(0, len(inner) // 3)):
            k = r.randrange(len(inner))
            inner[k : k + 1] = r.choice([[], ["new"], [inner[k], "more"]])
            inner = inner or ["x"]
        docs.append((i, " ".join(body[:20] + inner + body[20:]).upper() + "!"))
    docs += [(500, None), (501, ""), (502, "q " * 9), (502, "q " * 9)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, text in docs:
        for i, item in items:
            p, t = decontamination.words_of(item or ""), decontamination.words_of(text or "")
            if p and t and min(distances(p, t)) <= int(0.2 * len(p)):
                want.append((d, i, min(distances(p, t))))
    got = decontamination.benchmark_matches(df, bench)
    assert sorted((tuple(x) for x in got.select("doc_id", "item_id", "distance").collect()), key=repr) == sorted(want, key=repr)
    cut = decontamination.benchmark_matches(df, bench, block_bytes=700)
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
    assert decontamination.benchmark_matches(df, bench.limit(0)).count() == 0
    assert decontamination.benchmark_matches(df.limit(0), bench).count() == 0


# near duplicates


def components_by_hand(prints, distance=4):
    bits = np.array(prints, np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
    label = np.arange(len(bits))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("n", [1, 2, 17, 300, 1500])
def test_gray_index_links_all_within_the_distance(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**64, max(1, n // 6), dtype=np.uint64)
    flips = [sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(n)]
    bits = np.unique(np.array([int(base[rng.integers(len(base))]) ^ f for f in flips], np.uint64))
    roots = {int(b): int(b) for b in bits}

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for u, v in zip(*simhash.group_links(bits, 4)):
        roots[max(root(int(u)), root(int(v)))] = min(root(int(u)), root(int(v)))
    label = components_by_hand(bits)
    groups = [root(int(b)) for b in bits]
    assert len(set(zip(groups, label))) == len(set(groups)) == len(set(label))


def test_gray_ranks_follow_the_code():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


def test_fingerprint_by_hand():
    for text in ("", "One", "A b c d", "x  y\tz w V u", "le caf\u00e9 est \u00c9t\u00e9 \u2028 ok " * 9):
        words = text.encode().translate(simhash.LOWER).split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode()) == want


@pytest.mark.parametrize("limit", [4096, 8])
def test_near_duplicates_match_a_plain_version(spark, limit, monkeypatch):
    r = random.Random(2)
    rows = []
    for g in range(40):
        base = [f"w{r.randrange(500)}" for _ in range(r.randint(60, 200))]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = "changed"
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2001, "")]
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    label = components_by_hand(prints)
    lows = {k: min(rows[i][0] for i in range(len(rows)) if label[i] == k) for k in set(label)}
    monkeypatch.setattr(simhash.near_links, "__defaults__", (4, limit))
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")))
    assert sorted((x.doc_id, x.component_id) for x in got.collect()) == sorted((d, lows[k]) for (d, _), k in zip(rows, label))
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(200, 260)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[k] for k in [100, *range(200, 260)]} == {100}


# quality


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 4])
    unary, links = rng.normal(size=8), rng.normal(size=(2, 2))
    want, at = [], 0
    for n in counts:
        weight, good = 0.0, np.zeros(n)
        for states in range(2**n):
            path = [states >> k & 1 for k in range(n)]
            score = np.exp(sum(unary[at + k] for k in range(n) if path[k]) + sum(links[a, b] for a, b in zip(path, path[1:])))
            weight += score
            good += score * np.array(path)
        want += (good / weight).tolist()
        at += n
    assert np.allclose(quality_crf.marginals(unary, counts, links), want)


def test_features_count_lines():
    x, weights, counts = quality_crf.line_features([b"", b"a\n\nb c", "\u00e9\u00e9".encode()])
    assert counts.tolist() == [1, 3, 1] and weights.tolist() == [1, 2, 1, 4, 3] and x.shape == (5, quality_crf.WIDTH)


def test_held_out_accuracy_and_odd_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    params = quality_crf.train(docs, labels)
    scored = quality_crf.score_documents(docs, params).join(labels, "doc_id").where(quality_crf.held_out(F.col("doc_id")))
    rows = scored.select((F.col("good") == (F.col("quality") == 1)).alias("right"), "quality", "good").collect()
    assert np.mean([r.right for r in rows]) >= 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "\n" * 5000), (3, "\n")], DOCS).withColumn("score", F.lit("clash"))
    assert all(0 <= r.score <= 1 for r in quality_crf.score_documents(odd, params).collect())
    assert quality_crf.score_documents(odd.limit(0), params).count() == 0
    assert {r.score for r in quality_crf.score_documents(odd, quality_crf.train(docs, labels.limit(0))).where("doc_id < 3").collect()} == {0.5}


def test_windows_of_one_text_alone_are_one_phrase_of_the_automaton(monkeypatch):
    added = []

    class Counting:
        def __init__(self, *kinds):
            self.inner = ahocorasick.Automaton(*kinds)

        def add_word(self, phrase, value):
            added.append(phrase)
            return self.inner.add_word(phrase, value)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(substring_dedup, "ahocorasick", types.SimpleNamespace(**{**vars(ahocorasick), "Automaton": Counting}))
    words = [b"%d" % k for k in range(17)]
    alone, part = b" ".join(words), b" ".join([b"x", *words[4:17]])
    assert substring_dedup.locate([(1, 0, 0, alone), (2, 0, 5, alone)], 13) == [(2, 0, 5, 22)]
    assert [len(phrase) for phrase in added] == [17]  # five phrases of 13 before
    added.clear()
    units = [(1, 0, 0, alone), (2, 0, 5, alone), (3, 0, 0, part), (0, 0, 50, part)]
    assert sorted(substring_dedup.locate(units, 13)) == [(1, 0, 4, 17), (2, 0, 5, 22), (3, 0, 0, 14)]
    assert sorted(len(phrase) for phrase in added) == [13, 13, 16]
