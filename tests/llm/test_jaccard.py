"""Near copies of the pipeline against brute-force Jaccard similarity of 5-word shingles."""

import itertools
import random

import pytest

import corpus_pipeline
from tidemark.llm import jaccard, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def smallest_by_hand(rows):
    """The smallest id that pairs of similar texts reach, per id."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if similar(sets[a], sets[b]) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in sets}


def edited(rng, text, share):
    """A contiguous passage replaced, so that about ``share`` of the shingles change."""
    words = text.split()
    n = max(1, int(share * len(words)))
    at = rng.randrange(len(words) - n)
    return " ".join(words[:at] + [f"new{rng.randrange(10**6)}" for _ in range(n)] + words[at + n :])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))) for _ in range(30)]
    texts += [edited(rng, t, share) for t in texts[:25] for share in (0.03, 0.08, 0.1, 0.2)]
    # more copies of one text than a small group has, some of them not similar to each other
    texts += [edited(rng, texts[29], rng.choice((0.02, 0.06, 0.09))) for _ in range(3 * jaccard.SMALL_GROUP)]
    texts += ["", None, "  ", "one two", "One  TWO", "one two three"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(d, texts[k]) for d, k in enumerate(order)]


def test_components_are_those_of_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert found == smallest_by_hand(rows)


def test_large_clusters_have_the_components_of_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limits in ({"cluster_sets": 8}, {"cluster_hashes": 1}):
        found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, **limits).collect()}
        assert found == smallest_by_hand(rows)


def test_wide_distance_holds_similar_sets():
    draw = jaccard.np.random.default_rng(2)
    for size in (5, 20, 200):
        for _ in range(200):
            both = draw.integers(0, 1 << 63, size, jaccard.np.uint64)
            other = draw.integers(0, 1 << 63, size // 9, jaccard.np.uint64)  # the similarity stays above 0.8
            bits = jaccard.set_fingerprint(both) ^ jaccard.set_fingerprint(jaccard.np.concatenate([both, other]))
            assert bits.bit_count() <= jaccard.WIDE


def test_stage_keeps_one_of_similar_texts_that_differ_in_many_bits(spark, rows):
    want = smallest_by_hand(rows)
    bits = {d: simhash.fingerprint((t or "").encode()) for d, t in rows}
    assert sum((bits[d] ^ bits[low]).bit_count() > simhash.DISTANCE for d, low in want.items()) > 20
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_bands_propose_nearly_all_pairs_at_the_bound(rows):
    rng = random.Random(9)
    missed = 0
    for _ in range(300):
        both = [rng.getrandbits(64) for _ in range(100)]
        a, b = (jaccard.np.unique(jaccard.np.array(part, jaccard.np.uint64)) for part in (both[:90], both[10:]))
        missed += not set(jaccard.band_keys(a).tolist()) & set(jaccard.band_keys(b).tolist())
    assert missed == 0
