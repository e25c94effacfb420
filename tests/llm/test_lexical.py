"""Ranked search against a plain version: ties, nulls, long texts, many tiles, bands and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkwright.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, id string, n string, item_id string, term string"


def terms(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    """Sorted (item id, rank, doc id, score) by the contract, one document after the other."""
    known = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    count, total = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(t for _, c in known for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in known:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in docs], SCHEMA).repartition(parts)
    q = spark.createDataFrame([(i, t, -1) for i, t in items], "item_id long, text string, doc_id long")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in X.rank_documents(d, q, **more).collect()), key=str)


rng = random.Random(11)
WORDS = ["alpha", "Beta", "GAMMA", "é", "É", "x1", "don't", "日本", "a_b", "zeta"] + [f"w{i}" for i in range(40)]
DOCS = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 40)))) for i in range(120)]
DOCS += [(200, None), (201, ""), (202, " .,;\n"), (None, "alpha beta"), (None, "zeta"), (7, "alpha beta gamma"), (300, "w3 " * 60_000 + "tail")]
DOCS += [(400 + i, "same words in each of these copies w1") for i in range(40)]  # more ties than places
ITEMS = [(1, "Alpha, beta!"), (2, "same copies"), (3, "nothing known here"), (4, None), (5, ""), (6, "w1 w1 w2 W3 é É 日本"), (6, "zeta"), (8, "tail don t"), (9, " ".join(WORDS))]


@pytest.mark.parametrize("more", [{}, {"doc_tile": 7, "bound": 10**8}, {"block_terms": 3}, {"k": 1}, {"k": 1000}])
def test_equals_the_plain_ranking(spark, more):
    assert ranked(spark, DOCS, ITEMS, **more) == plain(DOCS, ITEMS, more.get("k", 10))


def test_ties_whatever_the_partitions(spark):
    want = plain(DOCS, ITEMS)
    assert [r for r in want if r[0] == 2][:2] == [(2, 1, 400, want[[r[0] for r in want].index(2)][3]), (2, 10, 409, want[[r[0] for r in want].index(2)][3])]
    assert ranked(spark, DOCS[::-1], ITEMS, parts=8) == want == ranked(spark, DOCS, ITEMS, parts=1)


def test_empty_tables(spark):
    assert ranked(spark, [], ITEMS) == [] and ranked(spark, DOCS, []) == [] and ranked(spark, [(1, None)], ITEMS) == []


@given(st.text())
def test_terms_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [t.decode() for t in X.terms_of(text.encode())] == terms(text)


@given(st.lists(st.integers(0, 30_000), min_size=1, max_size=60), st.integers(1, 10**12))
def test_bands_cover_all_terms_below_the_bound(weights, bound):
    cuts = X.bands(np.array(weights), bound)
    assert [i for c in cuts for i in range(c.start, c.stop)] == list(range(len(weights)))
    assert all(sum(weights[c]) * X.TOP_IMPACT < bound or c.stop - c.start == 1 for c in cuts)


def test_wide_items_are_cut_into_tiles():
    items = [sorted(rng.sample(range(5000), 50)) for _ in range(300)]
    tiles = X.item_tiles(items, np.ones(5000, np.int64))
    assert sum(m.shape[1] for _, _, m, _ in tiles) == 300 and max(m.shape[1] for _, _, m, _ in tiles) <= X.ITEM_TILE
    assert all((m.sum(axis=0) == 50).all() for _, _, m, _ in tiles)


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 5], np.int64)
    assert X._lengths(n, 10**11, 10**13).tolist() == [10 + 90 * x * 10**11 // 10**13 for x in (10**9, 5)]
