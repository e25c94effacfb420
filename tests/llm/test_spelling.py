"""Spelling groups against a plain version; the gram bounds against every edit of random words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwright.llm import spelling as P

SCHEMA = "doc_id long, text string, id string, word string, n string, key string"


def plain_words(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(docs):
    words, form, near = plain_words(docs), {}, {}
    for w in words:
        near[w] = [x for x in words if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def grouped(spark, docs, parts=3):
    d = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in docs], SCHEMA).repartition(parts)
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in P.spelling_groups(d).collect())


def corpus(seed, size=160):
    rng = random.Random(seed)
    stems = ["".join(rng.choices(["tion", "ment", "ing", "re", "a", "é", "ß", "÷"], k=rng.randint(2, 5))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    def word():
        w = rng.choice(stems)
        if rng.random() < 0.15:
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(["", "x", "a"]) + w[at + rng.randint(0, 1) :]
        return w.upper() if rng.random() < 0.1 else w
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(size)]
    common = [(1000, "beginnings " * 200 + "beginings " * 20 + "begining " * 2 + "beginnings, beginningss beginningss")]
    return docs + common + [(None, "nothingness Nothingness"), (None, None), (7, ""), (7, " \n"), (8, "x" * 60_000 + " " + "x" * 60_000), (9, "don't café-house")]


@pytest.mark.parametrize("heavy", [2048, 4])
def test_equals_the_plain_groups(spark, heavy, monkeypatch):
    monkeypatch.setattr(P.near_words, "__defaults__", (7, P.SAMPLE, heavy))  # 4: many lists go by deletions
    docs = corpus(3)
    want = plain(docs)
    assert grouped(spark, docs) == want == grouped(spark, docs[::-1], 7)
    forms = {w: (f, r) for w, f, r, *_ in want}
    assert forms["begining"] == ("beginings", "beginnings") and sum(bool(f) for f, _ in forms.values()) > 3


def test_empty_tables(spark):
    assert grouped(spark, []) == [] and grouped(spark, [(1, None), (2, "short words only")]) == []


ALPHABET = "abcé"


def edits(w):
    for i in range(len(w) + 1):
        for c in ALPHABET:
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1 :]
        if i < len(w):
            yield w[:i] + w[i + 1 :]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(ALPHABET, min_size=7, max_size=12), min_size=1, max_size=25), st.text(ALPHABET, min_size=7, max_size=12), st.sampled_from([(2, 3), (2, 6), (3, 6), (3, 8)]), st.integers(0, 3))
def test_bounds_hold_for_every_edit(sample, word, lengths, frequent):
    """Grams kept by an edit at the same place from one end are at least those that the bound leaves, and the signatures meet."""
    d = P.GramDictionary(sample, P.padding(7, lengths[1]), *lengths, frequent)
    s = d.padded(word)
    mine = d.decompose(s)
    left = len(mine) - d.affected(s)
    assert left >= 1
    keys = lambda w: {k for a, b, g in d.signature(w) for k in ((a, "<", g), (b, ">", g))}
    own = keys(word)
    for other in set(edits(word)) - {word}:
        t = d.padded(other)
        theirs = d.decompose(t)
        start, end = {(p, g) for p, g in theirs}, {(len(t) - p, g) for p, g in theirs}
        kept = sum((p, g) in start or (len(s) - p, g) in end for p, g in mine)
        assert kept >= left
        if len(other) >= 7:
            assert own & keys(other)


def test_grams_are_longer_where_they_are_frequent():
    d = P.GramDictionary(["nationality", "rationally", "internation", "stationing", "queuexy"] * 3, 3)
    grams = dict((g, p) for p, g in d.decompose(d.padded("nationality")))
    assert any(len(g) == 6 for g in grams) and all(3 <= len(g) <= 6 for g in grams)
    assert all(g[:k] in d.count for g in d.count for k in range(3, len(g)))
