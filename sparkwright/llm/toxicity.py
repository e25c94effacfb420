"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, materialise, text_of

#: Insults that count in any language's text.
SEED_WORDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool fools imbecile cretin jerk bastard scumbag filth filthy vermin retard retarded ugly hateful crap bitch whore slut shit fuck fucking asshole arschloch idioten dumm scheisse abschaum dreck salaud connard idiote imbécile débile ordure merde idiota estúpido estúpida imbécil basura mierda pendejo".split())
#: Words that address the reader.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes tus".split())
#: Characters written for letters.
LOOKALIKE = str.maketrans("013457@$!|+", "oleastasiit")

HIT, LEARNED, STEM, YOU, CAPS, MASKED, MASKED_HIT, DRAWN = (1 << i for i in range(8))
FEATURES = ["log_words", "seed_density", "learned_density", "stem_density", "hits", "kinds", "near_you", "you_density", "upper_share", "caps_density", "exclaim_rate", "question_rate", "punct_rate", "symbol_rate", "digit_rate", "masked_density", "masked_hits", "drawn_density"]
STEMS = (4, 5, 6)
REACH = 5  # words between an insult and a second person
KNOWN_WORDS = 100_000  # words a task remembers before it begins anew; bounds memory, not results
SLICE = 1000  # texts that a task holds apart from their batch at a time

_EDGE = re.compile(r"^\W+|\W+$")
_MASK = re.compile(r"[^\W\d_][\d@$!|+*#%&]+[^\W\d_]")
_DRAWN = re.compile(r"(\w)\1\1")


def _bare(token: str) -> str:
    return _EDGE.sub("", token)


def stems_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a trailing hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


class _Flags(dict):
    """token -> flags, worked out when a token is first seen."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.words = frozenset(x for x in lexicon if not x.endswith("-"))
        self.stems = frozenset(x[:-1] for x in lexicon if x.endswith("-"))

    def __missing__(self, token: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        word = _bare(token)
        low = word.lower()
        flags = 0
        if low in SEED_WORDS:
            flags |= HIT
        if low in self.words:
            flags |= LEARNED
        if any(low[:n] in self.stems for n in STEMS if len(low) > n):
            flags |= STEM
        if low in SECOND_PERSON:
            flags |= YOU
        if len(word) > 1 and word.isupper():
            flags |= CAPS
        if _MASK.search(token):
            flags |= MASKED
            plain = low.translate(LOOKALIKE)
            if plain != low and (plain in SEED_WORDS or plain in self.words):
                flags |= MASKED_HIT
        if _DRAWN.search(low):
            flags |= DRAWN
        self[token] = flags
        return flags


def _table(*chars: str) -> np.ndarray:
    out = np.zeros((256, len(chars)))
    for i, c in enumerate(chars):
        out[list(c.encode()), i] = 1
    return out


_CLASSES = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!", "?", ".,;:'\"()-", "@#$%&*^~|<>=+_", "0123456789")


def features_of(text: bytes, flags: _Flags) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES."""
    upper, exclaim, question, punct, symbol, digit = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    tokens = text.decode().split()
    n = len(tokens)
    f = np.fromiter(map(flags.__getitem__, tokens), np.uint8, n)
    count = lambda bits: int(np.count_nonzero(f & bits))
    hit = np.flatnonzero(f & (HIT | LEARNED | STEM | MASKED_HIT))
    you = np.flatnonzero(f & YOU)
    near = 0
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(hit - you[np.minimum(at, len(you) - 1)]), np.abs(hit - you[np.maximum(at - 1, 0)]))
        near = int((gap <= REACH).sum())
    kinds = len({_bare(tokens[i]).lower() for i in hit.tolist()})
    per, size = 100.0 / max(n, 1), 100.0 / max(len(text), 1)
    return [math.log1p(n), count(HIT) * per, count(LEARNED) * per, count(STEM) * per, float(len(hit)), float(kinds), near * per, len(you) * per, upper * size, count(CAPS) * per, exclaim * size, question * size, punct * size, symbol * size, digit * size, count(MASKED) * per, float(count(MASKED_HIT)), count(DRAWN) * per]


def text_features(docs: DataFrame, lexicon: list[str], keep: list[str]) -> DataFrame:
    """docs(keep..., text) -> keep... and one double for each of FEATURES. The lexicon is bounded (learn_lexicon)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    words = frozenset(lexicon)

    def compute(batches):
        flags = _Flags(words)
        for b in (batch.slice(lo, SLICE) for batch in batches for lo in range(0, batch.num_rows, SLICE)):
            x = np.array([features_of(t, flags) for t in b.column("text").cast(pa.binary()).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(x[:, i]) for i in range(x.shape[1])]], names=[*keep, *FEATURES])
        flags.clear()
        give_back()

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], *[f"{c} double" for c in FEATURES]])
    return docs.select(*keep, "text").mapInArrow(compute, schema)


def learn_lexicon(sample: DataFrame, most: int = 400, support: int = 3, least_odds: float = 6.0, least_gain: float = 9.0) -> list[str]:
    """Words and word beginnings that mark toxic texts of sample(text, label): at most `most`, by their G statistic.

    Each counts once for a text; at least `support` toxic texts hold it, its odds of standing in a toxic text are
    `least_odds` times those of a clean one, and its gain (in nats) exceeds what the best of e^least_gain terms reaches by chance.
    """

    def count(batches):
        bad, good = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                found = {s for t in set(text.lower().split()) if len(w := _bare(t)) > 2 for s in stems_of(w)}
                (bad if y else good).update(found)
        terms = list(bad)  # terms of clean texts alone can't pass
        rest = [t for t in good if t not in bad]
        for part in (terms, rest):
            for lo in range(0, len(part), 50_000):
                some = part[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([bad[t] for t in some], pa.int64()), pa.array([good[t] for t in some], pa.int64())], names=["term", "bad", "good"])

    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    nb, ng = totals.get(1, 0), totals.get(0, 0)
    if not nb or not ng:
        return []
    c = sample.select("text", "label").mapInArrow(count, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") >= support)
    pb, pg = (F.col("bad") + 0.5) / (nb + 1.0), (F.col("good") + 0.5) / (ng + 1.0)
    odds = (pb / (1 - pb)) / (pg / (1 - pg))
    gain = F.col("bad") * F.log(pb / ((F.col("bad") + F.col("good") + 1.0) / (nb + ng + 2.0)))
    best = c.filter((odds >= least_odds) & (gain >= least_gain)).orderBy(gain.desc(), "term").limit(most)
    return [r["term"] for r in best.collect()]


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000, trees: int = 20, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", carry_text_hash: bool = False) -> DataFrame:
    """One row for each document: id, held_out, score (0 to 1), predicted; th and th2, two hashes of its text, if asked for.

    Labels are learned only from rows whose crc32(id as text) mod 5 is not 0, on at most `sample_rows` of them, chosen by a hash of
    the id: remainders 1 and 2 give the lexicon, 3 the trees, 4 the isotonic calibration, so that no step learns from texts the
    step before has seen. Every document is scored on its whole text; id, labels, language and source never enter a score.

    Null and empty texts get the score of their (zero) features. Null labels are ignored, of several labels of a
    document the larger counts. Without rows of both classes in every part, one split serves all steps; without rows of
    both classes at all, the score is the share of toxic labels (0 without any). Rows that repeat an id are scored on
    their own; columns of docs other than id and text are not read. An empty table gives an empty result.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold != 0)).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = materialise(known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows), "toxic-chosen")
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    ths = ["th", "th2"] if carry_text_hash else []
    if ths:
        rows = rows.withColumn("th", F.xxhash64("text")).withColumn("th2", F.xxhash64(F.lit(1), "text"))
    sample = materialise(rows.join(F.broadcast(chosen), id_col).withColumn("fold", fold).select("text", "label", "fold"), "toxic-sample")  # at most sample_rows rows
    held = F.when(fold == 0, True).otherwise(False).alias("held_out")
    seen = {(r["fold"], r["label"]): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    both = lambda folds: all(sum(seen.get((f, y), 0) for f in folds) >= 2 for y in (0, 1))
    words, grow, fit = ((1, 2), (3,), (4,)) if all(map(both, ((1, 2), (3,), (4,)))) else ((1, 2, 3, 4),) * 3
    if not both(grow):
        total, bad = sum(seen.values()), sum(n for (_, y), n in seen.items() if y == 1)
        share = bad / total if total else 0.0
        return rows.select(id_col, held, F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"), *ths)

    lexicon = learn_lexicon(sample.filter(F.col("fold").isin(*words)))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = materialise(text_features(sample.filter(F.col("fold").isin(*grow, *fit)), lexicon, ["label", "fold"]), "toxic-train")
    train = assemble.transform(train.coalesce(2))
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=5, minInstancesPerNode=2).fit(train.filter(F.col("fold").isin(*grow)))
    raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1])
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw(train.filter(F.col("fold").isin(*fit))).select("raw", F.col("label").cast("double")))
    scored = text_features(rows, lexicon, [id_col, *ths])
    scored = curve.transform(raw(assemble.transform(scored)).select(id_col, "raw", *ths))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select(id_col, held, score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), *ths)
