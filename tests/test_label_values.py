"""Label values, predictions and decisions against hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import sequences as S
from sparkwright.operators import label_values as L
from sparkwright.operators import validation
from sparkwright.sources.datasets import split_targets


def values(spark, rows):
    df = spark.createDataFrame([(i, k, None if v is None else json.dumps(v)) for i, (k, v) in enumerate(rows)], "seq int, kind string, value string")
    return df.withColumn("v", F.when(F.col("value").isNotNull(), F.from_json("value", validation.VALUE)))


def test_summaries_and_confidences(spark):
    token = lambda t, c: {"start": 0, "end": 1, "text": "a", "tag": t, "confidence": c}
    long = "word " * 30
    rows = [
        ("classification", {"label": "good"}), ("classification", {"labels": ["a", "b"]}), ("classification", {"labels": []}), ("classification", None),
        ("token", {"tokens": [token("O", 0.5), token("X", 1.0), token(None, None)]}), ("token", {"tokens": []}),
        ("span", {"spans": [{"label": "L", "text": long, "confidence": 0.2}]}), ("span", {"spans": []}),
        ("contrastive", {"pairs": [{"relation": r, "confidence": c} for r, c in (("similar", 1.0), ("other", 0.0), ("similar", 0.5))]}),
    ]
    df = values(spark, rows)
    got = [tuple(r) for r in df.select(L.summary(F.col("v"), F.col("kind")), L.final_confidence(F.col("v"), F.col("kind"), F.when(F.col("seq") == 1, 0.25))).orderBy("seq").collect()]
    assert [s for s, _ in got] == ["good", "a, b", "(none)", "—", "2 tagged / 3 tokens", "0 tagged / 0 tokens", f"L: {long}"[:77] + "…", "(no spans)", "similar×2, other×1"]
    assert [c for _, c in got] == [1.0, 0.25, 1.0, 1.0, 0.75, 1.0, 0.2, 1.0, 0.5]


def test_label_counts_in_order(spark):
    df = values(spark, [("span", {"spans": [{"label": "z"}, {"label": "b"}]}), ("classification", {"labels": ["new", "z"]}), ("classification", {"label": "b"}), ("token", {"tokens": [{"tag": "O"}, {"tag": "a"}]})])
    got = [(r["name"], r["n"]) for r in L.label_counts(df, ["b", "O", "unused", "b"]).orderBy("place").collect()]
    assert got == [("b", 2), ("unused", 0), ("z", 2), ("new", 1), ("a", 1)]
    assert [r["name"] for r in L.label_counts(df.limit(0), ["x"]).collect()] == ["x"]


def test_distributions(spark):
    rows = [("classification", [[0.25, 0.75]], False), ("classification", [[0.25, 0.75]], True), ("contrastive", [[0.5]], False), ("contrastive", [], False), ("token", [[0.5, 0.5], [1.0, 0.0]], True), ("span", None, False)]
    df = spark.createDataFrame(rows, "kind string, probs array<array<double>>, multi boolean")
    d = L.distributions(F.col("kind"), F.col("probs"), F.col("multi"))
    got = [(r[0], round(r[1], 6)) for r in df.select(d, L.mean_uncertainty(d)).collect()]
    assert [g for g, _ in got] == [[[0.25, 0.75]], [[0.75, 0.25], [0.25, 0.75]], [[0.5, 0.5]], [], [[0.5, 0.5], [1.0, 0.0]], []]
    assert [u for _, u in got] == [0.811278, 0.811278, 1.0, 0.0, 0.5, 0.0]


@pytest.mark.parametrize("length", [None, 12])
def test_typed_decisions(spark, length):
    encode = lambda x: F.transform(F.split(x, " "), lambda w: F.char_length(w) + 100)
    df = spark.createDataFrame([(k, "is it", ["aa", "b cc"], 2, "one two three four") for k in ("Binary", "1", "SCORE", "none")], "k string, q string, o array<string>, n int, s string")
    kind = S.decision_kind(F.col("k"))
    t = S.typed_decision(F.col("kind"), F.col("q"), S.decision_options(F.col("kind"), F.col("o"), F.col("n")), F.col("s"), encode, length)
    got = df.select(kind.alias("kind"), "q", "o", "n", "s").withColumn("t", t).collect()
    assert [r["kind"] for r in got] == ["binary", "choice", "score", None]
    state = [103, 103, 105, 104]
    for r, options in zip(got, ([[105], [104]], [[102], [101, 102]], [[101], [101]]), strict=False):
        ids, pos, end = [1, 100 + len(r["kind"]), 102, 102, 2], [], []
        for o in options:
            pos.append(len(ids))
            ids += [15, *o]
            end.append(len(ids))
        ids.append(2)
        room = len(state) if length is None else max(0, length - len(ids) - 1)
        assert (r["t"]["ids"], r["t"]["marker_pos"], r["t"]["marker_end"]) == (ids + state[:room] + [2], pos, end)


def test_split_targets(spark):
    df = spark.createDataFrame([(1.0, 1, 0, 2.0), (float("nan"), 1, 1, 3.0), (2.0, None, 1, 4.0), (3.0, 0, 1, 5.0)], "F0 double, y0 int, y1 int, F1 double")
    assert sorted((r["x"], r["y"]) for r in split_targets(df, "multilabel").collect()) == [([1.0, 2.0], [1, 0]), ([3.0, 5.0], [0, 1])]
    assert sorted((r["x"], r["y"]) for r in split_targets(df, "regression").collect()) == [([1.0, 2.0], 1.0), ([3.0, 5.0], 0.0)]
    with pytest.raises(ValueError):
        split_targets(df.select("F0"), "binary")
