"""Label validation: every kind of task, every kind of fault; the sweep against all pairs."""

import json
import random

from sparkwright.operators import validation as V

SAMPLES = [("s1", "Don't stop, café!"), ("s2", None)]
TASKS = [("c", "classification", False, ["x", "y"]), ("m", "classification", True, ["x", "y"]), ("t", "token", False, ["B", "O"]), ("s", "span", False, ["P"]), ("p", "contrastive", False, ["same"])]


def issues(spark, rows):
    current = spark.createDataFrame([(s, t, v if isinstance(v, str) or v is None else json.dumps(v), c) for s, t, v, c in rows], "sample_id string, task_id string, value string, confidence double")
    samples = spark.createDataFrame(SAMPLES, "sample_id string, text string")
    tasks = spark.createDataFrame(TASKS, "task_id string, type string, multi boolean, labels array<string>")
    return sorted((r["sample_id"], r["task_id"], r["issue"]) for r in V.integrity(current, samples, tasks).collect())


def one(spark, task, value, confidence=0.5, sample="s1"):
    return [i for *_, i in issues(spark, [(sample, task, value, confidence)])]


def test_dangling_and_malformed(spark):
    assert issues(spark, [("zz", "c", {"label": "x"}, 0.5), ("s1", "zz", {"label": "x"}, 9.0), ("s1", "c", "[1]", 0.5), ("s2", "c", None, None), ("s1", "m", "{bad", 0.5)]) == [
        ("s1", "c", "value is no object"), ("s1", "m", "no list of labels"), ("s1", "zz", "unknown task"), ("s2", "c", "confidence"), ("s2", "c", "value is no object"), ("zz", "c", "sample not in dataset"),
    ]
    assert issues(spark, []) == []


def test_classification(spark):
    assert one(spark, "c", {"label": "x"}) == [] and one(spark, "c", {"label": "z"}) == one(spark, "c", {}) == ["no label of the task"]
    assert one(spark, "m", {"labels": []}) == [] and one(spark, "m", {"labels": ["y", "x"]}, float("nan")) == ["confidence"]
    assert one(spark, "m", {"labels": ["z", "a", "x", "x"]}) == ["repeated labels", "unknown labels: a z"]


def token(start, end, text, tag="O", confidence=1.0):
    return {"start": start, "end": end, "text": text, "tag": tag, "confidence": confidence}


def test_tokens(spark):
    good = [token(0, 5, "Don't", "B"), token(6, 10, "stop"), token(10, 11, ","), token(12, 16, "café"), token(16, 17, "!")]
    assert one(spark, "t", {"tokens": good}) == []
    assert one(spark, "t", {"tokens": []}) == one(spark, "t", {}) == ["no tokens"]
    bad = [token(0, 5, "Dont"), {"text": "x", "tag": "Q", "confidence": 2.0}]
    assert one(spark, "t", {"tokens": bad}) == ["expected tokens: 5", "token 0: other text", "token 1: confidence", "token 1: no offsets", "token 1: unknown tag"]


def span(start, end, text, label="P", confidence=0.0):
    return {"start": start, "end": end, "text": text, "label": label, "confidence": confidence}


def test_spans(spark):
    nested = [span(0, 16, "Don't stop, café"), span(12, 16, "café"), span(0, 5, "Don't")]
    assert one(spark, "s", {"spans": nested}) == [] and one(spark, "s", {"spans": []}) == []
    bad = [span(0, 5, "Don't"), span(3, 3, ""), span(-1, 2, "D"), span(12, 18, "café!"), span(0, 5, "don't", "Q", None), span(0, 5, "Don't"), {"label": "P", "confidence": 1}]
    assert one(spark, "s", {"spans": bad}) == ["span 1: out of range", "span 2: out of range", "span 3: out of range", "span 4: confidence", "span 4: other text", "span 4: unknown label", "span 5: duplicate", "span 6: no offsets"]
    assert one(spark, "s", {}) == ["no list of spans"] and one(spark, "s", {"spans": [span(0, 1, "x")]}, sample="s2") == ["span 0: out of range"]


def test_pairs(spark):
    pair = lambda s, r="same", c=0.5: {"sample_id": s, "relation": r, "confidence": c}
    assert one(spark, "p", {"anchor_id": "s1", "pairs": [pair("s2")]}) == []
    assert one(spark, "p", {}) == ["no anchor", "no pairs"]
    assert one(spark, "p", {"anchor_id": "s1", "pairs": [pair("s1"), pair("s9", "other", 2.0), pair("s9")]}) == [
        "candidate not in dataset: s9", "candidate not in dataset: s9", "pair 0: candidate is the anchor", "pair 1: confidence", "pair 1: unknown relation", "repeated candidates",
    ]


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(f"d{rng.randint(0, 5)}", a := rng.randint(0, 200), a + rng.randint(1, 40), i) for i in range(150)] + [("e", 0, 100, 200), ("e", 5, 6, 201), ("e", 50, 60, 202)]
    got = V.overlapping(spark.createDataFrame(rows, "d string, start int, end int, i int").repartition(3), ["d"]).collect()
    for r in got:
        earlier = [x for x in rows if x[0] == r["d"] and (x[1], x[2]) < (r["start"], r["end"])]
        if not any(x[0] == r["d"] and x[3] != r["i"] and (x[1], x[2]) == (r["start"], r["end"]) for x in rows):  # of equals either may come first
            assert r["overlaps"] == any(x[2] > r["start"] for x in earlier)
    assert len(got) == len(rows)
