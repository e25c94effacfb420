"""Span corruptions draw once for a stretch of tokens, not anew for every token."""

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import sequences as S


@pytest.mark.parametrize(("name", "fields"), [("span_boundaries", 5), ("infilled_spans", 2)])
def test_draws_are_written_once_for_a_stretch(spark, name, fields):
    ids, key = F.col("ids"), F.col("k")
    c = S.span_boundaries(ids, key, 3, 100) if name == "span_boundaries" else S.infilled_spans(ids, key, 3)
    plan = spark.createDataFrame([(1, [30, 31])], "k int, ids array<int>").select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("xxhash64") <= 4 * fields + 1  # length, place (read for both ends) and kind; one more for the replacing ids


def test_texts_without_room_for_a_span_stay(spark):
    df = spark.createDataFrame([(1, []), (2, [30]), (3, [30, 31]), (4, None)], "k int, ids array<int>")
    for c in (S.span_boundaries(F.col("ids"), F.col("k"), 3, 100), S.infilled_spans(F.col("ids"), F.col("k"), 3)):
        got = {r["k"]: r["c"] for r in df.select("k", c.alias("c")).collect()}
        assert [got[k]["ids"] for k in (1, 2, 3, 4)] == [[], [30], [30, 31], None]
        assert got[3]["labels"] == [-100, -100]


def test_all_fields_of_corrupted_texts_are_given(spark, tmp_path):
    """The query accounts for ids, labels and both boundaries as well as for offsets; plain Python goes through the same arrays."""
    from pyspark.sql import types as T

    from sparkwright.functions.text import tokens
    from sparkwright.plans.sequences import span_boundary

    texts = [(1, " ".join(f"w{i % 97}" for i in range(4000))), (2, "one two"), (3, ""), (4, None), (5, "a " * 300)]
    docs = spark.createDataFrame(texts, T.StructType().add("doc_id", "long").add("text", "string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in span_boundary(spark, str(tmp_path)).collect()}
    ids = S.hash_ids(tokens(F.col("text")), 30000)
    rows = docs.select("doc_id", ids.alias("ids")).withColumn("c", S.span_boundaries(F.col("ids"), F.col("doc_id"), 7, 30000)).collect()
    for r in rows:
        if r["ids"] is None:
            assert all(v is None for k, v in got[r["doc_id"]].items() if k != "doc_id")
            continue
        c = r["c"]
        want = {
            "doc_id": r["doc_id"], "n": len(r["ids"]), "hidden": sum(x > 0 for x in c["offset"]), "spans": sum(x == 1 for x in c["offset"]), "masked": sum(x == 3 for x in c["ids"]),
            "replaced": sum(a != b and b != 3 for a, b in zip(r["ids"], c["ids"], strict=True)), "labelled": sum(x >= 0 for x in c["labels"]), "left": sum(x for x in c["left"] if x >= 0), "right": sum(x for x in c["right"] if x >= 0),
        }
        assert got[r["doc_id"]] == want
    long = got[1]
    assert long["labelled"] == long["hidden"] and 0 < long["replaced"] < long["masked"] < long["hidden"] and 0 < long["left"] < long["right"]


def test_a_token_meets_its_span_once(spark):
    c = S.span_boundaries(F.col("ids"), F.col("k"), 3, 100)
    plan = spark.createDataFrame([(1, [30, 31])], "k int, ids array<int>").select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("xxhash64") <= 5  # the draws aren't written anew for each of the five fields
