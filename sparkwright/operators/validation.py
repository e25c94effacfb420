"""Validation of every kind of label against its sample and its task, and the sweep that finds overlapping spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import is_confidence

TOKEN = r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"
VALUE = (
    "label string, labels array<string>, anchor_id string, tokens array<struct<start:int,end:int,text:string,tag:string,confidence:double>>,"
    "spans array<struct<start:int,end:int,text:string,label:string,confidence:double>>, pairs array<struct<sample_id:string,relation:string,confidence:double>>"
)


def _listed(items: Column, what: str, checks: Callable[[Column], list[tuple[Column, str]]]) -> Column:
    """array<string>: 'what j: problem' for each item and each check that is true of it."""
    each = F.transform(items, lambda x, j: F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.concat(F.lit(f"{what} "), j.cast("string"), F.lit(f": {why}"))) for bad, why in checks(x)])))
    return F.coalesce(F.flatten(each), F.array().cast("array<string>"))


def _repeats(items: Column, fields: tuple[str, ...], what: str) -> Column:
    """'what j: duplicate' for each item equal in fields to an earlier one; a sort of the label's own items, not all pairs."""
    keyed = F.array_sort(F.transform(items, lambda x, j: F.struct(*[x[f].alias(f) for f in fields], j.alias("j"))))
    same = lambda a, b: F.struct(*[a[f] for f in fields]).eqNullSafe(F.struct(*[b[f] for f in fields]))
    marked = F.transform(F.array(keyed), lambda k: F.transform(k, lambda x, i: F.when((i > 0) & same(x, F.get(k, i - 1)), F.concat(F.lit(f"{what} "), x["j"].cast("string"), F.lit(": duplicate")))))[0]
    return F.coalesce(F.array_compact(marked), F.array().cast("array<string>"))


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def value_problems(v: Column, kind: Column, multi: Column, labels: Column, text: Column) -> Column:
    """array<string> of what is wrong with a parsed value (VALUE) of a task of this kind: classification, token, span, contrastive.

    Offsets are code points. Overlapping and nested spans are allowed, exact repeats are not.
    """
    some = lambda *xs: F.array_compact(F.array(*xs))
    known = lambda x: F.array_contains(labels, x)
    odd = lambda x: ~is_confidence(x["confidence"])
    unknown = F.array_sort(F.array_except(v["labels"], labels))
    several = some(
        F.when(v["labels"].isNull(), F.lit("no list of labels")), F.when(F.size(unknown) > 0, F.concat(F.lit("unknown labels: "), F.array_join(unknown, " "))),
        F.when(F.size(F.array_distinct(v["labels"])) < F.size(v["labels"]), F.lit("repeated labels")),
    )
    single = some(F.when(~F.coalesce(known(v["label"]), F.lit(False)), F.lit("no label of the task")))
    expected = F.regexp_count(text, F.lit(TOKEN))
    tokens = F.concat(
        some(F.when(F.coalesce(F.size(v["tokens"]), F.lit(0)) <= 0, F.lit("no tokens")).when(F.size(v["tokens"]) != expected, F.concat(F.lit("expected tokens: "), expected.cast("string")))),
        _listed(v["tokens"], "token", lambda t: [(t["start"].isNull() | t["end"].isNull(), "no offsets"), (t["start"].isNotNull() & t["end"].isNotNull() & ~_cut(text, t["start"], t["end"]).eqNullSafe(t["text"]), "other text"), (~known(t["tag"]), "unknown tag"), (odd(t), "confidence")]),
    )

    def span(s: Column) -> list[tuple[Column, str]]:
        there = s["start"].isNotNull() & s["end"].isNotNull()
        inside = (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.char_length(text))
        return [(~there, "no offsets"), (there & ~inside, "out of range"), (there & inside & ~_cut(text, s["start"], s["end"]).eqNullSafe(s["text"]), "other text"), (~known(s["label"]), "unknown label"), (odd(s), "confidence")]

    spans = F.concat(some(F.when(v["spans"].isNull(), F.lit("no list of spans"))), _listed(v["spans"], "span", span), _repeats(v["spans"], ("start", "end", "label"), "span"))
    ids = F.transform(v["pairs"], lambda p: p["sample_id"])
    pairs = F.concat(
        some(F.when(F.coalesce(v["anchor_id"], F.lit("")) == "", F.lit("no anchor")), F.when(F.coalesce(F.size(v["pairs"]), F.lit(0)) <= 0, F.lit("no pairs")), F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("repeated candidates"))),
        _listed(v["pairs"], "pair", lambda p: [(p["sample_id"].eqNullSafe(v["anchor_id"]), "candidate is the anchor"), (~known(p["relation"]), "unknown relation"), (odd(p), "confidence")]),
    )
    return F.when(kind == "token", tokens).when(kind == "span", spans).when(kind == "contrastive", pairs).when(multi, several).otherwise(single)


def integrity(current: DataFrame, samples: DataFrame, tasks: DataFrame, key: str = "sample_id") -> DataFrame:
    """key, task_id, issue: everything that is wrong with current labels (key, task_id, value as JSON, confidence).

    samples: key, text. tasks: task_id, type, multi, labels (array). Labels of unknown samples and tasks give one issue each; all
    others are checked by value_problems(), and their candidates looked up among the samples. Samples meet labels in one
    join by key; candidates travel as ids. Each label's items stay in its row: what a row costs is linear in its items.
    """
    known = samples.select(key, F.coalesce("text", F.lit("")).alias("_text"), F.lit(True).alias("_known"))
    rows = current.select(key, "task_id", "value", "confidence").join(known, key, "left").join(tasks.select("task_id", "type", "multi", F.col("labels").alias("_labels")), "task_id", "left")
    v = F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.from_json("value", VALUE))
    rows = rows.withColumn("v", v)
    checked = F.when(F.col("v").isNull(), F.array(F.lit("value is no object"))).otherwise(value_problems(F.col("v"), F.col("type"), F.coalesce("multi", F.lit(False)), F.col("_labels"), F.col("_text")))
    wrong = F.when(F.col("_known").isNull(), F.array(F.lit("sample not in dataset"))).when(F.col("type").isNull(), F.array(F.lit("unknown task")))
    wrong = wrong.otherwise(F.concat(F.array_compact(F.array(F.when(~is_confidence(F.col("confidence")), F.lit("confidence")))), checked))
    issues = rows.select(key, "task_id", F.explode(wrong).alias("issue"))
    pairs = rows.filter(F.col("_known") & (F.col("type") == "contrastive")).select(key, "task_id", F.explode("v.pairs.sample_id").alias("_candidate"))
    lost = pairs.join(samples.select(F.col(key).alias("_candidate")).distinct(), "_candidate", "left_anti")
    return issues.unionByName(lost.select(key, "task_id", F.concat(F.lit("candidate not in dataset: "), "_candidate").alias("issue")))


def overlapping(spans: DataFrame, item: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """spans with `overlaps`: whether a span begins before an earlier one of its item has ended (in the order of start, end).

    A sweep: the running maximum of the ends before a span tells, so nested spans count however far back the outer one began.
    """
    before = Window.partitionBy(*item).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("overlaps", F.coalesce(F.max(end).over(before) > F.col(start), F.lit(False)))
