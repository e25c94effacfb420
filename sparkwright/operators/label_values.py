"""What is read from label values and model outputs of every kind: confidences, summaries, label counts, distributions.

Values are columns of the struct type in validation.VALUE, kinds are classification, token, span and contrastive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .windows import positions

OUTSIDE = "O"
LONGEST = 80  # code points of a summary of spans


def _items(v: Column, kind: Column, field: dict[str, str]) -> Column:
    """The field of each item of a value, as named for its kind; null for classifications."""
    return F.when(kind == "token", F.transform(v["tokens"], lambda t: t[field["token"]])).when(kind == "span", F.transform(v["spans"], lambda s: s[field["span"]])).when(kind == "contrastive", F.transform(v["pairs"], lambda p: p[field["contrastive"]]))


def final_confidence(v: Column, kind: Column, own: Column) -> Column:
    """Mean of the items' confidences to four places; a label's own (1 if none) where there are no items. Null ones don't count."""
    each = F.filter(_items(v, kind, dict.fromkeys(("token", "span", "contrastive"), "confidence")), lambda c: c.isNotNull())
    mean = F.aggregate(each, F.lit(0.0), lambda a, c: a + c) / F.size(each)
    return F.round(F.when(F.size(each) > 0, mean).otherwise(F.coalesce(own, F.lit(1.0))), 4)


def summary(v: Column, kind: Column) -> Column:
    """A value in a few words: its labels, tagged of all tokens, the spans cut to 80 characters, or relations with their number."""
    name = lambda x: F.coalesce(x, F.lit("None"))
    several = F.array_join(v["labels"], ", ")
    classes = F.when(v["labels"].isNull(), name(v["label"])).otherwise(F.when(several == "", "(none)").otherwise(several))
    tokens = F.coalesce(v["tokens"], F.array().cast("array<struct<start:int,end:int,text:string,tag:string,confidence:double>>"))
    tagged = F.concat(F.size(F.filter(tokens, lambda t: ~t["tag"].eqNullSafe(F.lit(OUTSIDE)))).cast("string"), F.lit(" tagged / "), F.size(tokens).cast("string"), F.lit(" tokens"))
    spans = F.array_join(F.transform(v["spans"], lambda s: F.concat(name(s["label"]), F.lit(": "), F.coalesce(s["text"], F.lit("")))), "; ")
    spans = F.when(F.char_length(spans) > LONGEST, F.concat(F.substring(spans, 1, LONGEST - 3), F.lit("…"))).otherwise(spans)
    spans = F.when(F.coalesce(F.size(v["spans"]), F.lit(0)) > 0, spans).otherwise("(no spans)")
    relations = F.transform(v["pairs"], lambda p: name(p["relation"]))
    counted = F.transform(F.array_distinct(relations), lambda r: F.concat(r, F.lit("×"), F.size(F.filter(relations, lambda x: x == r)).cast("string")))
    text = F.when(kind == "token", tagged).when(kind == "span", spans).when(kind == "contrastive", F.coalesce(F.array_join(counted, ", "), F.lit(""))).otherwise(classes)
    return F.when(v.isNull(), "—").otherwise(text)


def label_counts(current: DataFrame, declared: list[str], order: str = "seq") -> DataFrame:
    """place, name, n: the declared labels as listed, then others as they first occur (by `order`, then item); O is left out.

    current: kind, v and the order column. Labels are counted in each task before the one shuffle by name.
    """
    given = list(dict.fromkeys(x for x in declared if x != OUTSIDE))
    names = F.coalesce(_items(F.col("v"), F.col("kind"), {"token": "tag", "span": "label", "contrastive": "relation"}), F.col("v.labels"), F.array("v.label"))
    rows = current.select(F.col(order).alias("_o"), "kind", F.posexplode(names).alias("_i", "name")).filter(f"name is not null and not (kind = 'token' and name = '{OUTSIDE}')")
    found = rows.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("_o", "_i")).alias("_first"))
    listed = current.sparkSession.createDataFrame([(i, x) for i, x in enumerate(given)], "_at int, name string")
    both = listed.join(found, "name", "full").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_at", F.lit(len(given))).alias("_at"), "_first")
    return positions(both, ["_at", "_first", "name"], "place").select("place", "name", "n")


def distributions(kind: Column, probs: Column, multi: Column) -> Column:
    """array<array<double>>, a probability distribution for each decision a model has to take.

    probs is array<array<double>>: one row of class probabilities for a classification (one for each label where several may
    hold), one row of similarities for candidates, and a row for each token of the other kinds. Where decisions are yes or no,
    each p becomes (1 - p, p).
    """
    apart = F.transform(F.get(probs, F.lit(0)), lambda p: F.array(1 - p, p))
    none = F.array().cast("array<array<double>>")
    return F.when((kind == "contrastive") | ((kind == "classification") & multi), F.coalesce(apart, none)).otherwise(F.coalesce(probs, none))


def mean_uncertainty(rows: Column) -> Column:
    """Mean normalised entropy over a prediction's distributions; 0 without any."""
    total = F.aggregate(F.transform(rows, V.normal_entropy), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(rows) > 0, total / F.size(rows)).otherwise(F.lit(0.0))
