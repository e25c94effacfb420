"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_uneven, materialise, running, small, text_of, words_in

BITS = 48
LEVEL = 12


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """Add `target` to (key, source, source_size): weights in the order of the sources' names, null last, repeating.

    The budget is share times all sizes. No target exceeds repeats times its source's size; what is cut off
    goes to the other sources by weight until none is above. That is min(cap, level * weight), where the level
    follows from the sources in the order of cap / weight. The table has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(repeats))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - capped) / rest)
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    return s.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).drop("level", "cap")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def number_repeats(rows: DataFrame, name: str, keys: tuple[str, ...] = ("id", "source", "digest")) -> DataFrame:
    """Add `occurrence`: the number (from 0) of a row among those equal in `keys`, null counting as a value.

    Only rows that have equals are shuffled whole, by a range sort that cuts even one huge group over all tasks.
    """
    mark, out = F.to_json(F.struct(*[F.col(k).cast("string").alias(str(i)) for i, k in enumerate(keys)])), rows.columns
    marked = rows.withColumns({"_of": F.xxhash64(mark), "_of2": F.xxhash64(F.lit(1), mark)})
    again = materialise(marked.groupBy("_of", "_of2").agg(F.count("*").alias("_n")).filter("_n > 1"), f"{name}-again")
    if again.isEmpty():
        return rows.withColumn("occurrence", F.lit(0).cast("long"))
    many = join_uneven(marked, again, ["_of", "_of2"], "_n").select(*out, F.concat_ws(":", "_of", "_of2").alias("_group"), F.monotonically_increasing_id().alias("_row"), F.lit(1).alias("_one"))
    # the row number is stored before the range sort, so that sampling and sorting see the same one
    placed = running(materialise(many, f"{name}-repeats"), "_group", ["_row"], "_one", f"{name}-numbers")
    single = marked.join(small(again), ["_of", "_of2"], "left_anti")
    return single.select(*out, F.lit(0).cast("long").alias("occurrence")).unionByName(placed.select(*out, F.col("rank").alias("occurrence")))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: id, source, size, source_size, target, taken, copies. Every source's taken words come near its target.

    A source whose target is k times its size and a remainder takes each document k times, and once more the
    documents whose 48-bit hash lies below a threshold. The budgets are nested: a larger share keeps all that a
    smaller one takes. A threshold comes from token sums by source and the first 12 hash bits; only the bucket
    in which the remainder ends is summed again by the next 12 bits, and only what is left of that (a 2^-24 part of a
    source) is ordered. The document on the threshold is taken if that comes nearer to the remainder.
    Nothing is sorted as a whole and each document is only filtered.

    Null text: size 0. Null source: a source of its own, last by name. The hash is of id, text and the number of the row among
    those that repeat both, so repeated and null ids, and a row copied many times, spread over the hash like any others. Sources
    without words have target 0. Texts of any length are counted whole. An empty table gives an empty result. Columns other
    than id, text and source are not read. `digest` (md5 of the text) and `occurrence` (from 0) tell the rows of an id apart.
    """
    rows = number_repeats(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), digest(F.col(text_col)).alias("digest"), words_in(text_of(text_col)).alias("size")), "mix-rows")
    named = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "digest", F.col("occurrence").cast("string"))
    h = F.conv(F.substring(F.md5(named.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = materialise(rows.select("id", key.alias("key"), "source", "size", "digest", "occurrence", h.alias("h")), "mix-sizes")
    sums = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    whole = F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0)).cast("long")
    plan = source_targets(sums, weights, share, repeats).withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0))
    plan = materialise(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    plan = small(plan.select("key", "source_size", "target", "whole", "need"))

    # two levels of histograms; each finds the bucket in which the remainder ends
    edge = plan.select("key", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in (1, 2):
        shift = BITS - level * LEVEL
        inside = rows.join(edge, "key").filter(F.shiftright("h", shift + LEVEL) == F.col("prefix")) if level > 1 else rows.join(edge, "key")
        hist = inside.groupBy("key", "need", "below", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("key").orderBy("bucket"))
        cum = hist.withColumn("upto", upto)
        crossed = cum.filter("upto > need").groupBy("key", "need").agg(F.min(F.struct("bucket", F.expr("upto - n").alias("below"))).alias("b"))
        edge = materialise(crossed.select("key", "need", F.col("b.bucket").alias("prefix"), F.col("b.below").alias("below")), "mix-edge")
        edge = small(edge)
    last = BITS - 2 * LEVEL
    rest = rows.join(edge, "key").filter(F.shiftright("h", last) == F.col("prefix")).groupBy("key", "need", "below", "h").agg(F.sum("size").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("key").orderBy("h"))
    # within reach of the remainder: the sum with this document is no further from it than the sum without
    ends = rest.withColumn("upto", upto).filter("2 * upto - n <= 2 * need").groupBy("key").agg(F.max("h").alias("top"))
    ends = edge.join(ends, "key", "left").select("key", F.coalesce("top", F.shiftleft("prefix", last) - 1).alias("top"))
    ends = small(materialise(ends, "mix-thresholds"))
    # a source without an edge needs all of its documents once more (its remainder is all it has), or has no words
    out = rows.join(plan, "key").join(ends, "key", "left")
    extra = F.when(F.col("need") <= 0, 0).when(F.col("top").isNull() | (F.col("h") <= F.col("top")), 1).otherwise(0)
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.col("whole")).cast("int"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "digest", "occurrence")
