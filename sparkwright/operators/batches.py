"""Batches of training rows: an exact number of draws with replacement, and batches of rows of like length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import series_positions


def seeded(*parts: Column | str) -> Column:
    """60 bits of hash of the parts as a long, the same in any engine that knows md5."""
    named = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def random_draws(df: DataFrame, order: list[str], draws: int, seed: str, batch: int | None = None) -> DataFrame:
    """Exactly `draws` rows drawn with replacement, each row with equal chance: df's columns, draw (from 0) and, where asked, batch.

    Rows are numbered by the order, which must be unique to be repeatable, in range partitions; each draw hashes its own
    number to a place, so draws are made in all tasks at once and do not depend on how rows are partitioned. Rows
    and draws meet in an equality join: no row is copied more often than it is drawn. No rows: no draws.
    """
    placed = series_positions(df, [], order, "_place")
    n = df.count()
    if not n:
        return df.select("*", F.lit(None).cast("long").alias("draw"), *([F.lit(None).cast("long").alias("batch")] if batch else [])).limit(0)
    drawn = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (seeded(seed, F.col("id")) % n).alias("_place"))
    out = drawn.join(placed, "_place").drop("_place").select(*df.columns, "draw")
    return out.withColumn("batch", F.floor(F.col("draw") / batch)) if batch else out


def content_positions(ids: Column, special: list[int]) -> Column:
    """Places (from 0) of the ids that are none of the special ones."""
    known = F.array(*[F.lit(i) for i in special]).cast("array<bigint>")
    places = F.transform(ids, lambda x, i: F.when(~F.array_contains(known, x.cast("long")), i))
    return F.array_compact(places)


def length_batches(df: DataFrame, length: str, order: list[str], size: int, tasks: list[str], seed: str, limit: int | None = None) -> DataFrame:
    """df with batch, slot, width, padding and task: batches of `size` rows of like length, each padded to its own longest row.

    Rows are numbered by (length, order) in range partitions, so that a batch holds neighbours in length and padding is
    small; all rows of a batch get the one task drawn for it. `limit` bounds what a row counts as (longer ones are cut to it).
    """
    held = F.least(F.col(length), F.lit(limit)) if limit else F.col(length)
    rows = series_positions(df.withColumn("_held", held), [], ["_held", *order], "_place")
    rows = rows.withColumns({"batch": F.floor(F.col("_place") / size), "slot": (F.col("_place") % size).cast("int")})
    wide = rows.groupBy("batch").agg(F.max("_held").alias("width"))
    task = F.element_at(F.array(*map(F.lit, tasks)), (seeded(seed, F.col("batch")) % len(tasks) + 1).cast("int"))
    out = rows.join(wide, "batch")
    return out.select(*df.columns, "batch", "slot", "width", (F.col("width") - F.col("_held")).alias("padding"), task.alias("task"))
