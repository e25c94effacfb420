"""Nearest-prototype joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROTOTYPES = 100_000  # rows of a prototype table that one task may hold; larger tables are searched block by block


def label_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    """label, size, centre: partial sums by (label, position) before one small shuffle."""
    parts = df.filter(F.col(label).isNotNull()).select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy(label).agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))


def nearest(df: DataFrame, vector: str, prototypes: list[tuple[int, list[float]]], block: int = 4096) -> DataFrame:
    """Add `nearest` (prototype id) and `distance`; the smallest id wins a tie.

    Prototypes are model parameters, bounded by PROTOTYPES. A batch of vectors meets them in blocks by one matrix product each
    (|x|^2 - 2xy + y^2 on centred values), so no pair is ever a row.
    """
    if len(prototypes) > PROTOTYPES:
        raise ValueError("too many prototypes for a nearest-prototype join")
    ordered = sorted(prototypes)
    ids = np.array([i for i, _ in ordered], np.int64)
    table = np.array([v for _, v in ordered], float)
    shift = table.mean(axis=0) if len(table) else 0.0
    table = table - shift
    squares = (table * table).sum(axis=1)

    def search(batches):
        for pdf in batches:
            if len(pdf) and len(ids):
                x = np.stack(pdf[vector].to_numpy()).astype(float) - shift
                best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
                for lo in range(0, len(table), block):
                    d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ table[lo : lo + block].T + squares[lo : lo + block], 0)
                    k = d.argmin(axis=1)
                    v = d[np.arange(len(x)), k]
                    better = v < best
                    best[better], at[better] = v[better], lo + k[better]
                yield pdf.assign(nearest=ids[at], distance=np.sqrt(best))
            else:
                yield pdf.assign(nearest=pd.Series([None] * len(pdf), dtype="Int64"), distance=pd.Series([None] * len(pdf), dtype="float64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(search, f"{fields}, nearest bigint, distance double")


BLOCKS = 16  # blocks on each side of a comparison of all pairs, as long as no block is too small or too large
LEAST_BLOCK, MOST_BLOCK = 512, 131_072  # rows of a block
TILE = 4_194_304  # distances that a task holds at a time


def block_pairs(df: DataFrame, key: str, vector: str, size: int | None = None, extra: tuple[str, ...] = (), rows: int | None = None, once: bool = False, dealt: bool = False):
    """All blocks of rows against all blocks, as a cogrouped pair of grouped frames (left by a, right by b).

    once: two blocks meet once, as a <= b, and who compares them accounts for the rows of both; that halves copies and work.
    dealt: over twice as many tasks as there are cells, so that none has many of them and free cores take the next.

    Each row is copied once for a block: BLOCKS times on each side whatever the number of rows, up to BLOCKS * MOST_BLOCK rows,
    and n / MOST_BLOCK times beyond. All-pairs measures are quadratic work by nature; this keeps what is shuffled
    near the input's size and spreads the work. Who compares two blocks should go through them by tiles().
    """
    n = df.count() if rows is None else rows
    blocks = max(1, -(-n // (size or min(max(-(-n // BLOCKS), LEAST_BLOCK), MOST_BLOCK))))
    # floats stay floats while they are shuffled
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    placed = df.select(F.col(key).alias("key"), F.col(vector).cast(kind).alias("vector"), *extra, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("own"))
    every = lambda low, high: F.explode(F.sequence(low, high))
    left = placed.withColumn("other", every(F.col("own") if once else F.lit(0), F.lit(blocks - 1))).withColumnRenamed("own", "a").withColumnRenamed("other", "b")
    # columns of its own, which a cogroup of a frame with itself needs
    right = placed.withColumn("other", every(F.lit(0), F.col("own") if once else F.lit(blocks - 1))).select(F.col("other").alias("a"), F.col("own").alias("b"), *[F.col(c).alias(c) for c in ("key", "vector", *extra)])
    if dealt:
        tasks = blocks * (blocks + 1 if once else 2 * blocks)
        left, right = left.repartition(tasks, "a", "b"), right.repartition(tasks, "a", "b")
    return left.groupBy("a", "b"), right.groupBy("a", "b")


def tiles(rows: int, columns: int):
    """Slices of rows so that rows times columns stays within TILE."""
    step = max(1, TILE // max(columns, 1))
    return (slice(i, i + step) for i in range(0, rows, step))


def squares(rows: int, columns: int):
    """Pairs of slices that cover rows times columns, of equal sides and within TILE; for sums, which may be made up in any order."""
    side = max(1, int(TILE**0.5))
    return ((slice(i, i + side), slice(j, j + side)) for i in range(0, rows, side) for j in range(0, columns, side))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product on centred values."""
    shift = y.mean(axis=0)
    x, y = x - shift, y - shift
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0))
