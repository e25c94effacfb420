"""Synthetic datasets whose values are hashes of (seed, row, place): the same rows whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def uniform(seed: int, *parts: Column | int) -> Column:
    """In (0, 1)."""
    h = F.xxhash64(F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.pmod(h, F.lit(2**52)) + 0.5) / float(2**52)


def normal(seed: int, *parts: Column | int) -> Column:
    """Box-Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *parts, 1))) * F.cos(2 * math.pi * uniform(seed, *parts, 2))


def _vector(dims: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), f)


def _weights(seed: int, dims: int, k: int = 0) -> Column:
    return _vector(dims, lambda i: uniform(seed, F.lit(-1 - k), i) * 4 - 2)


def regression(spark: SparkSession, n: int, dims: int = 3, noise: float = 1.5, seed: int = 42) -> DataFrame:
    """id, x, y = w x + 1 + noise."""
    df = spark.range(n).withColumn("x", _vector(dims, lambda i: uniform(seed, F.col("id"), i) * 10 - 5))
    return df.withColumn("y", V.dot(F.col("x"), _weights(seed, dims)) + 1 + noise * normal(seed, F.col("id"), -5))


def binary(spark: SparkSession, n: int, dims: int = 5, noise: float = 0.5, seed: int = 42) -> DataFrame:
    return regression(spark, n, dims, noise, seed).withColumn("y", (V.sigmoid(F.col("y") - 1) >= 0.5).cast("int"))


def multiclass(spark: SparkSession, n: int, dims: int = 5, classes: int = 4, noise: float = 0.5, seed: int = 42) -> DataFrame:
    df = regression(spark, n, dims, noise, seed)
    scores = F.array(*[V.dot(F.col("x"), _weights(seed, dims, k)) + noise * normal(seed, F.col("id"), -9 - k) for k in range(classes)])
    return df.withColumn("s", scores).withColumn("y", (F.array_position("s", F.array_max("s")) - 1).cast("int")).drop("s")


def multilabel(spark: SparkSession, n: int, dims: int = 4, labels: int = 4, noise: float = 0.5, seed: int = 42) -> DataFrame:
    """Each label by its own score; a row without one gets its best."""
    df = regression(spark, n, dims, noise, seed)
    df = df.withColumn("s", F.array(*[V.dot(F.col("x"), _weights(seed, dims, k)) + noise * normal(seed, F.col("id"), -9 - k) for k in range(labels)]))
    y = F.transform("s", lambda v: ((v > 0) | (v == F.array_max("s")) & (F.array_max("s") <= 0)).cast("int"))
    return df.withColumn("y", y).drop("s")


def clusters(spark: SparkSession, n: int, dims: int = 2, k: int = 4, spread: float = 0.4, outliers: float = 0.0, seed: int = 42) -> DataFrame:
    """id, x, label: normal clouds around centres on a wide box; outliers are uniform and have label -1."""
    label = F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(77)), F.lit(k)).cast("int")
    df = spark.range(n).withColumn("label", F.when(uniform(seed, F.col("id"), 78) < outliers, -1).otherwise(label))
    inside = _vector(dims, lambda i: uniform(seed, F.col("label") - 1000, i) * 20 - 10 + spread * normal(seed, F.col("id"), i))
    outside = _vector(dims, lambda i: uniform(seed, F.col("id"), i) * 30 - 15)
    return df.withColumn("x", F.when(F.col("label") >= 0, inside).otherwise(outside))


def pinwheel(spark: SparkSession, n: int, arms: int = 5, radial: float = 0.3, tangential: float = 0.05, rate: float = 0.25, seed: int = 42) -> DataFrame:
    """id, x (two values), label: arms that bend with their radius."""
    df = spark.range(n).withColumn("label", F.pmod("id", F.lit(arms)).cast("int"))
    r, t = 1 + radial * normal(seed, F.col("id"), 1), tangential * normal(seed, F.col("id"), 2)
    angle = F.col("label") * (2 * math.pi / arms) + rate * F.exp(r)
    return df.withColumn("x", F.array(r * F.cos(angle) - t * F.sin(angle), r * F.sin(angle) + t * F.cos(angle)))


def signals(spark: SparkSession, n: int, length: int = 128, seed: int = 42) -> DataFrame:
    """id, x, label: sine, square, saw, triangle and chirp waves below the Nyquist frequency, with some noise."""
    f = 2 + uniform(seed, F.col("id"), 1) * (length / 8)
    phase = uniform(seed, F.col("id"), 2)
    cycle = lambda i: f * i / length + phase
    part = lambda i: cycle(i) - F.floor(cycle(i))
    shapes = [lambda i: F.sin(2 * math.pi * cycle(i)), lambda i: F.when(part(i) < 0.5, 1.0).otherwise(-1.0), lambda i: 2 * part(i) - 1, lambda i: 4 * F.abs(part(i) - 0.5) - 1, lambda i: F.sin(2 * math.pi * cycle(i) * i / length)]
    df = spark.range(n).withColumn("label", F.pmod("id", F.lit(5)).cast("int"))

    def wave(i: Column) -> Column:
        out = shapes[4](i)
        for k in range(3, -1, -1):
            out = F.when(F.col("label") == k, shapes[k](i)).otherwise(out)
        return out + 0.05 * normal(seed, F.col("id"), i)

    return df.withColumn("x", _vector(length, wave))


def images(spark: SparkSession, n: int, size: int = 32, seed: int = 42) -> DataFrame:
    """id, x (rows of pixels), label: disc, square, ring and cross at random places and sizes."""
    df = spark.range(n).withColumn("label", F.pmod("id", F.lit(4)).cast("int"))
    cx, cy = (size * (0.3 + 0.4 * uniform(seed, F.col("id"), k)) for k in (1, 2))
    r = size * (0.1 + 0.15 * uniform(seed, F.col("id"), 3))

    def pixel(i: Column, j: Column) -> Column:
        dx, dy = F.abs(j - cx), F.abs(i - cy)
        d = F.sqrt(dx * dx + dy * dy)
        on = F.when(F.col("label") == 0, d <= r).when(F.col("label") == 1, F.greatest(dx, dy) <= r).when(F.col("label") == 2, F.abs(d - r) <= 1.5).otherwise((F.least(dx, dy) <= 1.5) & (F.greatest(dx, dy) <= r))
        return on.cast("double")

    return df.withColumn("x", _vector(size, lambda i: _vector(size, lambda j: pixel(i, j))))


def token_tasks(spark: SparkSession, n: int, task: str, length: int = 12, vocabulary: int = 100, seed: int = 42) -> DataFrame:
    """id, source, target: copy, reverse, sort, cipher (each id moved by 7) or add (running sums) over content ids from 20."""
    df = spark.range(n).withColumn("source", _vector(length, lambda i: (uniform(seed, F.col("id"), i) * vocabulary).cast("int") + 20))
    s = F.col("source")
    target = {
        "copy": s,
        "reverse": F.reverse(s),
        "sort": F.array_sort(s),
        "cipher": F.transform(s, lambda x: (x - 20 + 7) % vocabulary + 20),
        "add": F.transform(s, lambda x, i: F.aggregate(F.slice(s, F.lit(1), i + 1), F.lit(0), lambda a, y: a + y - 20) % vocabulary + 20),
    }[task]
    return df.withColumn("target", target)


def phase_mix(spark: SparkSession, n: int = 128, length: int = 128, f1: int = 3, f2: int = 11, seed: int = 42) -> DataFrame:
    """id, x, y: two tones with a random phase, and the same less its mean."""
    df = spark.range(n).withColumn("p", uniform(seed, F.col("id")) * 2 * math.pi)
    df = df.withColumn("x", _vector(length, lambda i: F.sin(2 * math.pi * f1 * i / length) + F.sin(2 * math.pi * f2 * i / length + F.col("p"))))
    return df.select("id", "x", F.transform("x", lambda v: v - V.mean(F.col("x"))).alias("y"))


def decisions(spark: SparkSession, n: int, vocabulary: int = 100, seed: int = 42) -> DataFrame:
    """id, kind, instruction, options, state, answer: does a token occur (BINARY), which option occurs (CHOICE), how often (SCORE, 0 to 4)."""
    df = spark.range(n).withColumn("kind", F.element_at(F.array(F.lit("BINARY"), F.lit("CHOICE"), F.lit("SCORE")), (F.pmod("id", F.lit(3)) + 1).cast("int")))
    df = df.withColumn("asked", (uniform(seed, F.col("id"), 50) * vocabulary).cast("int") + 20).withColumn("times", (uniform(seed, F.col("id"), 51) * 5).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.pmod(F.col("asked") - 20 + 1 + (uniform(seed, F.col("id"), i) * (vocabulary - 2)).cast("int"), F.lit(vocabulary)) + 20)
    state = F.transform(other, lambda x, i: F.when(i < F.col("times"), F.col("asked")).otherwise(x))
    answer = F.when(F.col("kind") == "BINARY", (F.col("times") > 0).cast("int")).when(F.col("kind") == "CHOICE", F.when(F.col("times") > 0, 0).otherwise(1)).otherwise(F.col("times"))
    return df.select("id", "kind", "asked", state.alias("state"), answer.alias("answer"))
