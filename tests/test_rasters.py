"""Rasters against NumPy and plain searches; draws and batches that do not depend on partitions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import batches as B
from sparkwright.operators import rasters as R

RNG = np.random.default_rng(8)


def cells(spark, a, skip=()):
    return spark.createDataFrame([(y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]) if (y, x) not in skip], "y long, x long, value double").repartition(3)


@pytest.mark.parametrize("block", [1, 3, 32])
def test_hartley_2d(spark, block):
    a = RNG.normal(size=(7, 5))
    a[2, 3] = a[4, 0] = 0
    f = np.fft.fft2(a)
    got = R.hartley_2d(cells(spark, a, {(2, 3), (4, 0)}), 7, 5, block).collect()
    assert len(got) == 35 and all(abs(r["value"] - (f.real - f.imag)[r["u"], r["v"]]) < 1e-9 for r in got)


def test_basins_equal_a_walk_downhill(spark):
    for a, skip in ((RNG.integers(0, 4, (9, 11)), set()), (np.zeros((4, 6)), set()), (np.arange(40).reshape(1, 40), set()), (RNG.integers(0, 9, (8, 8)), {(3, i) for i in range(8)})):
        there = {(y, x): (a[y, x], y, x) for y in range(a.shape[0]) for x in range(a.shape[1]) if (y, x) not in skip}
        for r in R.basins(cells(spark, a, skip)).collect():
            at = (r["y"], r["x"])
            while True:
                best = min(there[n] for n in ((at[0] + dy, at[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) if n in there)
                if best[1:] == at:
                    break
                at = best[1:]
            assert (r["by"], r["bx"]) == at
    assert R.basins(cells(spark, np.zeros((0, 0)))).count() == 0


def test_infill(spark):
    a = RNG.normal(size=(5, 7))
    got = {(r["y"], r["x"]): r["value"] for r in R.infill(cells(spark, a), 5, 7).collect()}
    for (y, x), v in got.items():
        inside = 0 < y < 4 and 0 < x < 6 and y % 2 == x % 2
        want = np.mean([a[y - 1, x], a[y + 1, x], a[y, x - 1], a[y, x + 1]]) if inside else a[y, x]
        assert abs(v - want) < 1e-12


def test_draws_are_exact_even_and_repeatable(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("k"), F.lit("x").alias("draws"))
    rows = lambda d: sorted((r["draw"], r["batch"], r["k"]) for r in d.collect())
    got = rows(B.random_draws(df, ["k"], 10_000, "s", 128))
    assert got == rows(B.random_draws(df.repartition(7), ["k"], 10_000, "s", 128)) and [d for d, *_ in got] == list(range(10_000))
    n = Counter(k for *_, k in got)
    assert len(n) == 50 and sum((c - 200) ** 2 / 200 for c in n.values()) < 85  # chi-square of 49 degrees at 0.999
    assert {b for _, b, _ in got} == set(range(79))
    assert got != rows(B.random_draws(df, ["k"], 10_000, "other", 128))
    assert B.random_draws(df.limit(0), ["k"], 10, "s", 2).count() == 0 and B.random_draws(df, ["k"], 0, "s").count() == 0


def test_length_batches(spark):
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(RNG.integers(0, 300, 203))], "i int, n int")
    got = B.length_batches(df.repartition(5), "n", ["i"], 10, ["a", "b", "c"], "s", limit=250).collect()
    plain = sorted((min(r["n"], 250), r["i"]) for r in df.collect())
    for r in got:
        place = plain.index((min(r["n"], 250), r["i"]))
        own = [n for n, _ in plain[place // 10 * 10 : place // 10 * 10 + 10]]
        assert (r["batch"], r["slot"], r["width"], r["padding"]) == (place // 10, place % 10, max(own), max(own) - min(r["n"], 250))
    tasks = {r["batch"]: r["task"] for r in got}
    assert all(tasks[r["batch"]] == r["task"] for r in got) and set(tasks.values()) <= {"a", "b", "c"} and len(set(tasks.values())) > 1
    assert sum(r["padding"] for r in got) < 0.05 * sum(r["width"] for r in got)


def test_content_positions(spark):
    df = spark.createDataFrame([([1, 7, 0, 9, 2],), ([],), ([0, 0],), (None,)], "ids array<int>")
    assert [r[0] for r in df.select(B.content_positions(F.col("ids"), [0, 1, 2])).collect()] == [[1, 3], [], [], None]
