"""Long series against NumPy: blocks and halos, gaps, folding, complex columns, wavelets of even and odd length."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import signals as S

RNG = np.random.default_rng(4)


def frame(spark, series):
    rows = [(k, i, float(x)) for k, xs in series.items() for i, x in enumerate(xs) if x is not None]
    return spark.createDataFrame(rows, "k string, pos long, value double").repartition(3)


def lists(df, *names, value="value"):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[n] for n in names), {})[r["pos"]] = r[value]
    return out


def test_positions_of_a_series_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), (F.hash("id")).alias("at"), "id").repartition(5)
        got = S.series_positions(df, ["k"], ["at", "id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in ("hot", "cold"):
        rows = sorted((r["at"], r["id"], r["pos"]) for r in got if r["k"] == k)
        assert [p for *_, p in rows] == list(range(len(rows)))


def test_position_moments(spark):
    df = spark.createDataFrame([([1.0, 2.0, None],), ([3.0],), ([float("nan"), 4.0, 5.0],), ([],), (None,)], "a array<double>")
    got = {r["pos"]: tuple(r)[1:] for r in S.position_moments(df, "a").collect()}
    assert got == {0: (2, 2.0, 1.0, 1.0, 3.0), 1: (2, 3.0, 1.0, 2.0, 4.0), 2: (1, 5.0, 0.0, 5.0, 5.0)}


@pytest.mark.parametrize("block", [1, 8, 64, 65_536])
def test_downsample_equals_the_plain_filter_whatever_the_blocks(spark, block):
    series = {"a": RNG.normal(size=150), "b": [1.0] * 30, "c": [2.0], "gap": [*RNG.normal(size=20), *[None] * 70, *RNG.normal(size=15)]}
    got = lists(S.downsample(frame(spark, series), ["k"], 4, block=block), "k")
    taps = S.low_pass(4)
    for k, xs in series.items():
        want = {}
        for m in range(-(-len(xs) // 4)):
            if all(x is None for x in xs[4 * m : 4 * m + 4]):
                continue
            near = [(w, xs[4 * m + d]) for w, d in zip(taps, range(-40, 41), strict=True) if 0 <= 4 * m + d < len(xs) and xs[4 * m + d] is not None]
            want[m] = sum(w * x for w, x in near) / sum(w for w, _ in near)
        assert got[(k,)].keys() == want.keys()
        assert all(abs(got[(k,)][m] - want[m]) < 1e-9 for m in want)


def test_downsample_stops_what_the_new_rate_cannot_hold(spark):
    n = np.arange(400)
    got = lists(S.downsample(frame(spark, {"fast": np.cos(math.pi * 0.9 * n), "slow": np.cos(0.02 * n)}), ["k"], 4), "k")
    assert max(abs(got[("fast",)][m]) for m in range(15, 85)) < 0.01
    assert max(abs(got[("slow",)][m] - math.cos(0.08 * m)) for m in range(15, 85)) < 0.01


def test_pyramid_without_keys_and_empty(spark):
    rows = frame(spark, {"a": [3.0] * 64}).select("pos", "value")
    got = lists(S.pyramid(rows, [], [2, 1, 4]), "level")
    assert [len(got[(i,)]) for i in range(4)] == [64, 32, 32, 8]
    assert all(abs(v - 3) < 1e-9 for part in got.values() for v in part.values())
    assert S.pyramid(rows.limit(0), [], [2]).count() == 0


def test_dyadic_power(spark):
    xs = RNG.normal(size=37)
    rows = S.dyadic_power(frame(spark, {"a": xs, "short": xs[:5]}), ["k"], 8, 8).collect()
    got = {(r["level"], r["win"], r["freq"]): r["power"] for r in rows}
    assert {r["k"] for r in rows} == {"a"}
    padded, want = np.r_[xs, np.zeros(3)], {}
    for level, count in enumerate([1, 2, 4]):
        size = 40 // count
        for w in range(count):
            x = padded[w * size : (w + 1) * size] * np.hanning(size)
            x = np.r_[x, np.zeros(-len(x) % 8)].reshape(-1, 8).sum(axis=0)
            p = np.abs(np.fft.rfft(x)) ** 2 / (np.sum(np.hanning(size) ** 2) * xs.std() ** 2)
            p[1:-1] *= 2
            want |= {(level, w, f): v for f, v in enumerate(p)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    with pytest.raises(ValueError, match="under 4"):
        S.dyadic_power(frame(spark, {"a": xs}), ["k"], 2, 8)


@pytest.mark.parametrize("size", [8, 9])
def test_spectra_and_back(spark, size):
    series, taper = {"a": RNG.normal(size=50), "b": RNG.normal(size=size)}, np.hamming(size).tolist()
    found = S.spectra(frame(spark, series), ["k"], taper, 4)
    c = {(r["k"], r["win"], r["freq"]): complex(r["c"]["re"], r["c"]["im"]) for r in found.collect()}
    for w in range((50 - size) // 4 + 1):
        want = np.fft.rfft(series["a"][4 * w : 4 * w + size] * taper)
        assert np.allclose([c["a", w, f] for f in range(size // 2 + 1)], want)
    assert not any(w > 0 for k, w, _ in c if k == "b")
    kept = found.select("k", "win", "freq", S.power(F.col("c"), F.col("freq"), taper).alias("p"), S.angle(F.col("c")).alias("t"))
    back = kept.select("k", "win", "freq", S.from_power(F.col("p"), F.col("t"), F.col("freq"), taper).alias("c"))
    got = lists(S.inverse_spectra(back, ["k"], taper, 4), "k")
    last = (50 - size) // 4 * 4 + size
    assert np.allclose([got[("a",)][i] for i in range(last)], series["a"][:last], atol=1e-6) and len(got[("a",)]) == last
    assert np.allclose([got[("b",)][i] for i in range(size)], series["b"], atol=1e-6)


def test_complex_columns(spark):
    a, b = S.complex_of(F.lit(3.0), F.lit(-4.0)), S.polar(F.lit(2.0), F.lit(math.pi / 2))
    row = spark.range(1).select(S.times(a, b).alias("t"), S.magnitude(a).alias("m"), S.angle(b).alias("g"), S.mod_relu(a, -1.0).alias("r"), S.mod_relu(a, -9.0).alias("z"), S.mod_relu(S.complex_of(F.lit(0.0), F.lit(0.0)), 1.0).alias("o")).first()
    assert np.allclose([*row["t"], row["m"], row["g"], *row["r"], *row["z"], *row["o"]], [8, 6, 5, math.pi / 2, 2.4, -3.2, 0, 0, 0, 0])


def test_haar(spark):
    series = {"even": RNG.normal(size=12), "odd": RNG.normal(size=7), "one": [5.0]}
    rows = frame(spark, series)
    found = S.haar_step(rows, ["k"])
    low, high = lists(found, "k", value="low"), lists(found, "k", value="high")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    back = lists(S.haar_back(found, ["k"], sizes), "k")
    for k, xs in series.items():
        x = np.array(xs)
        even, odd = x[::2], x[(np.arange(0, len(x), 2) + 1) % len(x)]
        assert np.allclose([low[(k,)][i] for i in range(len(even))], (even + odd) / math.sqrt(2))
        assert np.allclose([high[(k,)][i] for i in range(len(even))], (odd - even) / math.sqrt(2))
        want = x.copy()
        if len(x) % 2:
            want[0] *= 2  # the adjoint: two pairs share the first value
        assert np.allclose([back[(k,)][i] for i in range(len(x))], want)
    levels = S.haar(rows, ["k"], 3).groupBy("level", "k").count().collect()
    assert {(r["level"], r["k"]): r["count"] for r in levels} == {(1, "even"): 6, (2, "even"): 3, (3, "even"): 2, (1, "odd"): 4, (2, "odd"): 2, (3, "odd"): 1, (1, "one"): 1, (2, "one"): 1, (3, "one"): 1}
