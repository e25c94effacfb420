"""Series as rows against plain Python: windows, shifts, targets, accuracy; one-pass silhouettes; regression from sums of products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import cluster_metrics, clustering, regression, windows

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def series(spark):
    """One key with most rows, short ones, a null key, null values; rows out of order."""
    data = {1: RNG.normal(size=400).tolist(), 2: [1.0, None, 3.0, 4.0, 5.0, 6.0], 3: [9.0], None: [1.0, 2.0, 3.0, 4.0, 5.0]}
    rows = [(k, i, x) for k, xs in data.items() for i, x in enumerate(xs)]
    RNG.shuffle(rows)
    rows = [(None if k is None else int(k), int(i), x) for k, i, x in rows]
    return {k: xs for k, xs in data.items()}, spark.createDataFrame(rows, "user long, at long, x double").repartition(7)


@pytest.mark.parametrize(("size", "overlap"), [(5, 2), (4, 0), (3, 9)])
def test_windows(series, size, overlap):
    data, df = series
    step = size - (size - 1 if overlap >= size else overlap)
    want = {(k, w): xs[w * step : w * step + size] for k, xs in data.items() for w in range((len(xs) - size) // step + 1) if len(xs) >= size}
    got = {(r["user"], r["window"]): r["values"] for r in windows.series_windows(df, "user", ["at"], "x", size, overlap).collect()}
    assert got == want


@pytest.mark.parametrize("by", [0, 1, 3, -2, 1000])
@pytest.mark.parametrize("wrap", [False, True])
def test_shift(series, by, wrap):
    data, df = series
    df = df.withColumn("pos", F.lit(1)).withColumn("value", F.lit("x"))  # names that clash with the operator's own
    got = {(r["user"], r["at"]): r["shifted"] for r in windows.shift_rows(df, "user", ["at"], "x", by, F.lit(-7.0), wrap).collect()}
    want = {}
    for k, xs in data.items():
        for i in range(len(xs)):
            j = i + by
            want[k, i] = xs[j % len(xs)] if wrap else xs[j] if 0 <= j < len(xs) else -7.0
    assert got == want


def test_targets_and_accuracy(series):
    data, df = series
    df = df.filter("user is null or user <> 2")
    got = sorted(map(tuple, windows.sequence_targets(df, "user", ["at"], "x").collect()), key=str)
    want = [(k, i, *xs) for k in (1, 3, None) for i, xs in enumerate(zip(data[k], data[k][::-1], sorted(data[k]), strict=True))]
    assert got == sorted(want, key=str)
    rows = df.sparkSession.createDataFrame([(1, 5, 5, 1), (1, 4, 5, 1), (1, 4, 5, 0), (2, 3, 3, 1), (3, None, None, 1), (4, 1, 2, 0)], "k int, p int, t int, m int")
    scores = {r["k"]: (r["accuracy"], r["exact"]) for r in windows.row_accuracy(rows, ["k"], "p", "t", "m").collect()}
    assert scores == {1: (0.5, False), 2: (1.0, True), 3: (0.0, False), 4: (0.0, True)}


def test_empty(spark):
    none = spark.createDataFrame([], "user long, at long, x double")
    assert windows.series_windows(none, "user", ["at"], "x", 3, 1).count() == 0
    assert windows.shift_rows(none, "user", ["at"], "x", 1, wrap=True).count() == 0
    assert cluster_metrics.silhouette_by_centres(spark.createDataFrame([], "k int, v array<double>, l int"), "k", "v", "l").count() == 0


def test_silhouette_by_centres(spark):
    x = RNG.normal(size=(60, 3)) + np.repeat([[0, 0, 0], [3, 0, 0], [0, 9, 1]], 20, axis=0)
    labels = np.repeat(["a", "b", "c"], 20)
    labels[-1] = "alone"
    df = spark.createDataFrame([(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))] + [(99, None, "a"), (100, [1.0, 1.0, 1.0], None)], "k int, v array<double>, l string")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    got = {r["k"]: r["silhouette"] for r in cluster_metrics.silhouette_by_centres(df, "k", "v", "l").collect()}
    assert set(got) == set(range(60))
    for i in range(60):
        n = (labels == labels[i]).sum()
        a = d[i, labels == labels[i]].sum() / max(n - 1, 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b) if n > 1 else 0.0)
    one = cluster_metrics.silhouette_by_centres(df.filter("l = 'a'"), "k", "v", "l").agg(F.max("silhouette"), F.min("silhouette")).first()
    assert tuple(one) == (0.0, 0.0)


@pytest.mark.parametrize("score", ["pairs", "squared", "centres"])
def test_growth_scores_agree(spark, score):
    x = RNG.normal(size=(120, 2), scale=0.2) + np.repeat([[0, 0], [5, 0], [0, 5]], 40, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    assert clustering.grow_centroids(df, "id", "x", most=4, score=score).best == 3
    with pytest.raises(ValueError):
        clustering.grow_centroids(df, "id", "x", score="other")


def test_regression_from_products(spark):
    x = RNG.normal(size=(200, 3)) * [1, 10, 0.1] + [5, -3, 0]
    y = x @ [2.0, -0.5, 7.0] + 4 + RNG.normal(size=200)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), ([1.0, 2.0, 3.0], None)], "x array<double>, y double")
    m = regression.fit_linear(df, "x", "y", steps=100, penalty=0.05)
    u, v = (x - x.mean(axis=0)) / x.std(axis=0), (y - y.mean()) / y.std()
    want = np.linalg.solve(u.T @ u / 200 + 0.1 * np.eye(3), u.T @ v / 200)  # the ridge solution
    assert m.weights == pytest.approx(np.r_[0.0, want], abs=1e-6)
    assert m.mean == pytest.approx(x.mean(axis=0)) and m.target[1] == pytest.approx(y.std())
