"""Isotonic calibration as tables: fits whose blocks reach over many tasks, look-ups with hot, null and outlying scores."""

from fractions import Fraction

import numpy as np
import pytest

from sparkwright.operators import calibration


def plain_fit(s, y):
    """Pooling one row after the other in exact fractions, equal means pooled too."""
    blocks = []
    for x, v in sorted(zip(map(Fraction, s.tolist()), map(Fraction, y.tolist()), strict=True)):
        blocks.append([x, v, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return [(float(x / n), float(v / n)) for x, v, n in blocks]


@pytest.mark.parametrize("shape", ["falling", "rising", "saw", "noise"])
def test_blocks_over_many_tasks(spark, shape):
    rng = np.random.default_rng(3)
    s = rng.permutation(600).astype(float)
    y = {"falling": -s, "rising": s, "saw": s % 97, "noise": s / 50 + rng.normal(0, 3, 600)}[shape]
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "s double, y double").repartition(3)
    got = sorted((r["x"], r["p"]) for r in calibration.isotonic_table(df, "s", "y", parts=12).collect())
    want = plain_fit(s, y)
    assert len(got) == len(want) and np.allclose(got, want)


def test_look_up_by_range(spark):
    knots = [(float(x), float(x) ** 2) for x in range(0, 40, 2)]
    scores = [1.5] * 300 + [-7.0, 0.0, 2.0, 38.0, 38.5, 99.0, None] + np.linspace(-1, 40, 83).tolist()
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(scores)], "id long, s double, p string").repartition(5)
    table = spark.createDataFrame(knots, "x double, p double")
    out = calibration.predict_isotonic(df, "s", table, parts=7)
    assert sorted(out.columns) == ["id", "p", "s"]
    got = {r["id"]: r["p"] for r in out.collect()}
    assert len(got) == len(scores)
    for i, s in enumerate(scores):
        assert got[i] is None if s is None else abs(got[i] - np.interp(s, *zip(*knots, strict=True))) < 1e-9


def test_look_up_without_knots_or_rows(spark):
    none = spark.createDataFrame([], "x double, p double")
    one = spark.createDataFrame([(1.0,)], "s double")
    assert calibration.predict_isotonic(one, "s", none, parts=3).collect()[0]["p"] is None
    assert calibration.predict_isotonic(one.limit(0), "s", none, parts=3).count() == 0
    assert calibration.isotonic_table(spark.createDataFrame([], "s double, y double"), "s", "y").count() == 0
