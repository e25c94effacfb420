"""Places by range partitions that are really cut: AQE must not join the few rows of a test into one task."""

import pytest
from pyspark.sql import functions as F

from sparkwright.operators import batches, calibration, signals, windows


@pytest.fixture
def many_tasks(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def _rows(spark, n=40_000):
    return spark.range(n).select(((F.col("id") * 7919) % n).alias("i"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.lpad(F.col("id").cast("string"), 50, "x").alias("text"))


def test_positions_of_all_rows(many_tasks):
    placed = windows.positions(_rows(many_tasks), ["i"], "at")
    # all columns are asked for, as counts then come from a narrower sort than rows do
    got = placed.agg(F.count("*"), F.sum(F.length("text")), F.count_if(F.col("at") != F.col("i"))).first()
    assert tuple(got) == (40_000, 40_000 * 50, 0)


def test_positions_by_key(many_tasks):
    placed = signals.series_positions(_rows(many_tasks), ["k"], ["i"])
    got = placed.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    assert sum(r["n"] for r in got) == 40_000 and {r["k"] for r in got} == {None, 1, 2}
    assert all(r["d"] == r["n"] and (r["a"], r["b"]) == (0, r["n"] - 1) for r in got)


def test_shifts_keep_all_rows(many_tasks):
    out = windows.shift_rows(_rows(many_tasks).withColumn("k", F.lit(1)), "k", ["i"], "i", 1)
    assert out.count() == 40_000 and out.filter("shifted <> i + 1").isEmpty() and out.filter("shifted is null").count() == 1


def test_batches_keep_all_rows(many_tasks):
    rows = _rows(many_tasks).select("i", (F.col("i") % 300).alias("n"), "text")
    out = batches.length_batches(rows, "n", ["i"], 32, ["a", "b"], "s").groupBy("batch").agg(F.count("*").alias("n"), F.max("text"), F.max("i"))
    assert out.count() == 1250 and out.filter("n <> 32").isEmpty()
    drawn = batches.random_draws(rows, ["i"], 5000, "s")
    assert tuple(drawn.agg(F.count("*"), F.sum(F.length("text"))).first()) == (5000, 5000 * 50)


def test_isotonic_predictions_keep_all_rows(many_tasks):
    rows = _rows(many_tasks).select("i", (F.col("i") / 10).alias("s"))
    knots = many_tasks.range(0, 4001).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("p"))  # up and down
    out = calibration.predict_isotonic(rows, "s", knots).withColumn("up", F.when(F.floor("s") % 2 == 0, F.col("s") % 1).otherwise(1 - F.col("s") % 1))
    assert tuple(out.agg(F.count("*"), F.count_if(F.abs(F.col("p") - F.col("up")) > 1e-6)).first()) == (40_000, 0)
