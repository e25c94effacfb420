"""Work that has to stay near the input's size: copies of rows in comparisons of all pairs, products by batches, state without Python."""

import numpy as np
from pyspark.sql import functions as F

from sparkwright.operators import cluster_metrics, nearest, projection
from sparkwright.streaming import label_state


def test_rows_are_copied_a_fixed_number_of_times(spark):
    df = spark.range(40_000).select("id", F.array(F.col("id").cast("double")).alias("v"))
    left, _ = nearest.block_pairs(df, "id", "v")
    assert left.agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0] <= nearest.BLOCKS * 40_000


def test_pairs_in_tiles(spark, monkeypatch):
    """Tiles of a few rows give the scores that plain NumPy gives; distances and labels have ties."""
    rng = np.random.default_rng(5)
    x, l = rng.integers(0, 6, (90, 3)).astype(float), rng.integers(0, 3, 90)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    a = np.array([d[i, (l == l[i])].sum() / ((l == l[i]).sum() - 1) for i in range(90)])
    b = np.array([min(d[i, l == k].mean() for k in range(3) if k != l[i]) for i in range(90)])
    monkeypatch.setattr(nearest, "TILE", 200)
    df = spark.createDataFrame([(i, x[i].tolist(), int(l[i])) for i in range(90)], "k long, v array<double>, l int")
    got = {r["k"]: r["silhouette"] for r in cluster_metrics.silhouette_values(df, "k", "v", "l").collect()}
    assert np.allclose([got[i] for i in range(90)], (b - a) / np.maximum(a, b))

    e = np.sqrt(((x[:, None, :2] - x[:, :2]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf), np.fill_diagonal(e, np.inf)
    rank = [np.argsort(np.argsort(m.round(9), axis=1, kind="stable"), axis=1) + 1 for m in (d, e)]
    behind = [np.maximum(rank[1 - s][rank[s] <= 4] - 4, 0).sum() * 2 / (90 * 4 * (180 - 12 - 1)) for s in (0, 1)]
    row = cluster_metrics.rank_scores(df.withColumn("two", F.slice("v", 1, 2)), "k", "v", "two", 4).first()
    assert np.allclose((row[0], row[1]), (1 - behind[1], 1 - behind[0]))


def test_blocks_that_meet_once(spark):
    """Copies grow with the rows from 10 000 to 2 million, and half of them are left out; scores of several blocks equal NumPy's."""
    for n in (10_000, 2_000_000):
        df = spark.range(n).select("id", F.array(F.lit(1.0).cast("float")).alias("v"))
        left, right = nearest.block_pairs(df, "id", "v", rows=n, once=True)
        counts = [side.agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n")).first() for side in ((left, right) if n < 20_000 else (left,))]
        assert all(c[0] == nearest.BLOCKS * (nearest.BLOCKS + 1) // 2 for c in counts)
        assert sum(c[1] for c in counts) <= (nearest.BLOCKS + 1) * n

    rng = np.random.default_rng(7)
    x, l = rng.normal(size=(1300, 2)).astype(np.float32), rng.integers(0, 3, 1300)
    d = np.sqrt(((x[:, None].astype(float) - x) ** 2).sum(-1))
    a = np.array([d[i, l == l[i]].sum() / ((l == l[i]).sum() - 1) for i in range(1300)])
    b = np.array([min(d[i, l == k].mean() for k in range(3) if k != l[i]) for i in range(1300)])
    df = spark.createDataFrame([(i, x[i].tolist(), int(l[i])) for i in range(1300)], "k long, v array<float>, l int")
    got = {r["k"]: r["silhouette"] for r in cluster_metrics.silhouette_values(df, "k", "v", "l").collect()}
    assert len(got) == 1300 and np.allclose([got[i] for i in range(1300)], (b - a) / np.maximum(a, b))


def test_projections_by_batches(spark):
    m = projection.RunningSVD(rank=2)
    m.merge(np.random.default_rng(1).normal(size=(5, 2)))
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [-3.0, 0.5])]
    df = spark.createDataFrame(rows, "k int, v array<float>").select("k", m.restore(m.project(F.col("v"))).alias("x"))
    got = {r["k"]: r["x"] for r in df.collect()}
    assert got[2] is got[3] is got[4] is None and np.allclose(got[1], [1, 2]) and np.allclose(got[5], [-3, 0.5])
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()


def test_stream_state_over_batches(spark, tmp_path):
    rows = [("a", "1", 5, "label", 1.0), ("a", "1", 2, "retract", 2.0), ("b", "1", 1, "label", float("nan")), ("a", "2", 1, "label", None), ("a", "2", 9, "retract", 0.0)]
    schema = "sample_id string, task_id string, seq long, op string, value double"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log"))
    folded = label_state.fold_stream(stream)
    assert "Python" not in folded._jdf.queryExecution().analyzed().toString() and "InPandas" not in folded._jdf.queryExecution().analyzed().toString()
    got = sorted(tuple(r[c] for c in ("sample_id", "task_id", "seq", "value", "revisions")) for r in label_state.current_from_stream(spark, stream).collect())
    assert got == [("a", "1", 5, 1.0, 2), ("b", "1", 1, None, 1)]
