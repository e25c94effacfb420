"""Functions and operators on small tables with nulls, ties, constants and ragged arrays."""

import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.functions import chrono, sequences, text, vectors
from sparkwright.functions.categorical import Categories
from sparkwright.functions.numeric import MinMax, Outliers, Standard, midpoint_quantiles
from sparkwright.operators import calibration, clustering, labels, projection, regression, windows
from sparkwright.operators.cluster_metrics import cubic_clustering_criterion, silhouette_values
from sparkwright.plans.pipeline import FeaturePipeline, expand_arrays
from sparkwright.sources import audio, datasets, generators


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (int, float, str, list)) else (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)))
    return df.select(column.alias("x")).first()["x"]


def test_numeric_edges(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (4.0,), (100.0,)], "v double")
    assert MinMax.fit(df, "v") == MinMax(1.0, 100.0)
    assert MinMax.fit(df.filter("v < 3"), "v", MinMax(-5.0, 0.5)) == MinMax(-5.0, 2.0)
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r[0] for r in same.select(MinMax.fit(same, "v").encode(F.col("v"))).collect()} == {None}
    assert {r[0] for r in same.select(Standard.fit(same, "v").encode(F.col("v"))).collect()} == {0.0}
    values = [1.0, 2.0, 4.0, 100.0]
    assert midpoint_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]) == [np.quantile(values, q, method="midpoint") for q in (0.0, 0.25, 0.5, 1.0)]
    assert midpoint_quantiles(df.filter("v > 1e9"), "v", [0.5]) == [None]
    rng = np.random.default_rng(1)
    many = rng.integers(0, 50, 999).astype(float)
    wide = spark.createDataFrame([(float(x),) for x in many], "v double")
    assert midpoint_quantiles(wide, "v", [0.25, 0.5, 0.75], groups=7) == [np.quantile(many, q, method="midpoint") for q in (0.25, 0.5, 0.75)]
    o = Outliers(0.0, 10.0)
    assert one(spark, o.clip(F.lit(11.0))) == 10.0 and one(spark, o.impute(F.lit(None).cast("double"), 5.0)) == 5.0 and one(spark, o.flag(F.lit(None).cast("double"))) is None


def test_categories_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("c",)], "v string")
    c = Categories.fit(df, "v", most=2)
    assert c.values == ("c", "a") and c.rare == 3
    assert [one(spark, c.encode(F.lit(v))) for v in ("c", "a", "b", "new", None)] == [1, 2, 3, 3, None]
    assert [one(spark, c.inverse(F.lit(i))) for i in (1, 2, 3, 9, 0)] == ["c", "a", "rare_label", "rare_label", "rare_label"]


@pytest.mark.parametrize("stamp", ["2023-02-28 23:30:00", "2024-02-29 00:29:00", "2024-12-31 12:00:00"])
def test_cycles(spark, stamp):
    import calendar
    import datetime

    t = datetime.datetime.fromisoformat(stamp)
    days = calendar.monthrange(t.year, t.month)[1]
    doy = t.timetuple().tm_yday
    want = {("minute", "hour"): t.minute / 60, ("hour", "day"): (t.hour + (t.minute >= 30)) / 24, ("day", "week"): t.isoweekday() / 7, ("day", "month"): t.day / days, ("day", "year"): doy / (366 if calendar.isleap(t.year) else 365), ("month", "year"): t.month / 12, ("week", "year"): round(doy / 7) / 52.1775, ("week", "month"): round(t.day / 7, 1) / (days // 7)}
    for k, v in want.items():
        assert one(spark, chrono.RATIOS[k](F.lit(stamp).cast("timestamp"))) == pytest.approx(v)
    assert one(spark, chrono.to_timestamp(F.lit("31.12.2024"))).year == 2024 and one(spark, chrono.to_timestamp(F.lit("nonsense"))) is None


def test_text(spark):
    assert one(spark, text.slug(F.lit("  Héllo, World! "))) == "h_llo_world" and one(spark, text.slug(F.lit("!!"))) == "item"
    assert one(spark, text.sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    spans = one(spark, text.token_offsets(F.lit("😀 it's né-e!")))
    assert [(s["token"], s["start"], s["end"]) for s in spans] == [("😀", 0, 1), ("it's", 2, 6), ("né-e", 7, 11), ("!", 11, 12)]
    assert one(spark, text.key_values(F.lit("a: 1\nb:2\nnone\na: x:y\n: no name\nc:  \n"))) == {"a": "x:y", "b": "2"}
    assert one(spark, text.strip_tags(F.lit("&lt;b&gt;x&amp;amp;<i>y</i>"))) == "x&y"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))
    assert one(spark, vectors.euclid(a, b)) == 5.0 and one(spark, vectors.manhattan(a, b)) == 7.0
    p = one(spark, vectors.masked_softmax(F.array(F.lit(1.0), F.lit(1000.0), F.lit(1.0)), F.array(F.lit(True), F.lit(False), F.lit(True))))
    assert p == [0.5, 0.0, 0.5]
    assert one(spark, vectors.soft_assign(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0)), 0.0)) == [0.0, 1.0, 0.0]
    assert one(spark, vectors.margin(F.array(F.lit(1.0)))) == 0.0 and one(spark, vectors.normal_entropy(F.array(F.lit(0.5), F.lit(0.5)))) == pytest.approx(1.0)
    assert one(spark, vectors.as_probabilities(F.array(F.lit(3.0), F.lit(3.0)))) == [0.5, 0.5]


def test_sequences(spark):
    a = F.array(*[F.lit(i) for i in range(9)])
    assert one(spark, sequences.windows(a, 5, 2)) == [[0, 1, 2, 3, 4], [3, 4, 5, 6, 7]]
    assert one(spark, sequences.windows(F.array(F.lit(1)), 5, 2)) == [] and len(one(spark, sequences.windows(a, 2, 7))) == 8
    assert one(spark, sequences.shift_left(a, 2))[-3:] == [8, 0, 0] and one(spark, sequences.shift_right(a, 1))[:2] == [0, 0]
    assert one(spark, sequences.pad(F.array(F.lit(7)), 3, left=True)) == [0, 0, 7]
    x, y = sequences.fit_pair(a, F.array(F.lit(1), F.lit(2)), 6)
    assert (one(spark, F.size(x)), one(spark, F.size(y))) == (4, 2)
    d = one(spark, sequences.deleted_tokens(F.array(*[F.lit(i + 20) for i in range(200)]), F.lit(3), 1, 30))
    assert 100 < len(d["ids"]) < 180 and set(d["ids"]) < set(range(20, 220))


def test_silhouette_by_hand(spark):
    rows = [(0, [0.0], 0), (1, [1.0], 0), (2, [10.0], 1), (3, [12.0], 1), (4, [30.0], 2)]
    got = {r["k"]: r["silhouette"] for r in silhouette_values(spark.createDataFrame(rows, "k long, v array<double>, l int"), "k", "v", "l").collect()}
    assert got[0] == pytest.approx((11 - 1) / 11) and got[4] == 0.0
    assert {r["silhouette"] for r in silhouette_values(spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0)], "k long, v array<double>, l int"), "k", "v", "l").collect()} == {0.0}


def test_label_log(spark):
    log = spark.createDataFrame([("s", "t", 1, "label", 1.0), ("s", "t", 2, "retract", None), ("s", "t", 3, "label", 2.0), ("q", "t", 4, "label", 5.0), ("q", "t", 5, "retract", None)], "sample_id string, task_id string, seq long, op string, value double")
    assert [(r["sample_id"], r["value"]) for r in labels.current_state(log).collect()] == [("s", 2.0)]
    new = labels.append_events(log, spark.createDataFrame([("z", "t", "label", 1.0)], "sample_id string, task_id string, op string, value double"), ["sample_id"])
    assert new.first()["seq"] == 6
    lines = spark.createDataFrame([('{"sample_id":"a","task_id":"t","op":"label","seq":1}',), ("{broken",), ('{"sample_id":"a","task_id":"t","op":"label"}',), ('{"sample_id":"a","task_id":"t","op":"label","seq":2,"crc":1}',)], "value string")
    good, bad = labels.split_valid(lines, "sample_id string, task_id string, op string, seq long, crc long", ["sample_id", "task_id", "op", "seq"])
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["crc", "json", "missing seq"]
    cell = lambda t: one(spark, labels.parse_label_cell(F.lit(t)))
    assert cell("a| b") == (["a", "b"], None) and cell('{"value":["x","y"],"confidence":0.5}') == (["x", "y"], 0.5) and cell(None) is None


def test_spans(spark):
    tags = ["O", "B-X", "I-X", "O", "X", "X", "Y", None, "I-Y", "B-Y"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "k int, i int, tag string")
    got = sorted((r["first"], r["last"], r["label"]) for r in windows.tag_spans(df, "k", "i", "tag").collect())
    assert got == [(1, 2, "X"), (4, 5, "X"), (6, 6, "Y"), (8, 8, "Y"), (9, 9, "Y")]


def test_calibration(spark):
    rng = np.random.default_rng(4)
    s = rng.normal(size=400).round(1)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * s))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    knots = calibration.fit_isotonic(df, "s", "y")
    ps = [p for _, p in knots]
    assert ps == sorted(ps) and len(set(x for x, _ in knots)) == len(knots)
    a, b = calibration.fit_platt(df, "s", "y")
    sums = calibration.platt_sums(df, "s", "y", a, b)
    assert a > 1 and abs(sums[0]) < 1e-4 and abs(sums[1]) < 1e-4
    grid = spark.createDataFrame([(x / 10,) for x in range(-40, 41)], "s double")
    curve = [r[0] for r in grid.select(calibration.spline(F.col("s"), knots)).collect()]
    assert all(0 <= p <= 1 for p in curve) and all(p <= q + 1e-9 for p, q in zip(curve, curve[1:]))
    assert calibration.pool_violators(np.array([1.0, 0.0, 2.0]), np.ones(3)) == [(0, 2, 0.5), (2, 3, 2.0)]


def test_models(spark):
    df = generators.regression(spark, 500, noise=0.1)
    m = regression.fit_linear(df, "x", "y", steps=60)
    x = np.array([r["x"] for r in df.collect()])
    y = np.array([r["y"] for r in df.collect()])
    want = np.c_[np.ones(500), x] @ np.linalg.lstsq(np.c_[np.ones(500), x], y, rcond=None)[0]
    got = np.array([r[0] for r in df.select(m.predict(F.col("x"))).collect()])
    assert np.abs(got - want).max() < 1e-3
    c = generators.clusters(spark, 300, k=3, spread=0.3, seed=9)
    g = clustering.grow_centroids(c, "id", "x", most=4)
    assert g.best == 3 and set(g.centres) == {2, 3, 4}
    assert math.isfinite(cubic_clustering_criterion(c, "x", "label"))
    svd = projection.RunningSVD(2)
    for half in (0, 1):
        projection.update_svd(svd, c.filter(F.col("id") % 2 == half), "x")
    full = np.linalg.svd(np.array([r["x"] for r in c.collect()]), compute_uv=False)
    assert svd.sigma == pytest.approx(full) and svd.explained.sum() == pytest.approx(1.0)


def test_generators_do_not_depend_on_partitions(spark):
    for make in (generators.binary, generators.multiclass, generators.multilabel, generators.pinwheel, generators.signals, generators.decisions):
        df = make(spark, 40)
        assert sorted(map(str, df.collect())) == sorted(map(str, make(spark, 40).repartition(3).collect())) and df.count() == 40
    assert generators.images(spark, 4, 8).filter("size(x) = 8").count() == 4 and generators.phase_mix(spark, 3).count() == 3
    for task in ("copy", "reverse", "sort", "cipher", "add"):
        assert generators.token_tasks(spark, 5, task).filter("size(source) = size(target)").count() == 5


def test_datasets(spark, tmp_path):
    (tmp_path / "d.csv").write_text('﻿ID , Text,Note\n1,"a, b",x\n2,  ,y\n,third,\n', encoding="utf-8")
    s = {r["text"]: r for r in datasets.load_dataset(spark, f"{tmp_path}/d.csv").collect()}
    assert s["a, b"]["id"] == "1" and s["a, b"]["extra"] == {"note": "x"} and s["third"]["id"].startswith("row") and len(s) == 2
    (tmp_path / "d.jsonl").write_text('{"id": "1", "text": "a"}\n\n{"id": "1", "text": "b"}\n')
    with pytest.raises(ValueError, match="repeated"):
        datasets.load_dataset(spark, f"{tmp_path}/d.jsonl")
    assert datasets.column_conflicts([{"id": "a", "label_col": "text"}, {"id": "b", "pred_col": "b_labels"}]) == ["a: text is reserved"]
    assert datasets.file_digests(spark, f"{tmp_path}/d.csv").first()["length"] > 0


def test_audio(spark, tmp_path):
    rate = 8000
    x = (20_000 * np.sin(2 * np.pi * 1000 * np.arange(800) / rate)).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack("<800h", *x.tolist()))
    df = audio.read_wav(spark, f"{tmp_path}/a.wav")
    s = audio.spectra(df, "path", "signal", 256, 128).collect()
    assert len(s) == 5 and int(np.argmax(s[0]["spectrum"])) == 32
    edges = audio.band_edges(129, 8)
    assert edges[0] == 1 and edges[-1] == 129 and len(audio.pool_bands(audio.spectra(df, "path", "signal", 256, 128), "spectrum", edges).first()["bands"]) == 8
    assert len(audio.downsample(np.ones(100), 4)) == 25 and np.allclose(audio.hartley(audio.hartley(np.arange(8.0))) / 8, np.arange(8.0))


def test_pipeline(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "n double, c string")
    p = FeaturePipeline().min_max("n").categories("c", most=1)
    with pytest.raises(ValueError):
        p.min_max("n")
    assert p.validate(df) and not p.fit(df).validate(df)
    assert [tuple(r) for r in p.encode(df).collect()] == [(0.0, 1), (1.0, 2)]
    assert p.layout() == [("n_min_max", 0, 1), ("c_categories", 1, 1)] and p.category_outputs() == {1: 2} and p.numeric_outputs() == [0]
    assert expand_arrays(df.withColumn("v", F.array("n", "n")), {"v": 2}).columns == ["n", "c", "v_0", "v_1"]


def test_midpoint_quantiles_with_extreme_values(spark):
    """A few values of huge size don't push the rest into one cell; every cut stays exact."""
    rng = np.random.default_rng(6)
    values = [*rng.normal(0, 1, 3000).tolist(), *(1e3 + rng.random(500) * 1e-9).tolist(), 1e300, -1e300, 1e-300, 0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    assert midpoint_quantiles(df, "v", at, groups=16) == [np.quantile(values, q, method="midpoint") for q in at]


def test_isotonic_is_exact_on_many_skewed_scores(spark):
    rng = np.random.default_rng(7)
    s = np.r_[rng.random(20_000), 1e9]
    y = np.r_[rng.random(20_000) < s[:-1], True].astype(int)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "s double, y int").repartition(6)
    knots = calibration.fit_isotonic(df, "s", "y")
    order = np.argsort(s)
    want = [(s[order][a:b].mean(), m) for a, b, m in calibration.pool_violators(y[order].astype(float), np.ones(len(s)))]
    assert len(knots) == len(want) > 20 and np.allclose(knots, want)


def test_band_edges_rise_and_leave_out_zero_frequency():
    for bins, bands, least in ((129, 8, 1), (65, 8, 2), (20, 9, 2), (1025, 40, 1)):
        edges = audio.band_edges(bins, bands, least)
        assert edges[0] == 1 and edges[-1] == bins and min(np.diff(edges)) >= least
    with pytest.raises(ValueError):
        audio.band_edges(8, 8)


def test_samples_of_equal_text_get_ids_of_their_own(spark):
    from sparkwright.sources.datasets import as_samples, repeated_ids

    rows = as_samples(spark.createDataFrame([("a",), ("a",), ("b",)], "text string"))
    assert rows.count() == 3 and repeated_ids(rows).count() == 0


def test_candidates_over_many_partitions(spark):
    from sparkwright.operators.labels import candidates

    got = candidates(spark.range(500).withColumnRenamed("id", "k").repartition(9), "k", "s", 3).collect()
    pairs = {}
    for r in got:
        pairs.setdefault(r["k"], []).append(r["candidate"])
    assert len(pairs) == 500 and all(len(set(v)) == 3 and k not in v for k, v in pairs.items())


def test_hidden_and_infilled_spans(spark):
    from sparkwright.functions import sequences as S

    rows = [(i, list(range(100, 100 + n))) for i, n in enumerate([0, 1, 5, 4000, 900])] + [(9, None)]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    for r in df.select("k", "ids", S.span_boundaries(F.col("ids"), F.col("k"), 3, 1000).alias("c")).filter("ids is not null").collect():
        n, c = len(r["ids"]), r["c"]
        hidden = [i for i in range(n) if c["offset"][i] > 0]
        assert n < 900 or 0.1 < len(hidden) / n < 0.2
        for i in range(n):
            if i not in hidden:
                assert (c["ids"][i], c["labels"][i], c["left"][i], c["right"][i]) == (r["ids"][i], -100, -1, -1)
            else:
                assert c["labels"][i] == r["ids"][i] and c["left"][i] == i - c["offset"][i] and c["offset"][c["left"][i]] < 0 and c["offset"][c["right"][i]] < 0
    for r in df.select("k", "ids", S.infilled_spans(F.col("ids"), F.col("k"), 3).alias("c")).filter("ids is not null").collect():
        ids, labels, at = r["c"]["ids"], r["c"]["labels"], 0
        for x, y in zip(ids, labels, strict=True):
            if y < 0:
                assert x == r["ids"][at]
                at += 1
            else:
                at += y
        assert at == len(r["ids"]) and (at < 900 or 0.2 < (at - sum(y < 0 for y in labels)) / at < 0.4)
