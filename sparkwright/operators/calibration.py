"""Probability calibration: Platt's sigmoid, isotonic steps, monotone splines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rasters import cut


def platt_sums(df: DataFrame, score: str, label: str, a: float, b: float) -> tuple[float, ...]:
    """Gradient (2), Hessian (3) and loss at (a, b), with smoothed targets, in one aggregate."""
    pos, neg = df.agg(F.sum(F.col(label).cast("double")), F.sum(1 - F.col(label).cast("double"))).first()
    return _platt_sums(df, score, label, a, b, pos, neg)


def _platt_sums(df, score, label, a, b, pos, neg):
    t = F.when(F.col(label) == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    s = F.col(score)
    z = a * s + b
    p = 1 / (1 + F.exp(-z))
    w = p * (1 - p)
    loss = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
    return tuple(df.agg(F.sum((p - t) * s), F.sum(p - t), F.sum(w * s * s), F.sum(w * s), F.sum(w), F.sum(loss)).first())


def fit_platt(df: DataFrame, score: str, label: str, steps: int = 100, tolerance: float = 1e-10) -> tuple[float, float]:
    """(a, b) of sigmoid(a s + b) by Newton steps, each halved up to ten times until the loss falls."""
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    pos, neg = rows.agg(F.sum(F.col(label).cast("double")), F.sum(1 - F.col(label).cast("double"))).first()
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    ga, gb, haa, hab, hbb, loss = _platt_sums(rows, score, label, a, b, pos, neg)
    for _ in range(steps):
        if max(abs(ga), abs(gb)) < tolerance * max(1.0, pos + neg):
            break
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        for half in range(11):
            step = 0.5**half
            new = _platt_sums(rows, score, label, a + step * da, b + step * db, pos, neg)
            if new[5] < loss + 1e-4 * step * (ga * da + gb * db):
                break
        else:
            break
        a, b = a + step * da, b + step * db
        done = abs(loss - new[5]) < tolerance * (1 + abs(loss))
        ga, gb, haa, hab, hbb, loss = new
        if done:
            break
    return a, b


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(a * score + b)))


def pool_violators(y: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float]]:
    """Blocks (begin, end, mean) of the best rising fit; one pass with a stack."""
    blocks: list[list[float]] = []
    for i, (v, k) in enumerate(zip(y.tolist(), w.tolist(), strict=True)):
        blocks.append([i, i + 1, v, k])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, end, v1, k1 = blocks.pop()
            b = blocks[-1]
            b[1], b[2], b[3] = end, (b[2] * b[3] + v1 * k1) / (b[3] + k1), b[3] + k1
    return [(int(a), int(b), m) for a, b, m, _ in blocks]


def _blocks(table: pd.DataFrame) -> pd.DataFrame:
    """Rows (s, sy, y, n) in the order of s -> one row for each block: least s, and the sums of s over rows, of y and of n."""
    cuts = [a for a, _, _ in pool_violators((table["y"] / table["n"]).to_numpy(), table["n"].to_numpy(float))]
    sums = {c: np.add.reduceat(table[c].to_numpy(float), cuts) if cuts else [] for c in ("sy", "y", "n")}
    return pd.DataFrame({"g": table["g"].to_numpy()[cuts], "s": table["s"].to_numpy(float)[cuts], **sums})


def _pool(batches):
    """Blocks of each stretch g; rows come in the order of g and s, so only the last stretch seen is held."""
    held = None
    for pdf in batches:
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        runs = [_blocks(run) for _, run in rows.groupby("g", sort=False)]
        yield from runs[:-1]
        held = runs[-1] if runs else held
    if held is not None:
        yield held


def _regroup(ends: list, size: int) -> list[tuple[int, bool, int]] | None:
    """(stretch, upper half, new stretch) from a row for each stretch in order; None where the means rise from each to the next.

    Stretches are cut in half and joined anew, up to about `size` blocks each, but never cut where the means fall. Inside a
    stretch they rise, so that at most the halves on both sides of such a place and stretches of one block have to stay together.
    """
    if all(a["last"] < b["first"] for a, b in zip(ends, ends[1:], strict=False)):
        return None
    out, new, held, before = [], 0, 0, None
    for e in ends:
        falls = before is not None and before >= e["first"]
        for upper, n in ((False, e["lower"]), (True, e["n"] - e["lower"])):
            if not n:
                continue
            if held and held + n > size and not falls:
                new, held = new + 1, 0
            out.append((e["g"], upper, new))
            held, falls = held + n, False
        before = e["last"]
    return out


def isotonic_table(df: DataFrame, score: str, label: str, parts: int | None = None) -> DataFrame:
    """x, p: the blocks of the best rising fit by mean score, exact at every size, as a table that never passes one task or the driver.

    Equal scores are pooled first. Each task then pools the violators of its own stretch of scores; where the means still fall
    from one stretch to the next, the stretches are cut and joined anew around those places and pooled again, which comes to
    the same fit in whatever order violators are pooled. Only a row for each stretch comes to the driver. Every pass takes
    away a block for each such place, so the passes end. Null scores and labels don't count; no rows give no blocks.
    """
    s = F.col(score).cast("double")
    rows = df.filter(s.isNotNull() & F.col(label).isNotNull()).groupBy(s.alias("s")).agg(F.sum(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("n"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = "g int, s double, sy double, y double, n double"
    ranges = rows.select("s", (F.col("s") * F.col("n")).alias("sy"), "y", "n").repartitionByRange(parts, "s").sortWithinPartitions("s")
    blocks = cut(ranges.select(F.spark_partition_id().alias("g"), "*").mapInPandas(_pool, shape))
    mean = F.col("y") / F.col("n")
    while True:
        middle = blocks.groupBy("g").agg(F.percentile_approx("s", 0.5).alias("middle"))
        half = blocks.join(F.broadcast(middle), "g").withColumn("upper", F.col("s") >= F.col("middle"))  # a row for each stretch
        ends = half.groupBy("g").agg(F.min_by(mean, "s").alias("first"), F.max_by(mean, "s").alias("last"), F.count("*").alias("n"), F.count_if(~F.col("upper")).alias("lower")).orderBy("g").collect()
        moves = _regroup(ends, max(2, -(-sum(e["n"] for e in ends) // parts)))
        if moves is None:
            return blocks.select((F.col("sy") / F.col("n")).alias("x"), mean.alias("p"))
        to = F.broadcast(df.sparkSession.createDataFrame(moves, "g int, upper boolean, _to int"))
        joined = half.join(to, ["g", "upper"]).select(F.col("_to").alias("g"), "s", "sy", "y", "n")
        blocks = cut(joined.repartition(parts, "g").sortWithinPartitions("g", "s").mapInPandas(_pool, shape))


def fit_isotonic(df: DataFrame, score: str, label: str) -> list[tuple[float, float]]:
    """The knots (score, probability) of isotonic_table as a list, for curves whose knots become literals."""
    return sorted((r["x"], r["p"]) for r in isotonic_table(df, score, label).collect())


def predict_isotonic(df: DataFrame, score: str, knots: DataFrame, name: str = "p", parts: int | None = None) -> DataFrame:
    """df with `name`: linear between the knots (x, p) of a table of any size, level outside; null for a null score or without knots.

    Rows and knots are range-partitioned together by score, rows of equal score spread by a running number. Each row takes the
    nearest knots below and above it in its task; where a task has none, one row for each task tells those of the tasks around.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = knots.select(F.col("x").alias("_s"), F.lit(0).alias("_tag"), F.lit(0).cast("long").alias("_salt"), F.struct("x", "p").alias("_knot"))
    right = df.select(F.col(score).cast("double").alias("_s"), F.lit(1).alias("_tag"), F.monotonically_increasing_id().alias("_salt"), F.struct("*").alias("_row"))
    order = ["_s", "_tag", "_salt"]
    # stored, as a range partitioning draws its bounds anew each time it runs: rows and the knots around have to see the same tasks
    both = cut(right.unionByName(left, allowMissingColumns=True).repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()))

    own = both.filter("_tag = 0").groupBy("_pid").agg(F.min("_knot").alias("first"), F.max("_knot").alias("last"))
    tasks = df.sparkSession.range(parts).select(F.col("id").cast("int").alias("_pid")).join(own, "_pid", "left")
    below, above = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    around = tasks.select("_pid", F.last("last", True).over(below).alias("_below"), F.last("first", True).over(above).alias("_above"))

    up, down = Window.partitionBy("_pid").orderBy(*order), Window.partitionBy("_pid").orderBy(*[F.desc(c) for c in order])
    near = both.withColumn("_lo", F.last("_knot", True).over(up)).withColumn("_hi", F.last("_knot", True).over(down)).filter("_tag = 1")
    near = near.join(F.broadcast(around), "_pid").select("_s", "_row", F.coalesce("_lo", "_below").alias("lo"), F.coalesce("_hi", "_above").alias("hi"))
    x0, y0, x1, y1 = (F.col(c) for c in ("lo.x", "lo.p", "hi.x", "hi.p"))
    value = F.when(F.col("_s").isNull(), None).when(F.col("lo").isNull(), y1).when(F.col("hi").isNull(), y0).otherwise(y0 + (y1 - y0) * (F.col("_s") - x0) / (x1 - x0))
    return near.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c != name], value.alias(name))


def interpolate(score: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, level outside."""
    xs = F.array(*[F.lit(x) for x, _ in knots])
    ys = F.array(*[F.lit(y) for _, y in knots])
    at = F.size(F.filter(xs, lambda x: x <= score))
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    return F.when(score.isNull(), None).when(at == 0, knots[0][1]).when(at == len(knots), knots[-1][1]).otherwise(y0 + (y1 - y0) * (score - x0) / (x1 - x0))


def monotone_slopes(knots: list[tuple[float, float]]) -> list[float]:
    """Slopes at the knots that keep a cubic spline rising: means of the neighbouring secants, scaled where they are too steep."""
    x, y = np.array(knots).T
    if len(x) < 2:
        return [0.0] * len(x)
    d = np.diff(y) / np.diff(x)
    m = np.r_[d[0], (d[:-1] + d[1:]) / 2, d[-1]]
    for i, s in enumerate(d):
        if s == 0:
            m[i] = m[i + 1] = 0.0
            continue
        a, b = m[i] / s, m[i + 1] / s
        if (size := a * a + b * b) > 9:
            m[i], m[i + 1] = 3 / np.sqrt(size) * a * s, 3 / np.sqrt(size) * b * s
    return m.tolist()


def spline(score: Column, knots: list[tuple[float, float]]) -> Column:
    """Cubic Hermite curve through the knots, within 0 and 1, level outside."""
    slopes = monotone_slopes(knots)
    xs, ys, ms = (F.array(*[F.lit(float(v)) for v in part]) for part in ([x for x, _ in knots], [y for _, y in knots], slopes))
    at = F.size(F.filter(xs, lambda x: x <= score))
    x0, x1 = F.get(xs, at - 1), F.get(xs, at)
    h = x1 - x0
    t = (score - x0) / h
    curve = (2 * t * t * t - 3 * t * t + 1) * F.get(ys, at - 1) + (t * t * t - 2 * t * t + t) * h * F.get(ms, at - 1) + (3 * t * t - 2 * t * t * t) * F.get(ys, at) + (t * t * t - t * t) * h * F.get(ms, at)
    inside = F.when(at == 0, knots[0][1]).when(at == len(knots), knots[-1][1]).otherwise(curve)
    return F.when(score.isNull(), None).otherwise(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)))
