"""Long series as rows: moments by position, resolution pyramids, dyadic spectra, complex spectra and back, wavelets.

A series is rows of keys, position (from 0) and value. No operator gathers a series in a row or in a task: each row is sent
to the outputs it takes part in, and sums by output are made up in every task before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rasters import cut

EPSILON = 1e-12


def series_positions(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Add each row's place in its series, from 0. A range sort cuts even one huge series over all tasks; counts by task are added.

    Sorted rows are stored with their task and their place in it, as a range sort draws its bounds anew, and may join its
    tasks otherwise, each time it runs: counts and rows have to come from one and the same cut. A null key is a key.
    """
    placed = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    task, names = F.shiftright("_at", 33), [f"_key{i}" for i in range(len(keys))]
    sizes = placed.groupBy(task.alias("_task"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_task", *names, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    met = task == F.col("_task")
    for k, n in zip(keys, names, strict=True):
        met &= F.col(k).eqNullSafe(F.col(n))
    # without keys, a row for each task
    return placed.join(start if keys else F.broadcast(start), met).select(*df.columns, (F.col("_start") + F.col("_at")).alias(name))


def position_moments(df: DataFrame, column: str) -> DataFrame:
    """pos, n, mean, std, least, most over all rows, for each position of an array column; null and NaN items don't count.

    One pass: each task merges its own rows, so that one row for a task and position is shuffled. Arrays may differ in length.
    """
    rows = df.select(F.posexplode(column).alias("pos", "x")).filter(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy("pos").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most"))


def low_pass(factor: int, reach: int | None = None) -> list[float]:
    """Symmetric taps of a windowed sinc that cuts at the new half rate; 2 reach + 1 of them, their sum 1."""
    reach = 10 * factor if reach is None else reach
    k = np.arange(-reach, reach + 1)
    taps = np.sinc(k / factor) * (0.54 + 0.46 * np.cos(math.pi * k / max(reach, 1)))
    return (taps / taps.sum()).tolist()


def downsample(rows: DataFrame, keys: list[str], factor: int, pos: str = "pos", value: str = "value", reach: int | None = None, block: int = 65_536) -> DataFrame:
    """keys, pos, value: every factor-th value after a zero-phase low pass, so that what the new rate can't hold doesn't fold back.

    Each series is cut into blocks of positions, and a block borrows the filter's reach of rows from both neighbours, so
    tasks are bounded by the block, not by the series. Where rows are missing (the ends, gaps, null values) the taps of
    those present are weighed up to 1. A place of the result stands if a row stands among the `factor` places it covers.
    """
    if factor == 1:
        return rows.select(*keys, pos, value)
    taps = np.array(low_pass(factor, reach))
    reach, block = len(taps) // 2, -(-block // factor) * factor
    at = F.col(pos)
    touched = F.explode(F.sequence(F.greatest(F.floor((at - reach - factor) / block), F.lit(0)), F.floor((at + reach) / block)))
    parts = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(pos).cast("long").alias("_pos"), F.col(value).cast("double").alias("_x"), touched.alias("_block"))
    names = [f"_k{i}" for i in range(len(keys))]
    parts = parts.toDF(*names, "_pos", "_x", "_block")
    fields = ", ".join(f"{n} {parts.schema[n].dataType.simpleString()}" for n in names)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(pdf["_block"].iloc[0]) * block
        x, here = np.zeros(block + 2 * reach), np.zeros(block + 2 * reach)
        i = pdf["_pos"].to_numpy() - low + reach
        own = (i >= 0) & (i < len(x))
        x[i[own]], here[i[own]] = pdf["_x"].to_numpy()[own], 1.0
        stands = here[reach : reach + block].reshape(-1, factor).any(axis=1)
        m = np.flatnonzero(stands)
        total, weight = (np.convolve(a, taps, "valid")[::factor][m] for a in (x, here))  # taps are symmetric
        out = pd.DataFrame({"pos": low // factor + m, "value": np.where(np.abs(weight) > EPSILON, total / np.where(weight == 0, 1, weight), 0.0)})
        for n in names:
            out.insert(0, n, pdf[n].iloc[0])
        return out[[*names, "pos", "value"]]

    out = parts.groupBy(*names, "_block").applyInPandas(reduce, f"{fields + ', ' if fields else ''}pos bigint, value double")
    return out.toDF(*keys, pos, value)


def pyramid(rows: DataFrame, keys: list[str], factors: list[int], pos: str = "pos", value: str = "value", **more) -> DataFrame:
    """level, keys, pos, value: the series itself as level 0, and each level a downsampling of the one before."""
    level = rows.select(*keys, F.col(pos).cast("long").alias(pos), F.col(value).cast("double").alias(value))
    out = level.select(F.lit(0).alias("level"), "*")
    for i, factor in enumerate(factors):
        level = downsample(level, keys, factor, pos, value, **more)
        out = out.unionByName(level.select(F.lit(i + 1).alias("level"), "*"))
    return out


def hann(i: Column, size: Column) -> Column:
    return F.when(size > 1, 0.5 - 0.5 * F.cos(2 * math.pi * i / (size - 1))).otherwise(F.lit(1.0))


def dyadic_power(rows: DataFrame, keys: list[str], least: int, n_fft: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """keys, level, win, freq, power: level k cuts a series into 2^k tapered windows, down to windows of at least `least` values.

    All levels share the frequencies 0 to n_fft div 2: a longer window is folded onto n_fft places, a shorter one padded. Power is
    one-sided and divided by the taper's energy and the series' variance, so that noise gives the same at every level. A
    row is sent to one window of each level and summed by window and place in each task; only those sums meet the frequencies.
    Series of under `least` values (4 at the least) give none. The series' end is padded with zeros to whole windows.
    """
    if least < 4:
        raise ValueError("windows of under 4 values have no taper to speak of")
    x = F.col(value).cast("double")
    whole = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.stddev_pop(x).alias("_sd")).filter(F.col("_n") >= least)
    top = F.floor(F.log2(F.floor(F.col("_n") / least))).cast("int")
    levels = whole.select(*keys, "_n", "_sd", F.pow(F.lit(2.0), top).cast("long").alias("_most"), F.explode(F.sequence(F.lit(0), top)).alias("level"))
    size = (F.ceil(F.col("_n") / F.col("_most")) * F.col("_most") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    levels = levels.select(*keys, "_sd", "level", size.alias("_size"))
    each = rows.join(levels, keys)
    i = F.col(pos) % F.col("_size")
    folded = each.groupBy(*keys, "level", "_size", "_sd", F.floor(F.col(pos) / F.col("_size")).alias("win"), (i % n_fft).alias("_at")).agg(F.sum(x * hann(i, F.col("_size"))).alias("_x"))
    turn = 2 * math.pi / n_fft * ((F.col("freq") * F.col("_at")) % n_fft)
    waves = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_fft // 2))).alias("freq"))
    sums = waves.groupBy(*keys, "level", "_size", "_sd", "win", "freq").agg(F.sum(F.col("_x") * F.cos(turn)).alias("_re"), F.sum(-F.col("_x") * F.sin(turn)).alias("_im"))
    paired = F.when((F.col("freq") > 0) & (2 * F.col("freq") < n_fft), 2.0).otherwise(1.0)
    energy = 0.375 * (F.col("_size") - 1) * F.pow(F.col("_sd") + EPSILON, F.lit(2.0))
    return sums.select(*keys, "level", "win", "freq", (paired * (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")) / energy).alias("power"))


# complex columns: struct(re, im)


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def polar(size: Column, angle: Column) -> Column:
    return complex_of(size * F.cos(angle), size * F.sin(angle))


def times(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def magnitude(c: Column) -> Column:
    return F.hypot(c["re"], c["im"])


def angle(c: Column) -> Column:
    return F.atan2(c["im"], c["re"])


def mod_relu(c: Column, bias: float) -> Column:
    """The value with its magnitude raised by bias, zero where that is below zero; the angle stays."""
    r = magnitude(c)
    by = F.when(r > 0, F.greatest(r + bias, F.lit(0.0)) / r).otherwise(0.0)
    return complex_of(c["re"] * by, c["im"] * by)


def _paired(freq: Column, size: int) -> Column:
    return F.when((freq > 0) & (2 * freq < size), 2.0).otherwise(1.0)


def spectra(rows: DataFrame, keys: list[str], taper: list[float], step: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """keys, win, freq, c: the complex spectrum of each whole tapered window, windows beginning every `step` values."""
    size, k = len(taper), F.array(*[F.lit(float(x)) for x in taper])
    first = F.greatest(F.ceil((F.col(pos) - size + 1) / step), F.lit(0))
    each = rows.select(*keys, F.col(pos).alias("_pos"), F.col(value).cast("double").alias("_x"), F.explode(F.sequence(first, F.floor(F.col(pos) / step))).alias("win"))
    whole = rows.groupBy(*keys).agg(F.max(pos).alias("_last"))
    each = each.join(whole, keys).filter(F.col("win") * step + size - 1 <= F.col("_last")) if keys else each.crossJoin(F.broadcast(whole)).filter(F.col("win") * step + size - 1 <= F.col("_last"))
    i = (F.col("_pos") - F.col("win") * step).cast("int")
    each = each.select(*keys, "win", i.alias("_i"), (F.col("_x") * F.get(k, i)).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(size // 2))).alias("freq"))
    turn = 2 * math.pi / size * ((F.col("freq") * F.col("_i")) % size)
    return each.groupBy(*keys, "win", "freq").agg(complex_of(F.sum(F.col("_x") * F.cos(turn)), F.sum(-F.col("_x") * F.sin(turn))).alias("c"))


def power(c: Column, freq: Column, taper: list[float]) -> Column:
    """One-sided power of a spectrum's value, divided by the taper's energy."""
    return (c["re"] * c["re"] + c["im"] * c["im"]) * _paired(freq, len(taper)) / sum(x * x for x in taper)


def from_power(p: Column, phase: Column, freq: Column, taper: list[float]) -> Column:
    """The spectrum's value back from its power and its phase."""
    return polar(F.sqrt(p * sum(x * x for x in taper) / _paired(freq, len(taper))), phase)


def inverse_spectra(found: DataFrame, keys: list[str], taper: list[float], step: int) -> DataFrame:
    """keys, pos, value from keys, win, freq, c: each frequency gives its share of each value, overlapping windows are added
    and divided by the sum of the squared taper. Places that only the taper's zeros cover are left out."""
    size, k = len(taper), F.array(*[F.lit(float(x)) for x in taper])
    each = found.select(*keys, "win", "freq", "c", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_i"))
    turn = 2 * math.pi / size * ((F.col("freq") * F.col("_i")) % size)
    share = _paired(F.col("freq"), size) * (F.col("c.re") * F.cos(turn) - F.col("c.im") * F.sin(turn)) / size
    w = F.get(k, F.col("_i"))
    # the weight of a window counts once, with its frequency 0
    sums = each.groupBy(*keys, (F.col("win") * step + F.col("_i")).alias("pos")).agg(F.sum(share * w).alias("_x"), F.sum(F.when(F.col("freq") == 0, w * w).otherwise(0.0)).alias("_w"))
    return sums.filter(F.col("_w") > EPSILON).select(*keys, "pos", (F.col("_x") / F.col("_w")).alias("value"))


# wavelets


def haar_step(rows: DataFrame, keys: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """keys, pos, low, high: neighbours (2i, 2i+1) as (a + b) / sqrt 2 and (b - a) / sqrt 2. The last of an odd number meets the first."""
    half = math.sqrt(0.5)
    x = F.col(value).cast("double")
    pair = F.floor(F.col(pos) / 2)
    ends = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.when(F.col(pos) == 0, x)).alias("_first"))
    pairs = rows.groupBy(*keys, pair.alias("_p")).agg(F.max(F.when(F.col(pos) % 2 == 0, x)).alias("_a"), F.max(F.when(F.col(pos) % 2 == 1, x)).alias("_b"))
    odd = ends.filter("_n % 2 = 1").select(*keys, F.floor(F.col("_n") / 2).alias("_p"), "_first")
    met = pairs.join(odd, [*keys, "_p"], "left").withColumn("_b", F.coalesce("_b", "_first"))
    return met.select(*keys, F.col("_p").alias(pos), ((F.col("_a") + F.col("_b")) * half).alias("low"), ((F.col("_b") - F.col("_a")) * half).alias("high"))


def haar(rows: DataFrame, keys: list[str], levels: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """level (from 1), keys, pos, low, high: each level splits the averages of the one before. Each is one grouping by pos div 2."""
    now, out = rows.select(*keys, pos, value), None
    for i in range(levels):
        found = haar_step(now, keys, pos, value)
        part = found.select(F.lit(i + 1).alias("level"), "*")
        out, now = part if out is None else out.unionByName(part), found.select(*keys, pos, F.col("low").alias(value))
    return out


def haar_back(found: DataFrame, keys: list[str], sizes: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """keys, pos, value from one level's low and high; sizes: keys, n. For an even n the inverse of haar_step(), for an odd one its
    adjoint, in which the pair that wraps around adds to the first value."""
    half = math.sqrt(0.5)
    two = F.explode(F.array(F.struct((2 * F.col(pos)).alias("_p"), ((F.col("low") - F.col("high")) * half).alias("_x")), F.struct((2 * F.col(pos) + 1).alias("_p"), ((F.col("low") + F.col("high")) * half).alias("_x"))))
    each = found.join(sizes.select(*keys, F.col("n").alias("_n")), keys).select(*keys, "_n", two.alias("t"))
    return each.groupBy(*keys, (F.col("t._p") % F.col("_n")).alias(pos)).agg(F.sum("t._x").alias(value))
