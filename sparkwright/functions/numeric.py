"""Numeric feature encoders: min-max and standard scaling, midpoint quartiles, outliers, imputation, running moments.

Fitting is one aggregate over the table; the fitted numbers become literals of a projection, so encoding adds
no join and no shuffle, and pruning and push-down still reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def finite(column: str) -> Column:
    """The column as a double with NaN as null, so that aggregates skip it."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


@dataclass(frozen=True)
class MinMax:
    low: float
    high: float

    @classmethod
    def fit(cls, df: DataFrame, column: str, before: MinMax | None = None) -> MinMax:
        row = df.agg(F.min(finite(column)), F.max(finite(column))).first()
        low, high = row[0], row[1]
        return cls(low, high) if before is None else cls(min(low, before.low), max(high, before.high))

    def encode(self, value: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
        """A column of one value has no range: null rather than a division by zero."""
        span = F.nullif(F.lit(self.high - self.low), F.lit(0.0))
        return (value - F.lit(self.low)) / span * F.lit(to[1] - to[0]) + F.lit(to[0])

    def inverse(self, value: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
        return (value - F.lit(to[0])) / F.lit(to[1] - to[0]) * F.lit(self.high - self.low) + F.lit(self.low)


@dataclass(frozen=True)
class Standard:
    """Mean and population deviation; a tiny constant keeps constant columns finite."""

    mean: float
    std: float

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> Standard:
        return cls(*df.agg(F.avg(finite(column)), F.stddev_pop(finite(column))).first())

    def encode(self, value: Column) -> Column:
        return (value - F.lit(self.mean)) / F.lit(self.std + EPSILON)

    def inverse(self, value: Column) -> Column:
        return value * F.lit(self.std + EPSILON) + F.lit(self.mean)


def midpoint_quantiles(df: DataFrame, column: str, at: list[float], groups: int = 4096) -> list[float | None]:
    """Exact quantiles that lie midway between the two order statistics around the position q (n - 1).

    No order passes one task. Values are counted by distinct value (partial sums before the shuffle); a histogram of `groups`
    cells then finds the cells that hold the wanted ranks, and only those are cut again, until each has at most `groups`
    distinct values, which come to the driver. The first cut is even on a logarithmic scale, so that single extreme
    values don't push all others into one cell, the later ones are even between the least and greatest value of a cell.
    """
    values = df.select((finite(column) + F.lit(0.0)).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    whole = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n"), F.count("*").alias("distinct")).first()
    if not whole["n"]:
        return [None] * len(at)
    places = [q * (whole["n"] - 1) for q in at]
    found: dict[int, float] = {}
    open_ = [(whole, 0, {int(x // 1) for x in places} | {int(-(-x // 1)) for x in places}, F.asinh("v"))]
    while open_:
        cell, before, ranks, scale = open_.pop()
        inside = values.filter(F.col("v").between(cell["low"], cell["high"]))
        if cell["distinct"] <= groups:
            for r in sorted(inside.collect()):
                found |= {k: r["v"] for k in ranks if before <= k < before + r["n"]}
                before += r["n"]
            continue
        ends = inside.agg(F.min(scale), F.max(scale)).first()
        width = (ends[1] - ends[0]) / groups or 1.0
        # the floor may round, but it never falls as v rises, so the cells follow one another
        parts = inside.groupBy(F.floor((scale - ends[0]) / width).alias("c")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
        for part in sorted(parts, key=lambda r: r["c"]):
            if own := {k for k in ranks if before <= k < before + part["n"]}:
                open_.append((part, before, own, F.col("v")))
            before += part["n"]
    return [(found[int(x // 1)] + found[int(-(-x // 1))]) / 2 for x in places]


@dataclass(frozen=True)
class Outliers:
    """Bounds at `extension` interquartile ranges beyond the midpoint quartiles."""

    low: float
    high: float

    @classmethod
    def fit(cls, df: DataFrame, column: str, extension: float = 2.0) -> Outliers:
        q1, q3 = midpoint_quantiles(df, column, [0.25, 0.75])
        return cls(q1 - extension * (q3 - q1), q3 + extension * (q3 - q1))

    def flag(self, value: Column) -> Column:
        return (value > self.high) | (value < self.low)

    def clip(self, value: Column) -> Column:
        return F.least(F.greatest(value, F.lit(self.low)), F.lit(self.high))

    def impute(self, value: Column, by: float) -> Column:
        """Outliers and nulls take the fitted mean or median, which is taken over all values, outliers included."""
        return F.when(value.isNull() | self.flag(value), F.lit(by)).otherwise(value)


def merge_moments(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column) -> tuple[Column, Column, Column]:
    """(n, mean, std) of two samples together from their counts, means and deviations."""
    n = n1 + n2
    mean = (n1 * m1 + n2 * m2) / n
    within = s1 * s1 * (n1 - 1) + s2 * s2 * (n2 - 1)
    between = n1 * (m1 - mean) * (m1 - mean) + n2 * (m2 - mean) * (m2 - mean)
    return n, mean, F.sqrt((within + between) / (n - 1))
