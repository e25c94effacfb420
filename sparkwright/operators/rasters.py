"""Matrices and rasters as cells (y, x, value): a two-way Hartley transform, basins, cells filled in from their neighbours."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
BESIDE = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in spark.checkpoint.dir; a folder of our own only where that is unset, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='sparkwright-')}")
    return df.checkpoint()


def hartley_2d(cells: DataFrame, height: int, width: int, block: int = 32) -> DataFrame:
    """u, v, value: the real less the imaginary part of the two-way Fourier transform; cells that are missing are zero.

    Two passes over lines of the matrix with a transposing shuffle between them: first the rows are transformed, `block` of
    them in a task at a time, then the columns of what came out. A task holds `block` lines, never the matrix.
    """

    def lines(pdf: pd.DataFrame, line: str, along: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(pdf[line].to_numpy(), return_inverse=True)
        full = np.zeros((len(own), size), np.complex128)
        np.add.at(full, (at, pdf[along].to_numpy()), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        return own, np.fft.fft(full, axis=1)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        own, f = lines(pdf, "y", "x", width)
        return pd.DataFrame({"y": np.repeat(own, width), "v": np.tile(np.arange(width), len(own)), "re": f.real.ravel(), "im": f.imag.ravel()})

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        own, f = lines(pdf, "v", "y", height)
        return pd.DataFrame({"u": np.tile(np.arange(height), len(own)), "v": np.repeat(own, height), "value": (f.real - f.imag).ravel()})

    first = cells.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    rows = first.groupBy(F.floor(F.col("y") / block).alias("_b")).applyInPandas(across, "y bigint, v bigint, re double, im double")
    return rows.groupBy(F.floor(F.col("v") / block).alias("_b")).applyInPandas(down, "u bigint, v bigint, value double")


def _met(cells: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """y, x and the value ny, nx, nvalue of each neighbour: every cell is sent to the places around it, so it is one equality join."""
    sent = cells.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("value").alias("nvalue"), F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps])).alias("d"))
    sent = sent.select((F.col("ny") + F.col("d.dy")).alias("y"), (F.col("nx") + F.col("d.dx")).alias("x"), "ny", "nx", "nvalue")
    return sent


def basins(cells: DataFrame) -> DataFrame:
    """y, x, value, by, bx: each cell with the bottom that water from it reaches, always running to the lowest of the eight cells around.

    Cells are ordered by (value, y, x), so that ties are settled and a flat drains to its first cell. Each cell points to its
    lowest neighbour, a bottom to itself, and pointers are doubled until all point to bottoms: as many joins as the
    logarithm of the longest way, each written to the checkpoint folder. Missing cells don't conduct.
    """
    rank = lambda v, y, x: F.struct(F.col(v).alias("v"), F.col(y).alias("y"), F.col(x).alias("x"))
    low = _met(cells, AROUND).groupBy("y", "x").agg(F.min(rank("nvalue", "ny", "nx")).alias("n"))
    own = cells.select("y", "x", "value").join(low, ["y", "x"], "left")
    goes = F.coalesce(F.col("n") < rank("value", "y", "x"), F.lit(False))
    ways = cut(own.select("y", "x", "value", F.when(goes, F.col("n.y")).otherwise(F.col("y")).alias("by"), F.when(goes, F.col("n.x")).otherwise(F.col("x")).alias("bx")))
    while True:
        on = ways.select(F.col("y").alias("by"), F.col("x").alias("bx"), F.col("by").alias("ty"), F.col("bx").alias("tx"))
        moved = cut(ways.join(on, ["by", "bx"]).select("y", "x", "value", F.col("ty").alias("by"), F.col("tx").alias("bx"), ((F.col("ty") != F.col("by")) | (F.col("tx") != F.col("bx"))).alias("went")))
        ways = moved.drop("went")
        if moved.filter("went").isEmpty():
            return ways


def infill(cells: DataFrame, height: int, width: int) -> DataFrame:
    """cells in which those inside whose y and x are both even, or both odd, become the mean of the four beside them."""
    around = _met(cells, BESIDE).groupBy("y", "x").agg(F.avg("nvalue").alias("_mean"))
    between = (F.col("y") % 2 == F.col("x") % 2) & F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2)
    out = cells.select("y", "x", "value").join(around, ["y", "x"], "left")
    return out.select("y", "x", F.when(between, F.col("_mean")).otherwise(F.col("value")).alias("value"))
