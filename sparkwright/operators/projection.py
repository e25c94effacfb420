"""Projections: principal components, multiple correspondence analysis, an incremental SVD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster_metrics import scatter


def fix_signs(axes: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry is positive; of entries equal but for rounding, the first."""
    size = np.abs(axes)
    s = np.sign(axes[(size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0), np.arange(axes.shape[1])])
    return axes * np.where(s == 0, 1, s)


@dataclass
class Components:
    mean: np.ndarray
    std: np.ndarray
    axes: np.ndarray
    values: np.ndarray

    def project(self, vector: Column) -> Column:
        rows = self.axes / self.std[:, None]
        shift = self.mean @ rows
        return F.array(*[F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in rows[:, k]]), lambda a, b: a * b), F.lit(-float(shift[k])), lambda acc, x: acc + x) for k in range(rows.shape[1])])


def fit_pca(df: DataFrame, vector: str, components: int) -> Components:
    """Of the correlation matrix, which one scan gives."""
    n, mean, s = scatter(df, vector)
    std = np.sqrt(np.diag(s) / n)
    std = np.where(std > 0, std, 1.0)
    values, axes = np.linalg.eigh(s / n / np.outer(std, std))
    order = values.argsort()[::-1][:components]
    return Components(mean, std, fix_signs(axes[:, order]), values[order])


def mca(df: DataFrame, columns: list[str], components: int = 2) -> DataFrame:
    """column, category, coordinates: from the counts of pairs of categories (the Burt table), whatever the number of rows."""
    pairs = [df.groupBy(F.lit(a).alias("ca"), F.col(a).cast("string").alias("va"), F.lit(b).alias("cb"), F.col(b).cast("string").alias("vb")).count() for i, a in enumerate(columns) for b in columns[i:]]
    table = pairs[0]
    for p in pairs[1:]:
        table = table.union(p)
    rows = table.collect()  # a row for a pair of categories
    names = sorted({(r["ca"], r["va"]) for r in rows} | {(r["cb"], r["vb"]) for r in rows}, key=lambda t: (columns.index(t[0]), t[1] is None, t[1]))
    at = {k: i for i, k in enumerate(names)}
    burt = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = at[r["ca"], r["va"]], at[r["cb"], r["vb"]]
        burt[i, j] = burt[j, i] = r["count"]
    p = burt / burt.sum()
    mass = p.sum(axis=0)
    values, vectors = np.linalg.eigh((p - np.outer(mass, mass)) / np.sqrt(np.outer(mass, mass)))
    order = values.argsort()[::-1][:components]
    coords = fix_signs(vectors[:, order] / np.sqrt(mass)[:, None]) * np.sqrt(np.maximum(values[order], 0))
    return df.sparkSession.createDataFrame([(c, v, coords[i].tolist()) for (c, v), i in at.items()], "column string, category string, coordinates array<double>")


def _times(vector: Column, matrix: np.ndarray) -> Column:
    """Row vectors times a small matrix, by one product for a batch of rows; null for vectors that it doesn't fit."""

    @F.pandas_udf("array<double>")
    def product(rows: pd.Series) -> pd.Series:
        fits = [v is not None and len(v) == len(matrix) for v in rows]
        found = iter(np.stack(rows[fits].to_numpy()).astype(float) @ matrix if any(fits) else ())
        return pd.Series([next(found) if f else None for f in fits], dtype=object)

    v = vector.cast("array<double>")
    return F.when(~F.exists(v, F.isnull), product(v))


@dataclass
class RunningSVD:
    """The leading right singular vectors of all rows seen so far; older ones fade by `decay`."""

    rank: int
    decay: float = 1.0
    basis: np.ndarray | None = None
    sigma: np.ndarray | None = None
    energy: float = 0.0

    def merge(self, factor: np.ndarray) -> None:
        """Fold in a factor R of new rows X with R'R = X'X."""
        self.energy = self.energy * self.decay**2 + float((factor**2).sum())
        stacked = factor if self.basis is None else np.vstack([self.decay * self.sigma[:, None] * self.basis.T, factor])
        _, s, vt = np.linalg.svd(stacked, full_matrices=False)
        keep = s > 1e-10 * s[0]
        self.basis, self.sigma = fix_signs(vt[keep][: self.rank].T), s[keep][: self.rank]

    def project(self, vector: Column) -> Column:
        """The vector's coordinates on the components; null where the vector, or an item of it, is null or it has another length."""
        return _times(vector, self.basis)

    def restore(self, coordinates: Column) -> Column:
        """The vector behind coordinates; exact for rows seen if no component was cut off."""
        return _times(coordinates, self.basis.T)

    @property
    def explained(self) -> np.ndarray:
        return self.sigma**2 / self.energy


def update_svd(model: RunningSVD, batch: DataFrame, vector: str) -> RunningSVD:
    """Fold a batch (of a stream's foreachBatch, say): each task reduces its rows to one triangle, the driver merges triangles of d x d."""

    def reduce_rows(batches):
        r = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pd.DataFrame({"row": list(r)})

    tasks = batch.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    rows = tasks.mapInPandas(reduce_rows, "row array<double>")
    # a triangle for each task is shuffled and reduced again: at most 8 of d x d numbers meet the driver
    triangle = rows.repartition(8).select(F.col("row").alias("v")).mapInPandas(reduce_rows, "row array<double>").collect()
    if triangle:
        model.merge(np.array([r["row"] for r in triangle]))
    return model
