"""Clusterings fitted by aggregates: growing centroids, and a batch self-organising map on a latent lattice."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster_metrics import scatter, silhouette_by_centres, silhouette_score
from .nearest import distances, nearest


def _assign_sums(df: DataFrame, vector: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, sum, squared error) of each centre: tasks add up their own rows, a row for a centre and task is shuffled."""

    def partial(batches):
        k, d = centres.shape
        n, s, e = np.zeros(k), np.zeros((k, d)), np.zeros(k)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                dist = distances(x, centres)
                at = dist.argmin(axis=1)
                n += np.bincount(at, minlength=k)
                np.add.at(s, at, x)
                e += np.bincount(at, dist[np.arange(len(x)), at] ** 2, minlength=k)
        yield pd.DataFrame({"k": np.arange(k), "n": n, "s": list(s), "e": e})

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null").mapInPandas(partial, "k int, n double, s array<double>, e double")
    parts = rows.groupBy("k").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(centres.shape[1])]).orderBy("k").collect()
    return np.array([r["n"] for r in parts]), np.array([[r[f"s{i}"] for i in range(centres.shape[1])] for r in parts]), np.array([r["e"] for r in parts])


@dataclass
class Growth:
    """Centres and silhouette for each number of clusters tried."""

    centres: dict[int, np.ndarray] = field(default_factory=dict)
    silhouettes: dict[int, float] = field(default_factory=dict)

    @property
    def best(self) -> int:
        return max(self.silhouettes, key=lambda k: (self.silhouettes[k], -k))

    def predict(self, df: DataFrame, vector: str, k: int | None = None) -> DataFrame:
        return nearest(df, vector, list(enumerate(self.centres[k or self.best].tolist())))


def grow_centroids(df: DataFrame, key: str, vector: str, most: int = 8, iterations: int = 20, tolerance: float = 1e-3, score: str = "pairs") -> Growth:
    """From two centres to `most`: settle by Lloyd steps, score, then split the cluster with the largest error.

    A split moves its two halves apart along the cluster's first principal axis by the deviation there. Each Lloyd step is
    one scan with map-side sums over vectors that are stored once. score: "pairs" for silhouettes over all pairs of rows, which is
    quadratic work; "squared" for exact ones over squared distances and "centres" for simplified ones, both in one pass; "error" for
    the squared error alone.
    """
    if score not in ("pairs", "squared", "centres", "error"):
        raise ValueError(f"unknown score {score}")
    df = df.select(key, F.col(vector).cast("array<double>").alias(vector)).filter(F.col(vector).isNotNull()).persist()
    try:
        return _grow(df, key, vector, most, iterations, tolerance, score)
    finally:
        df.unpersist()


def _grow(df: DataFrame, key: str, vector: str, most: int, iterations: int, tolerance: float, score: str) -> Growth:
    n, mean, total = scatter(df, vector)
    values, axes = np.linalg.eigh(total / max(n, 1))
    step = np.sqrt(max(values[-1], 0.0)) * axes[:, -1]
    centres, out = np.array([mean - step, mean + step]), Growth()
    while True:
        for _ in range(iterations):
            size, sums, error = _assign_sums(df, vector, centres)
            new = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
            moved = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
            centres = new
            if moved <= tolerance * np.sqrt(max(values[-1], 1e-30)):
                break
        k = len(centres)
        out.centres[k] = centres.copy()
        labelled = nearest(df.select(key, vector), vector, list(enumerate(centres.tolist())))
        if score == "pairs":
            out.silhouettes[k] = silhouette_score(labelled, key, vector, "nearest").first()[0]
        elif score == "error":
            out.silhouettes[k] = -float(error.sum())
        else:
            out.silhouettes[k] = silhouette_by_centres(labelled, key, vector, "nearest", score == "squared").agg(F.avg("silhouette")).first()[0]
        if k >= most:
            return out
        worst = int(error.argmax())
        m, inside, spread = scatter(labelled.filter(F.col("nearest") == worst), vector)
        if m < 2:
            return out
        v, a = np.linalg.eigh(spread / m)
        offset = np.sqrt(max(v[-1], 0.0)) * a[:, -1]
        centres = np.vstack([np.delete(centres, worst, axis=0), inside - offset, inside + offset])


@dataclass
class LatentMap:
    """Lattice places (k, 2) and their weights (k, d)."""

    lattice: np.ndarray
    weights: np.ndarray
    temperature: float

    def transform(self, df: DataFrame, vector: str) -> DataFrame:
        """Add `latent`: the mean lattice place under the soft assignment, and `unit`, the nearest weight."""
        lattice, weights, t = self.lattice, self.weights, self.temperature

        def place(batches):
            for pdf in batches:
                x = np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else np.zeros((0, weights.shape[1]))
                d = distances(x, weights) ** 2 if len(x) else np.zeros((0, len(weights)))
                p = np.exp(-(d - d.min(axis=1, keepdims=True)) / t) if len(x) else d
                p = p / p.sum(axis=1, keepdims=True) if len(x) else p
                yield pdf.assign(latent=list(p @ lattice), unit=d.argmin(axis=1) if len(x) else [])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(place, f"{fields}, latent array<double>, unit bigint")


def fit_latent_map(df: DataFrame, vector: str, rows: int = 6, cols: int = 6, iterations: int = 15, gamma: float = 1.0, tolerance: float = 1e-4) -> LatentMap:
    """Batch map: soft assignment of each row to lattice units by its distance to the weights and of its latent place to the unit.

    The start is the plane of the first two principal axes, signs fixed by the largest entry, so the fit is deterministic. The
    latent place of a row is found inside the scan from the same weights, so nothing about rows is kept between iterations but
    the vectors, which are stored once.
    """
    df = df.select(F.col(vector).cast("array<double>").alias(vector)).filter(F.col(vector).isNotNull()).persist()
    try:
        return _fit_map(df, vector, rows, cols, iterations, gamma, tolerance)
    finally:
        df.unpersist()


def _fit_map(df: DataFrame, vector: str, rows: int, cols: int, iterations: int, gamma: float, tolerance: float) -> LatentMap:
    n, mean, total = scatter(df, vector)
    values, axes = np.linalg.eigh(total / max(n, 1))
    two = axes[:, [-1, -2]] * np.sign(axes[np.abs(axes[:, [-1, -2]]).argmax(axis=0), [-1, -2]])
    grid = np.array([(i, j) for i in np.linspace(-1, 1, rows) for j in np.linspace(-1, 1, cols)])
    weights = mean + grid @ (two * np.sqrt(np.maximum(values[[-1, -2]], 0))).T
    temperature, before = float(values.sum()) / len(mean) + 1e-12, None
    for _ in range(iterations):

        def partial(batches, weights=weights, t=temperature):
            s, q, f = np.zeros((len(grid), len(mean))), np.zeros(len(grid)), 0.0
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["v"].to_numpy()).astype(float)
                    d = distances(x, weights) ** 2
                    p = np.exp(-(d - d.min(axis=1, keepdims=True)) / t)
                    latent = (p / p.sum(axis=1, keepdims=True)) @ grid
                    d = d + gamma * t * distances(latent, grid) ** 2
                    low = d.min(axis=1, keepdims=True)
                    p = np.exp(-(d - low) / t)
                    z = p.sum(axis=1, keepdims=True)
                    f += float((low[:, 0] - t * np.log(z[:, 0])).sum())
                    p /= z
                    s += p.T @ x
                    q += p.sum(axis=0)
            yield pd.DataFrame({"k": np.arange(len(grid)), "q": q, "f": np.r_[f, np.zeros(len(grid) - 1)], "s": list(s)})

        parts = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null").mapInPandas(partial, "k int, q double, f double, s array<double>")
        agg = parts.groupBy("k").agg(F.sum("q").alias("q"), F.sum("f").alias("f"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(len(mean))]).orderBy("k").collect()
        q = np.array([r["q"] for r in agg])
        s = np.array([[r[f"s{i}"] for i in range(len(mean))] for r in agg])
        weights = np.where(q[:, None] > 1e-12, s / np.maximum(q, 1e-12)[:, None], weights)
        energy = sum(r["f"] for r in agg)
        if before is not None and abs(before - energy) <= tolerance * abs(before):
            break
        before = energy
        temperature *= 0.9
    return LatentMap(grid, weights, temperature)
