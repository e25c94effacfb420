"""Linear and logistic models by conjugate gradients over distributed sums, and relative weights of predictors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster_metrics import scatter


@dataclass
class LinearModel:
    task: str
    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    target: tuple[float, float] = (0.0, 1.0)

    def linear(self, vector: Column) -> Column:
        x = F.zip_with(vector, F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s"), F.lit(float(w)).alias("w")) for m, s, w in zip(self.mean, self.std, self.weights[1:], strict=True)]), lambda v, p: (v - p["m"]) / p["s"] * p["w"])
        return F.aggregate(x, F.lit(float(self.weights[0])), lambda a, v: a + v)

    def predict(self, vector: Column) -> Column:
        z = self.linear(vector)
        return z * self.target[1] + self.target[0] if self.task == "regression" else 1 / (1 + F.exp(-z))


def _logistic_cost(df: DataFrame, weights: np.ndarray, mean: np.ndarray, std: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss and gradient: each task adds up its rows."""

    def partial(batches):
        g, loss, n = np.zeros(len(weights)), 0.0, 0
        for pdf in batches:
            if len(pdf):
                x = np.c_[np.ones(len(pdf)), (np.stack(pdf["v"].to_numpy()) - mean) / std]
                y, z = pdf["y"].to_numpy(), x @ weights
                g += x.T @ (1 / (1 + np.exp(-z)) - y)
                loss += float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum())
                n += len(pdf)
        yield pd.DataFrame({"i": np.arange(len(weights) + 2), "x": np.r_[g, loss, n]})

    parts = df.mapInPandas(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    flat = np.array([r["x"] for r in parts])
    n = max(flat[-1], 1)
    return flat[-2] / n, flat[:-2] / n


def fit_linear(df: DataFrame, vector: str, target: str, task: str = "regression", penalty: float = 0.0, alpha: float = 0.0, steps: int = 100, tolerance: float = 1e-9) -> LinearModel:
    """Scaled conjugate gradients (Moller): the step length from a finite difference of gradients, adapted by how well it foretold the loss.

    Elastic net: penalty (alpha |w| + (1 - alpha) w^2), the intercept included. Features (and a regression's target) are standardised.
    A regression reads its rows once: loss and gradient at any weights follow from the sums of products of features and target. A
    logistic fit stores its rows once and reads the stored ones in each step.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y")).filter("v is not null and y is not null")
    if task == "regression":
        n, centre, s = scatter(rows.select(F.concat("v", F.array("y")).alias("v")), "v")
        mean, std = centre[:-1], np.sqrt(np.diag(s)[:-1] / max(n, 1)) + 1e-15
        scale = (float(centre[-1]), float(np.sqrt(s[-1, -1] / max(n, 1))) or 1.0)
        inner = s[:-1, :-1] / max(n, 1) / np.outer(std, std)
        cross, own = s[:-1, -1] / max(n, 1) / std / scale[1], s[-1, -1] / max(n, 1) / scale[1] ** 2

        def loss_at(w: np.ndarray) -> tuple[float, np.ndarray]:
            g = inner @ w[1:] - cross
            return (w[0] ** 2 + w[1:] @ (g - cross) + own) / 2, np.r_[w[0], g]

        return LinearModel(task, _descend(loss_at, len(mean) + 1, penalty, alpha, steps, tolerance), mean, std, scale)
    rows = rows.persist()
    try:
        n, mean, s = scatter(rows, "v")
        std = np.sqrt(np.diag(s) / max(n, 1)) + 1e-15
        return LinearModel(task, _descend(lambda w: _logistic_cost(rows, w, mean, std), len(mean) + 1, penalty, alpha, steps, tolerance), mean, std)
    finally:
        rows.unpersist()


def _descend(loss_at: Callable[[np.ndarray], tuple[float, np.ndarray]], width: int, penalty: float, alpha: float, steps: int, tolerance: float) -> np.ndarray:
    def cost(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = loss_at(w)
        return loss + penalty * (alpha * np.abs(w).sum() + (1 - alpha) * (w * w).sum()), g + penalty * (alpha * np.sign(w) + 2 * (1 - alpha) * w)

    w = np.zeros(width)
    loss, g = cost(w)
    r = -g
    p, lam, extra, success, delta = r.copy(), 1e-6, 0.0, True, 0.0
    for k in range(1, steps + 1):
        size = p @ p
        if size < tolerance**2:
            break
        if success:
            sigma = 1e-4 / np.sqrt(size)
            delta = p @ (cost(w + sigma * p)[1] - g) / sigma
        delta += (lam - extra) * size
        if delta <= 0:
            extra = 2 * (lam - delta / size)
            delta = -delta + lam * size
            lam = extra
        mu = p @ r
        step = mu / delta
        new_loss, new_g = cost(w + step * p)
        gain = 2 * delta * (loss - new_loss) / mu**2
        if gain >= 0:
            w, old = w + step * p, r
            done = abs(loss - new_loss) < tolerance * (1 + abs(loss))
            loss, g, r = new_loss, new_g, -new_g
            extra, success = 0.0, True
            p = r.copy() if k % len(w) == 0 else r + (r @ r - r @ old) / mu * p
            if gain >= 0.75:
                lam /= 4
            if done:
                break
        else:
            extra, success = lam, False
        if gain < 0.25:
            lam += delta * (1 - gain) / size
        if r @ r < tolerance**2:
            break
    return w


def elasticnet_loss(df: DataFrame, vector: str, target: str, weights: list[float], penalty: float, alpha: float) -> DataFrame:
    """One row, loss: half the mean squared error of standardised features and target at the weights (the intercept's first), and the
    penalty on all of them, alpha of it by magnitude and the rest by square. What fit_linear() descends; rows with a null don't count."""
    rows = df.select(F.concat(F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("v")).filter(F.forall("v", lambda x: x.isNotNull()))
    n, mean, s = scatter(rows, "v")
    std = np.sqrt(np.diag(s) / max(n, 1)) + 1e-15
    model = LinearModel("binary", np.array(weights, float), mean[:-1], std[:-1])
    e = model.linear(F.slice("v", 1, len(weights) - 1)) - (F.element_at("v", -1) - F.lit(float(mean[-1]))) / F.lit(float(std[-1]))
    held = penalty * sum(alpha * abs(w) + (1 - alpha) * w * w for w in weights)
    return rows.agg((F.avg(e * e) / 2 + F.lit(held)).alias("loss"))


def relative_weights(df: DataFrame, features: list[str], target: str) -> dict[str, float]:
    """Johnson's weights: each predictor's share of R^2, from the correlation matrix alone, which one scan gives."""
    rows = df.select(F.array(*[F.col(c).cast("double") for c in (*features, target)]).alias("v")).filter(F.forall("v", lambda x: x.isNotNull()))
    _, _, s = scatter(rows, "v")
    d = np.sqrt(np.diag(s))
    c = s / np.outer(d, d)
    values, vectors = np.linalg.eigh(c[:-1, :-1])
    half = vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T  # correlations of predictors with their orthogonal twins
    beta = np.linalg.solve(half, c[:-1, -1])
    raw = (half**2) @ (beta**2)
    return dict(zip(features, raw.tolist(), strict=True))
