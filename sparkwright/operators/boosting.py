"""Explainable boosting: additive shape functions on quantile bins, then the strongest pairs of features."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct linear-interpolated percentiles without the ends, of all features in one aggregate."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in at])).alias(c) for c in features]).first()
    return {c: sorted(set(row[c])) for c in features}


def digitise(value: Column, edges: list[float]) -> Column:
    """Number of edges that are not above the value."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value)) if edges else F.lit(0)


def _lookup(values: list[float], at: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), at)


@dataclass
class BoostedShapes:
    """A fitted model: intercept, one table of contributions for each feature, one for each pair."""

    task: str
    edges: dict[str, list[float]]
    intercept: float
    shapes: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for c, t in self.shapes.items():
            total = total + _lookup(t.tolist(), digitise(F.col(c), self.edges[c]))
        for (a, b), t in self.pairs.items():
            at = digitise(F.col(a), self.edges[a]) * t.shape[1] + digitise(F.col(b), self.edges[b])
            total = total + _lookup(t.ravel().tolist(), at)
        return total

    def predict(self) -> Column:
        s = self.score()
        return s if self.task == "regression" else (s >= 0).cast("int")

    def importance(self) -> dict[str, float]:
        return {c: float(np.abs(t).mean()) for c, t in self.shapes.items()}

    def shape(self, feature: str) -> list[tuple[float, float]]:
        """(bin centre, contribution); outer bins by their inner edge."""
        e = self.edges[feature]
        centres = [e[0], *[(a + b) / 2 for a, b in zip(e[:-1], e[1:], strict=True)], e[-1]] if e else [0.0]
        return list(zip(centres, self.shapes[feature].tolist(), strict=True))


def fit_shapes(df: DataFrame, features: list[str], target: str, task: str = "regression", bins: int = 16, rounds: int = 10, rate: float = 0.2, pairs: int = 0) -> BoostedShapes:
    """Cyclic boosting: for each feature in turn the mean residual of each bin times the rate.

    Rows are first counted by their combination of bins, with the sum of targets: what a round needs of the rows is in this
    table, whose size is bounded by bins to the number of features and by the rows. It stays in Spark; every step is one
    aggregate that gives a number for a bin. Interactions are ranked by the sum of n mean^2 over their cells with more than one row.
    """
    spark = df.sparkSession
    rows = df.select(*features, F.col(target).cast("double").alias("y")).na.drop()
    edges = bin_edges(rows, features, bins)
    cells = rows.select(*[digitise(F.col(c), edges[c]).alias(c) for c in features], "y").groupBy(*features).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:  # counted once, read in every step
        path = f"{folder.rstrip('/')}/cells-{uuid.uuid4().hex}"
        cells.write.parquet(path)
        cells = spark.read.parquet(path)
    n, total = cells.agg(F.sum("n"), F.sum("y")).first()
    mean = total / n
    intercept = mean if task == "regression" else float(np.log(mean / (1 - mean)))
    model = BoostedShapes(task, edges, intercept, {c: np.zeros(len(edges[c]) + 1) for c in features})

    def residual() -> Column:
        score = F.lit(model.intercept)
        for c, t in model.shapes.items():
            score = score + _lookup(t.tolist(), F.col(c))
        for (a, b), t in model.pairs.items():
            score = score + _lookup(t.ravel().tolist(), F.col(a) * t.shape[1] + F.col(b))
        return F.col("y") - F.col("n") * (score if task == "regression" else 1 / (1 + F.exp(-score)))

    for _ in range(rounds):
        for c in features:
            step = np.zeros(len(edges[c]) + 1)
            for r in cells.groupBy(c).agg((F.sum(residual()) / F.sum("n")).alias("m")).collect():  # a row for a bin
                step[r[c]] = r["m"]
            model.shapes[c] = model.shapes[c] + rate * step
    if pairs:
        ranked = []
        for a, b in combinations(features, 2):
            cell = cells.groupBy(a, b).agg(F.sum(residual()).alias("r"), F.sum("n").alias("k")).filter("k > 1")
            ranked.append((-(cell.agg(F.sum(F.col("r") * F.col("r") / F.col("k"))).first()[0] or 0.0), a, b))
        for _, a, b in sorted(ranked)[:pairs]:
            model.pairs[a, b] = np.zeros((len(edges[a]) + 1, len(edges[b]) + 1))
        for _ in range(max(1, rounds // 2)):
            for (a, b), t in list(model.pairs.items()):
                step = np.zeros_like(t)
                for r in cells.groupBy(a, b).agg((F.sum(residual()) / F.sum("n")).alias("m")).collect():
                    step[r[a], r[b]] = r["m"]
                model.pairs[a, b] = t + rate * step
    return model
