"""Agreement of two labelings, entropies and losses as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def contingency(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """truth, cluster, n for each pair that occurs."""
    return df.filter(F.col(truth).isNotNull() & F.col(cluster).isNotNull()).groupBy(truth, cluster).agg(F.count("*").alias("n"))


def _shares(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """The contingency table with margins: as many rows as pairs of labels, whatever the size of the input."""
    every = Window.partitionBy()
    c = contingency(df, truth, cluster)
    return c.withColumn("all", F.sum("n").over(every)).withColumn("a", F.sum("n").over(Window.partitionBy(truth))).withColumn("b", F.sum("n").over(Window.partitionBy(cluster)))


def mutual_information(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """In nats."""
    p = F.col("n") / F.col("all")
    return _shares(df, truth, cluster).agg(F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mutual_information"))


def label_entropy(df: DataFrame, label: str) -> DataFrame:
    """In nats."""
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    p = F.col("n") / F.col("all")
    return n.agg((-F.sum(p * F.log(p))).alias("entropy"))


def homogeneity(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """One less the share of the truth's entropy that is left within clusters; 1 where the truth has none."""
    shares = _shares(df, truth, cluster)
    p = F.col("n") / F.col("all")
    within = shares.agg((-F.sum(p * F.log(F.col("n") / F.col("b")))).alias("left"))
    both = within.crossJoin(label_entropy(df.filter(F.col(cluster).isNotNull()), truth))  # one row with one row
    return both.select(F.when(F.col("entropy") == 0, 1.0).otherwise(1 - F.col("left") / F.col("entropy")).alias("homogeneity"))


def distribution(df: DataFrame, label: str, declared: list[str]) -> DataFrame:
    """label, n: declared labels first, in their order and with 0 where unused, then others by name. `pos` gives the order."""
    names = df.sparkSession.createDataFrame(list(enumerate(declared)), "pos int, label string")
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    both = names.join(counts, "label", "full").select("label", F.coalesce("n", F.lit(0)).alias("n"), "pos")
    order = F.row_number().over(Window.orderBy(F.col("pos").isNull(), "pos", "label"))  # one row for a label
    return both.select("label", F.col("n").cast("long").alias("n"), order.alias("pos"))


# losses; each is a column to average, sum or take as it is


def squared_error(p: Column, t: Column) -> Column:
    return (p - t) * (p - t)


def huber(p: Column, t: Column, delta: float = 1.0) -> Column:
    """The smooth form: delta^2 (sqrt(1 + (d / delta)^2) - 1)."""
    d = (p - t) / delta
    return delta * delta * (F.sqrt(1 + d * d) - 1)


def binary_cross_entropy(logit: Column, t: Column) -> Column:
    """Of a logit against 0 or 1, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * t + F.log1p(F.exp(-F.abs(logit)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Of an array of logits against a class number."""
    top = F.array_max(logits)
    return top + F.log(V.total(F.transform(logits, lambda x: F.exp(x - top)))) - F.get(logits, target)


def multilabel_cross_entropy(logits: Column, targets: Column) -> Column:
    return V.mean(F.zip_with(logits, targets, binary_cross_entropy))


def decision_loss(logits: Column, valid: Column, target: Column, ordinal: Column, weight: float = 0.5) -> Column:
    """Masked cross entropy, and for ordered levels the squared distance of the expected level from the target."""
    p = V.masked_softmax(logits, valid)
    nll = -F.log(F.greatest(F.get(p, target), F.lit(1e-12)))
    expected = V.total(F.transform(p, lambda x, i: x * i))
    return nll + F.when(ordinal, weight * (expected - target) * (expected - target)).otherwise(0.0)


def absolute_error(p: Column, t: Column) -> Column:
    return F.abs(t - p)


def cosine_loss(p: Column, t: Column) -> Column:
    """1 less the cosine of two vectors; a tiny constant keeps zero vectors at 1."""
    dot = lambda a, b: V.total(F.zip_with(a, b, lambda x, y: x * y))
    return 1 - dot(p, t) / (F.sqrt(dot(p, p)) * F.sqrt(dot(t, t)) + 1e-8)


def matryoshka(p: Column, t: Column, sizes: list[int], weights: list[float]) -> Column:
    """Weighted mean squared errors of nested prefixes of two vectors."""
    parts = [w * V.squared_euclid(F.slice(p, 1, n), F.slice(t, 1, n)) / n for n, w in zip(sizes, weights, strict=True)]
    return sum(parts[1:], parts[0]) / sum(weights)


def mixture_nll(weights: Column, means: Column, deviations: Column, t: Column) -> Column:
    """Negative log likelihood of a mixture of normals."""
    logs = F.zip_with(F.arrays_zip(weights.alias("w"), means.alias("m")), deviations, lambda a, s: F.log(a["w"]) - F.log(s) - 0.9189385332046727 - F.pow((t - a["m"]) / s, 2) / 2)
    top = F.array_max(logs)
    return -(top + F.log(V.total(F.transform(logs, lambda x: F.exp(x - top)))))


def errors(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """mse, rmse, sse, mae, huber and r2 in one pass. Rows with a null are left out."""
    p, t = F.col(predicted).cast("double"), F.col(target).cast("double")
    rows = df.filter(p.isNotNull() & t.isNotNull())
    e = squared_error(p, t)
    mse = F.avg(e)
    return rows.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.sum(e).alias("sse"), F.avg(F.abs(p - t)).alias("mae"), F.avg(huber(p, t)).alias("huber"), (1 - F.sum(e) / (F.var_pop(t) * F.count("*"))).alias("r2"))


def mcfadden(df: DataFrame, logit: str, target: str) -> DataFrame:
    """One less the log likelihood over that of the base rate."""
    x, t = F.col(logit), F.col(target).cast("double")
    base = F.avg(t)
    null = -(base * F.log(base) + (1 - base) * F.log(1 - base))
    return df.agg((1 - F.avg(binary_cross_entropy(x, t)) / null).alias("mcfadden_r2"))
