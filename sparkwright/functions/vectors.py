"""Vector expressions over array<double> columns: distances, activations, distributions, uncertainty."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-15


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once for a row, also where use() reads it inside a lambda for every item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def variance(v: Column) -> Column:
    return bound(mean(v), lambda m: total(F.transform(v, lambda x: (x - m) * (x - m)))) / F.size(v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def manhattan(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def squared_euclid(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def euclid(x: Column, y: Column) -> Column:
    return F.sqrt(squared_euclid(x, y))


def cosine_similarity(x: Column, y: Column) -> Column:
    return dot(x, y) / F.greatest(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(TINY))


def cosine_distance(x: Column, y: Column) -> Column:
    return 1 - cosine_similarity(x, y)


def hamming(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a != b), lambda z: z))


def variance_distance(x: Column, y: Column) -> Column:
    """Half the share of x in the sum of both variances."""
    return 0.5 * variance(x) / (variance(x) + variance(y))


def mahalanobis(x: Column, y: Column, inverse: list[list[float]]) -> Column:
    """Square root of d' S^-1 d for a fitted inverse covariance."""
    d = F.zip_with(x, y, lambda a, b: a - b)
    n = len(inverse)
    terms = [F.get(d, F.lit(i)) * F.get(d, F.lit(j)) * inverse[i][j] for i in range(n) for j in range(n)]
    return F.sqrt(sum(terms[1:], terms[0]))


def jaccard(x: Column, y: Column) -> Column:
    """Of two sets, as arrays."""
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def binary_jaccard(x: Column, y: Column) -> Column:
    both, either = dot(x, y), total(F.zip_with(x, y, lambda a, b: F.greatest(a, b)))
    return both / either


def lattice_distance(row1: Column, col1: Column, row2: Column, col2: Column) -> Column:
    return F.abs(row1 - row2) + F.abs(col1 - col2)


# activations of a single value


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def swish(x: Column) -> Column:
    return x * sigmoid(x)


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * F.expm1(x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.1) -> Column:
    return F.when(x > 0, x).otherwise(slope * x)


def slope_of(name: str, x: Column, alpha: float = 1.0) -> Column:
    """Derivative of an activation at x."""
    s = sigmoid(x)
    return {
        "sigmoid": s * (1 - s),
        "tanh": 1 - F.tanh(x) * F.tanh(x),
        "swish": s + x * s * (1 - s),
        "elu": F.when(x > 0, 1.0).otherwise(alpha * F.exp(x)),
        "relu": F.when(x > 0, 1.0).otherwise(0.0),
        "leaky_relu": F.when(x > 0, 1.0).otherwise(0.1),
        "linear": F.lit(1.0),
    }[name]


# distributions


def softmax(v: Column) -> Column:
    e = bound(v, lambda a: bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))))
    return bound(e, lambda a: bound(total(a), lambda t: F.transform(a, lambda x: x / t)))


def masked_softmax(v: Column, valid: Column, temperature: Column | float = 1.0) -> Column:
    """Over the valid slots; the others get exactly 0, and so do all where none is valid."""
    seen = F.zip_with(v, valid, lambda x, m: F.when(m, x / temperature))
    e = bound(seen, lambda a: bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))))
    return bound(e, lambda a: bound(F.nullif(total(a), F.lit(0.0)), lambda t: F.transform(a, lambda x: F.coalesce(x / t, F.lit(0.0)))))


def free_energy(scores: Column, temperature: float) -> Column:
    """-T log sum exp(-s / T)."""
    return bound(F.array_min(scores), lambda low: low - temperature * F.log(total(F.transform(scores, lambda s: F.exp((low - s) / temperature)))))


def soft_assign(scores: Column, temperature: float) -> Column:
    """Softmax of -score / T; at T = 0 all weight on the first smallest score."""
    if temperature <= 0:
        return F.transform(scores, lambda s, i: F.when(i + 1 == F.array_position(scores, F.array_min(scores)), 1.0).otherwise(0.0))
    return softmax(F.transform(scores, lambda s: -s / temperature))


def as_probabilities(v: Column) -> Column:
    """The array itself if it is a distribution (within 0.001), else its softmax."""
    is_one = F.forall(v, lambda x: x.between(0, 1)) & (F.abs(total(v) - 1) <= 1e-3)
    return F.when(is_one, v).otherwise(softmax(v))


def uniform(k: Column) -> Column:
    return F.array_repeat(1.0 / k, k.cast("int"))


# how uncertain a distribution is, from 0 to 1


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def normal_entropy(p: Column) -> Column:
    h = -total(F.transform(p, lambda x: F.greatest(x, F.lit(1e-12)) * F.log(F.greatest(x, F.lit(1e-12)))))
    return F.when(F.size(p) < 2, 0.0).otherwise(_clip(h / F.log(F.size(p).cast("double"))))


def least_confidence(p: Column) -> Column:
    k = F.size(p).cast("double")
    return F.when(k < 2, 0.0).otherwise(_clip((1 - F.array_max(p)) / (1 - 1 / k)))


def margin(p: Column) -> Column:
    best = F.sort_array(p, asc=False)
    return F.when(F.size(p) < 2, 0.0).otherwise(_clip(1 - (F.get(best, F.lit(0)) - F.get(best, F.lit(1)))))


STRATEGIES = {"entropy": normal_entropy, "least_confidence": least_confidence, "margin": margin}


def uncertainty(rows: Column, strategy: str = "entropy", reduce: str = "mean") -> Column:
    """Of several distributions (array of arrays): the mean or the maximum."""
    scores = F.transform(rows, STRATEGIES[strategy])
    return mean(scores) if reduce == "mean" else F.array_max(scores)


def decision_confidence(p: Column) -> Column:
    """One less the entropy relative to that of as many equal options."""
    return 1 - normal_entropy(p)


def option_bucket(kind: Column, options: Column) -> Column:
    size = F.when(options <= 2, "2").when(options <= 5, "3-5").when(options <= 10, "6-10").otherwise("11+")
    return F.concat_ws(":", kind, size)


def decode_decision(kind: Column, p: Column) -> Column:
    """BINARY: p(true), the second option. CHOICE: the likeliest option. SCORE: the expected level."""
    expected = total(F.transform(p, lambda x, i: x * i))
    best = (F.array_position(p, F.array_max(p)) - 1).cast("double")
    return F.when(kind == "BINARY", F.get(p, F.lit(1))).when(kind == "CHOICE", best).otherwise(expected)


def decision_correct(kind: Column, p: Column, answer: Column) -> Column:
    return F.rint(decode_decision(kind, p)) == answer


# spectra and levels


def decibels(power: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(power + floor)


def from_decibels(level: Column, floor: float = 1e-12) -> Column:
    return F.greatest(F.pow(F.lit(10.0), level / 10) - floor, F.lit(0.0))


def bin_frequencies(size: int, rate: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size // 2)), lambda k: k * F.lit(rate / size))


def ball_log_volume(dimensions: int, log_radius: Column) -> Column:
    """Logarithm of the volume of a ball."""
    return dimensions * log_radius + F.lit(dimensions / 2 * math.log(math.pi) - math.lgamma(dimensions / 2 + 1))


def log_sum_exp(v: Column) -> Column:
    return bound(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top)))))


def attention_softmax(v: Column, allowed: Column) -> Column:
    """Masked softmax whose rows without an allowed place are all zero."""
    return F.when(F.exists(allowed, lambda m: m), masked_softmax(v, allowed)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def softmax_slope(p: Column, upstream: Column) -> Column:
    """Gradient through a softmax with output p: p (u - sum p u)."""
    return bound(dot(p, upstream), lambda inner: F.zip_with(p, upstream, lambda a, u: a * (u - inner)))


def soft_bound(x: Column, bound: float) -> Column:
    return bound * F.tanh(x / bound)


def position_angles(position: Column, width: int, base: float = 10_000.0) -> Column:
    """position times each frequency of a rotary or sinusoidal code of the given width."""
    return F.transform(F.sequence(F.lit(0), F.lit(width // 2 - 1)), lambda k: position * F.pow(F.lit(base), -2.0 * k / width))


def gather(values: Column, mask: Column) -> Column:
    """The items where the mask holds, in order."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])
