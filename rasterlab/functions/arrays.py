"""Columns over arrays of class scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def softmax(scores: Column | str) -> Column:
    """Stable softmax of an array of doubles."""
    x = F.col(scores) if isinstance(scores, str) else scores
    shifted = F.transform(F.array(x), lambda a: F.transform(a, lambda v: F.exp(v - F.array_max(a))))[0]
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w)))[0]


def argmax(scores: Column | str) -> Column:
    """The first index of the largest element: ties go to the lowest class."""
    x = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clip_all(xs: Column, low: float, high: float) -> Column:
    return F.transform(xs, lambda v: clip(v, low, high))


def one_hot(label: Column | str, n: int) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def smooth(y: Column, n: int, epsilon: float = 0.1) -> Column:
    """Label smoothing of an indicator array."""
    return F.transform(y, lambda v: v * (1.0 - epsilon) + epsilon / n)


def weight_of(label: Column | str, weights: list[float]) -> Column:
    """The weight of a pixel's true class."""
    label = F.col(label) if isinstance(label, str) else label
    return F.array(*(F.lit(float(w)) for w in weights))[label]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def r6(x: Column) -> Column:
    """Six decimals, half up: the same in any engine that computes in doubles."""
    return F.floor(x * 1e6 + 0.5) / 1e6 + 0.0
