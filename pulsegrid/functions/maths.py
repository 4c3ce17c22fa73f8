"""Scalar and array functions of scores, probabilities and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 0.5 * (1 + F.tanh(0.5 * x))


def softmax(xs: Column) -> Column:
    """Probabilities of an array of logits, shifted by its maximum."""
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(xs: Column) -> Column:
    """Place of the largest element, from 0; the lowest of equal ones."""
    return F.array_position(xs, F.array_max(xs)) - 1


def bce_with_logits(logit: Column, y: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def nll(p: Column) -> Column:
    """Negative log of a probability that is held above 1e-12."""
    return -F.ln(F.greatest(p, F.lit(1e-12)))


def div0(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't above 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def div_nan(a: Column, b: Column) -> Column:
    """a / b, NaN where b isn't above 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(float("nan")))


def half_even(x: Column, places: int = 4) -> Column:
    return F.bround(x, places)


def finite_or_null(x: Column) -> Column:
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def f1(p: Column, r: Column) -> Column:
    return div0(2 * p * r, p + r)


def standardise(x: Column, mean: Column, scale: Column, absent: Column) -> Column:
    return F.when(absent, 0.0).otherwise((x - mean) / scale)


def split_of(t: Column, first: int, second: int) -> Column:
    """Train before the first boundary, validation before the second, else test; a boundary belongs to the later part."""
    return F.when(t < first, "train").when(t < second, "validation").otherwise("test")
