"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy_term(p: Column, delta: float = 1e-8) -> Column:
    """-p ln p where p is over ``delta``; null values add nothing."""
    return F.when(p > delta, -p * F.ln(p)).otherwise(F.lit(0.0))


def entropy(p: Column, delta: float = 1e-8, empty: str = "all_null") -> Column:
    """Shannon entropy in nats of a group's values.

    ``empty`` says when there is none: ``all_null`` (no value at all),
    ``zero_sum`` (values add up to 0) or ``no_positive``.
    """
    h = F.sum(entropy_term(p, delta))
    if empty == "all_null":
        return F.when(F.count(p) > 0, h)
    return F.when(F.sum(p) != 0, h) if empty == "zero_sum" else F.when(F.max(p) > 0, h)


def unguarded_entropy(p: Column) -> Column:
    """Shannon entropy without a guard: not a number where a value is 0 or there is none."""
    h = F.sum(-p * F.ln(p))
    return F.when((F.count(p) == 0) | (F.min(p) <= 0), F.lit(float("nan"))).otherwise(h)


def length_similarity(a: Column, b: Column, alpha: float, gamma: float) -> Column:
    """alpha * (1 - logistic(gamma * (|a - b| - 7.5)))"""
    return alpha * (1 - 1 / (1 + F.exp(-gamma * (F.abs(a - b) - 7.5))))


def inverse_similarity(d: Column) -> Column:
    return F.abs(1 / (1 + d))


def strip_side(x: Column) -> Column:
    """A name without a trailing ``_`` and one character."""
    return F.when(F.substring(x, -2, 1) == "_", F.substring(x, F.lit(1), F.length(x) - 2)).otherwise(x)


def edge_type(a: Column, b: Column, directed: bool = True) -> Column:
    return F.concat_ws("_", a, b) if directed else F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number: listed below 16, from there by four terms of Stirling's series (error below 1e-13)."""
    x, small = n.cast("double"), F.array(*(F.lit(math.lgamma(k + 1)) for k in range(16)))
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)
