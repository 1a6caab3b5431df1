"""Functional forms, distances between distributions, and grades, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian(x: Column, height: Column | float, mean: Column | float, variance: Column | float) -> Column:
    height, mean, variance = (F.lit(v) if isinstance(v, int | float) else v for v in (height, mean, variance))
    return height * F.exp(-F.pow(x - mean, 2) / (2 * variance))


def uniform(x: Column, height: float, start: float, end: float) -> Column:
    """height on [start, end), else 0."""
    return F.when((x >= start) & (x < end), F.lit(float(height))).otherwise(0.0)


def triangle(x: Column, height: float, start: float, top: float, end: float) -> Column:
    """Linear from start up to height at top and down to end."""
    up, down = height * (x - start) / (top - start), height * (end - x) / (end - top)
    return F.when((x >= start) & (x <= top), up).when((x > top) & (x <= end), down).otherwise(0.0)


def isosceles(x: Column, height: float, mean: float, half_width: float) -> Column:
    return triangle(x, height, mean - half_width, mean, mean + half_width)


def residual(observed: Column, modelled: Column) -> Column:
    return observed - modelled


def kl_gaussian(mean1: Column, var1: Column, mean2: Column, var2: Column) -> Column:
    """Kullback-Leibler divergence of the second gaussian from the first: D(1 || 2)."""
    return 0.5 * (F.log(var2 / var1) + (var1 + F.pow(mean1 - mean2, 2)) / var2 - 1)


def kl_uniform(width1: Column, width2: Column) -> Column:
    """D(1 || 2) where the first lies within the second."""
    return F.log(width2 / width1)


def kl_triangle(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column], steps: int = 400) -> Column:
    """D(1 || 2) of two triangular densities (start, top, end), the first within the second, by the midpoint rule over the first."""
    (a, b, c), (d, e, f) = first, second
    density = lambda x, low, top, high: F.when(x <= top, 2 * (x - low) / ((high - low) * (top - low))).otherwise(2 * (high - x) / ((high - low) * (high - top)))

    def part(total: Column, k: Column) -> Column:
        x = a + (k - 0.5) * (c - a) / steps
        p, q = density(x, a, b, c), density(x, d, e, f)
        return total + F.when((p > 0) & (q > 0), p * F.log(p / q)).otherwise(0.0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), part) * (c - a) / steps


def variation_bound(divergence: Column) -> Column:
    """Upper bound of the total variation distance: sqrt(1 - exp(-D)) (Bretagnolle and Huber)."""
    return F.sqrt(1 - F.exp(-divergence))


def reciprocal_score(divergence: Column) -> Column:
    return 1 / (divergence + 1)


def ssmd(mean1: Column, var1: Column, mean2: Column, var2: Column) -> Column:
    """Strictly standardised mean difference, as a magnitude."""
    return F.abs(mean1 - mean2) / F.sqrt(var1 + var2)


#: fixed values: probabilities above which the quality is 0, 1, ...; uncertainties (s) up to which the grade is 0, 1, ...
QUALITY_STEPS = (0.9, 0.7, 0.5, 0.3, 0.2)
GRADE_STEPS = (0.02, 0.03, 0.04, 0.05)


def quality(probability: Column) -> Column:
    """The first step that the probability exceeds, 4 if none."""
    out = F.lit(4)
    for k, step in reversed(list(enumerate(QUALITY_STEPS))):
        out = F.when(probability > step, min(k, 4)).otherwise(out)
    return out


def grade(uncertainty: Column) -> Column:
    """The first step that bounds the uncertainty in seconds, 4 if none."""
    out = F.lit(4)
    for k, step in reversed(list(enumerate(GRADE_STEPS))):
        out = F.when(uncertainty <= step, k).otherwise(out)
    return out
