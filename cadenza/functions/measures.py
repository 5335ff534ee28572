"""Measures on arrays of numbers: vector arithmetic, divergences, entropies, merge losses, frequency warps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cross(a: Column, b: Column) -> Column:
    """The outer product, as an array of rows."""
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def mean(a: Column) -> Column:
    """The mean of the components; null for an empty array."""
    return F.try_divide(_sum(a), F.size(a))


def largest(a: Column) -> Column:
    """Position (from 0) of the first greatest component; null for an empty array."""
    return F.nullif(F.array_position(a, F.array_max(a)), F.lit(0)) - 1


def smallest(a: Column) -> Column:
    return F.nullif(F.array_position(a, F.array_min(a)), F.lit(0)) - 1


def directed_divergence(p: Column, q: Column) -> Column:
    """Sum of p log2(p / q); terms with p of 0 add nothing."""
    return _sum(F.zip_with(p, q, lambda x, y: F.when(x == 0, 0.0).otherwise(x * F.log2(x / y))))


def divergence(p: Column, q: Column) -> Column:
    """Both directed divergences."""
    return directed_divergence(p, q) + directed_divergence(q, p)


def cross_entropy(p: Column, q: Column) -> Column:
    """Minus the sum of p ln q."""
    return -_sum(F.zip_with(p, q, lambda x, y: F.when(x == 0, 0.0).otherwise(x * F.log(y))))


def gaussian_entropy(var: Column) -> Column:
    """The negated entropy of a diagonal Gaussian, in bits: the larger the sharper."""
    each = _sum(F.transform(var, lambda v: F.log(v))) / 2 + F.size(var) * (0.5 * math.log(2 * math.pi) + 0.5)
    return -each / math.log(2)


def gaussian_merge_loss(n_a: Column, mean_a: Column, var_a: Column, n_b: Column, mean_b: Column, var_b: Column, floor: float = 1e-4) -> Column:
    """Likelihood lost by making two diagonal Gaussians one; the merged variance is floored."""
    n = n_a + n_b
    centre = F.zip_with(mean_a, mean_b, lambda x, y: (n_a * x + n_b * y) / n)
    power = F.zip_with(
        F.zip_with(var_a, mean_a, lambda v, m: n_a * (v + m * m)), F.zip_with(var_b, mean_b, lambda v, m: n_b * (v + m * m)), lambda x, y: (x + y) / n
    )
    merged = F.zip_with(power, centre, lambda s, m: F.greatest(s - m * m, F.lit(floor)))
    logs = lambda v: _sum(F.transform(v, lambda y: F.log(y)))
    return 0.5 * (n * logs(merged) - n_b * logs(var_b) - n_a * logs(var_a))


def count_merge_loss(a: Column, b: Column) -> Column:
    """Likelihood lost by pooling two arrays of counts."""
    xlogx = lambda x: F.when(x == 0, 0.0).otherwise(x * F.log(x))
    each = _sum(F.zip_with(a, b, lambda x, y: xlogx(x) + xlogx(y) - xlogx(x + y)))
    p, q = _sum(F.transform(a, lambda x: x.cast("double"))), _sum(F.transform(b, lambda x: x.cast("double")))
    return each - (xlogx(p) + xlogx(q) - xlogx(p + q))


def affine_warp(hertz: Column, slope: float, offset: float = 0.0) -> Column:
    return hertz * slope + offset


def inverse_affine_warp(warped: Column, slope: float, offset: float = 0.0) -> Column:
    return (warped - offset) / slope


def inverse_linear_warp(hertz: Column, slope: float) -> Column:
    return hertz / slope


def linear_warp(warped: Column, slope: float) -> Column:
    """The inverse of inverse_linear_warp."""
    return warped * slope


def piecewise_warp(hertz: Column, slope: float, turn: float, nyquist: float) -> Column:
    """slope times the frequency below turn, then a line that ends at nyquist."""
    rise = (nyquist - slope * turn) / (nyquist - turn)
    return F.when(hertz < turn, hertz * slope).otherwise(rise * hertz + nyquist * (1 - rise))


def inverse_piecewise_warp(warped: Column, slope: float, turn: float, nyquist: float) -> Column:
    rise = (nyquist - slope * turn) / (nyquist - turn)
    return F.when(warped < turn * slope, warped / slope).otherwise((warped - nyquist * (1 - rise)) / rise)
