"""Statistical column expressions and small numeric helpers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortlens.functions.expr import as_col

__all__ = ["safe_corr", "norm_cdf", "rate", "uniform_from_hash", "poisson1_from_uniform",
           "pearson_p_value", "partial_corr"]

# Coefficients of the normal integral, Abramowitz & Stegun 26.2.17.
PHI_P = 0.2316419
PHI_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def rate(boolean: str | Column) -> Column:
    """Mean of a boolean as double (never DECIMAL)."""
    return F.avg(as_col(boolean).cast("int").cast("double"))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side.

    The built-in ``corr`` raises a division error on constant input in ANSI mode.
    """
    both = as_col(x).isNotNull() & as_col(y).isNotNull()
    xs = F.when(both, as_col(x).cast("double"))
    ys = F.when(both, as_col(y).cast("double"))
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def partial_corr(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """Correlation of x and y with z held fixed, from the three pairwise ones."""
    return F.try_divide(rxy - rxz * ryz, F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz)))


def norm_cdf(x: str | Column) -> Column:
    """Standard normal distribution function; absolute error below 7.5e-8."""
    x = as_col(x).cast("double")
    t = 1.0 / (1.0 + F.abs(x) * PHI_P)
    poly = F.lit(0.0)
    for b in reversed(PHI_B):
        poly = (poly + b) * t
    density = F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
    upper = density * poly
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


def uniform_from_hash(*keys: Column) -> Column:
    """Uniform number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * (2.0 ** -53)


def poisson1_from_uniform(u: Column) -> Column:
    """Inverse distribution function of Poisson(1) as a ladder (tail beyond 12 is < 1e-10)."""
    cdf, term, out = 0.0, math.exp(-1.0), None
    for k in range(13):
        cdf += term
        term /= k + 1
        out = F.when(u < cdf, k) if out is None else out.when(u < cdf, k)
    return out.otherwise(13)


def _beta_continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def two_sided_t(r: float, n: float) -> float:
    """Two-sided p-value of a Pearson correlation r over n pairs."""
    if r is None or n is None or math.isnan(r) or math.isnan(n) or n < 3:
        return float("nan")
    df, r2 = n - 2.0, min(r * r, 1.0)
    if r2 >= 1.0:
        return 0.0
    a, b, x = df / 2.0, 0.5, 1.0 - r2
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1.0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_continued_fraction(a, b, x) / a
    return 1.0 - front * _beta_continued_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def pearson_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """p-values for a result with one row per feature (never for fact rows)."""
    return pd.Series([two_sided_t(float(a) if a is not None else np.nan, float(b))
                      for a, b in zip(r, n)]).where(lambda s: s.notna(), None)
