"""Interval statistics on aggregated counts (one row per rule, never per product)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.96  # fixed value


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def wilson_bounds(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson score bounds; (0, 1) without trials."""
    n = F.nullif(trials, F.lit(0)).cast("double")
    p = successes.cast("double") / n
    zz = F.lit(z * z)
    middle = (p + zz / (n * 2.0)) / (zz / n + 1.0)
    spread = F.sqrt((p * (F.lit(1.0) - p) + zz / (n * 4.0)) / n) * z / (zz / n + 1.0)
    lower = F.coalesce(F.greatest(F.lit(0.0), middle - spread), F.lit(0.0))
    upper = F.coalesce(F.least(F.lit(1.0), middle + spread), F.lit(1.0))
    return lower, upper


_BOUNDS = T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(256)


def beta_quantile(prob: float, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Quantiles of Beta(alpha, beta) for alpha, beta >= 1.

    The density is integrated with Gauss-Legendre nodes over the part of [0, 1] that holds
    all of its mass, so the cost does not depend on how large the counts are.
    """
    a = np.asarray(alpha, dtype=float)
    b = np.asarray(beta, dtype=float)
    mean = a / (a + b)
    sd = np.sqrt(mean * (1.0 - mean) / (a + b + 1.0))
    left = np.maximum(0.0, mean - 40.0 * sd)
    right = np.minimum(1.0, mean + 40.0 * sd)
    mode = np.where(a + b > 2.0, (a - 1.0) / np.maximum(a + b - 2.0, 1e-300), 0.5)

    def log_shape(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(a[:, None] > 1.0, (a[:, None] - 1.0) * np.log(x), 0.0)
            down = np.where(b[:, None] > 1.0, (b[:, None] - 1.0) * np.log1p(-x), 0.0)
        return up + down

    peak = log_shape(np.clip(mode, left, right)[:, None])

    def mass(lo, hi):
        half = (hi - lo)[:, None] / 2.0
        x = lo[:, None] + half * (_NODES[None, :] + 1.0)
        return (np.exp(log_shape(x) - peak) * _WEIGHTS[None, :] * half).sum(axis=1)

    total = mass(left, right)
    lo, hi = left.copy(), right.copy()
    for _ in range(80):
        mid = (lo + hi) / 2.0
        below = mass(left, mid) < prob * total
        lo = np.where(below, mid, lo)
        hi = np.where(below, hi, mid)
    return (lo + hi) / 2.0


@F.pandas_udf(_BOUNDS)
def _beta_bounds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for alpha, beta in batches:
        yield pd.DataFrame({
            "lower": beta_quantile(0.05, alpha.to_numpy(), beta.to_numpy()),
            "upper": beta_quantile(0.95, alpha.to_numpy(), beta.to_numpy()),
        })


def beta_bounds(alpha: Column, beta: Column) -> Column:
    """5% and 95% quantiles of Beta(alpha, beta) as struct(lower, upper)."""
    return _beta_bounds(alpha.cast("double"), beta.cast("double"))
