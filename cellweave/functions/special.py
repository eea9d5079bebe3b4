"""Special functions. Column expressions where a short series suffices, Arrow functions
for tail probabilities (applied to per-gene results, never to cells)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 6
# Coefficients of x^-2, x^-4, ... in the asymptotic series of digamma.
DIGAMMA_SERIES = [-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760, -1 / 12]
# Coefficients of x^-1, x^-3, ... in the Stirling series of log gamma.
STIRLING_SERIES = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]


def _horner(x: Column, coefficients: list[float]) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def digamma(x: Column) -> Column:
    """Recurrence up to x + 6, then the asymptotic series."""
    z = x + F.lit(float(SHIFT))
    inv2 = F.lit(1.0) / (z * z)
    out = F.log(z) - F.lit(0.5) / z + inv2 * _horner(inv2, DIGAMMA_SERIES)
    for i in range(SHIFT):
        out = out - F.lit(1.0) / (x + F.lit(float(i)))
    return out


def log_gamma(x: Column) -> Column:
    z = x + F.lit(float(SHIFT))
    inv2 = F.lit(1.0) / (z * z)
    out = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + _horner(inv2, STIRLING_SERIES) / z
    for i in range(SHIFT):
        out = out - F.log(x + F.lit(float(i)))
    return out


def _erfc(v: np.ndarray) -> np.ndarray:
    return np.fromiter((math.erfc(a) for a in v), dtype=float, count=len(v))


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    """P(|Z| >= |z|)."""
    return _erfc(np.abs(z) / math.sqrt(2))


def wald_p_values(z: np.ndarray) -> np.ndarray:
    """2 (1 - cdf(|z|)), which is 0 once the cdf rounds to 1."""
    return 2 * (1 - 0.5 * _erfc(-np.abs(z) / math.sqrt(2)))


# Gauss-Legendre nodes on PANELS equal pieces integrate a smooth decaying function to rounding.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(32)
PANELS, DECAY = 8, 45.0


def t_two_sided_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for any degrees of freedom of at least 1, by one integral over the tail.

    With s = sqrt(v) tan(angle) the density becomes cos(angle)**(v - 1). It is integrated from the
    angle of t as far as it has not fallen by exp(-DECAY), relative to its value there, so that
    far tails keep their relative precision.
    """
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = (df >= 1) & np.isfinite(t)
    out[(df >= 1) & np.isinf(t)] = 0.0
    v, slope = df[ok], t[ok] / np.sqrt(df[ok])
    end = np.arctan2(1.0, slope)  # the angle left up to a right one
    m = np.maximum(v - 1, 1e-300)
    width = np.minimum(end, 2 * DECAY / m / (slope + np.sqrt(slope * slope + 2 * DECAY / m)))
    total = np.zeros_like(v)
    for panel in range(PANELS):
        u = width[:, None] * ((NODES + 1) / 2 + panel) / PANELS
        fall = np.log1p(np.maximum(-2 * np.sin(u / 2) ** 2 - slope[:, None] * np.sin(u), -1.0))
        total += np.exp((v - 1)[:, None] * fall) @ WEIGHTS * width / PANELS / 2
    out[ok] = np.minimum(1.0, 2 * np.exp(_log_t_constant(v) - (v - 1) / 2 * np.log1p(slope * slope)) * total)
    return out


def _log_t_constant(v: np.ndarray) -> np.ndarray:
    """log of gamma((v + 1) / 2) / (gamma(v / 2) sqrt(pi)), without cancellation for large v.

    The asymptotic series of the ratio at v / 2 + 10 is led down by its recurrence.
    """
    x = v / 2 + 10
    i = 1 / x
    # Log of gamma(x + 1/2) / gamma(x) less log(x) / 2, in odd powers of 1 / x.
    series = i * (-1 / 8 + i * i * (1 / 192 + i * i * (-1 / 640 + i * i * (17 / 14336 + i * i * (-31 / 18432)))))
    out = 0.5 * np.log(x) + series
    for k in range(10):
        out += np.log1p(-0.5 / (v / 2 + k + 0.5))
    return out - 0.5 * math.log(math.pi)


def _with_nulls(values: np.ndarray, known: pd.Series) -> pd.Series:
    return pd.Series(values).where(known.to_numpy(), None)


def _two_sided_normal(z: pd.Series) -> pd.Series:
    return _with_nulls(normal_two_sided(z.fillna(0).to_numpy(float)), z.notna())


def _two_sided_t(t: pd.Series, df: pd.Series) -> pd.Series:
    known = t.notna() & df.notna()
    return _with_nulls(t_two_sided_values(t.fillna(0).to_numpy(float), df.fillna(1).to_numpy(float)), known)


def normal_tail(z: Column) -> Column:
    return F.pandas_udf(_two_sided_normal, "double")(z)


def t_tail(t: Column, df: Column) -> Column:
    return F.pandas_udf(_two_sided_t, "double")(t, df.cast("double"))
