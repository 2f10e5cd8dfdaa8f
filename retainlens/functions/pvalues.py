"""Tail probabilities without scipy.

* chi-square upper tail for integer dof — closed form (even: Poisson sum; odd: erfc + sum);
* Student-t two-sided p via the regularised incomplete beta (continued fraction, Lentz);
* two-sample Kolmogorov–Smirnov: exact by a lattice-path recursion, and the limit's tail as a Spark
  Column (alternating series, JVM-side).

The chi-square / t functions are scalar helpers wrapped in Arrow-batched pandas UDFs; they are
applied to one row per feature (a report), never per data row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_sf(x: float, dof: int) -> float:
    """P(X > x) for X ~ chi²(dof), integer dof ≥ 1."""
    if x is None or dof is None or dof < 1 or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    h = x / 2.0
    if dof % 2 == 0:
        # e^{-h} Σ_{i<dof/2} h^i / i!   (summed in log space to avoid overflow)
        terms = [math.exp(i * math.log(h) - h - math.lgamma(i + 1)) for i in range(dof // 2)]
        return min(1.0, math.fsum(terms))
    s = math.erfc(math.sqrt(h))
    terms = [math.exp((i + 0.5) * math.log(h) - h - math.lgamma(i + 1.5)) for i in range((dof - 1) // 2)]
    return min(1.0, s + math.fsum(terms))


def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 1e-15
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(ln_front) * _betacf(a, b, x) / a
    return 1.0 - math.exp(ln_front) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t with (real) dof."""
    if t is None or dof is None or math.isnan(t) or math.isnan(dof) or dof <= 0:
        return float("nan")
    return min(1.0, betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t)))


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), int(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(x, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_pvalue_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(t, dof)], dtype="float64")


def kolmogorov_sf(lam: Column, terms: int = 100) -> Column:
    """Q_KS(λ) = 2 Σ_{j≥1} (−1)^{j−1} e^{−2 j² λ²}, clamped to [0, 1] (λ < 0.05 → 1)."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, j: acc + 2 * F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * lam * lam))
    return (F.when(lam.isNull(), F.lit(None).cast("double"))
            .when(lam < 0.05, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))))


#: Samples of at most so many values get the exact two-sample KS p-value, larger ones the limit (the reference's switch).
EXACT_KS_ROWS = 10_000


def ks_exact_p(d: float, n: int, m: int) -> float:
    """P(D >= d) of the two-sample Kolmogorov–Smirnov statistic for n and m values without ties.

    All orders of the n + m values are equally likely; one is a lattice path from (0, 0) to (n, m), and D >= d if it
    meets a point with |i / n - j / m| >= d. The chance q(i, j) that the path to a point has met one is 1 at such points
    and else i / (i + j) q(i - 1, j) + j / (i + j) q(i, j - 1); one diagonal i + j at a time, all terms positive, so that
    small chances keep their digits. Only the points between the far ones are computed: about 2 d n m / (n + m) of a
    diagonal, and those beside them are 1.
    """
    far = round(d * n * m)
    if far <= 0:
        return 1.0
    q = np.ones(n + 3)  # q[i + 1] on the diagonal s
    q[1] = 0.0  # the path's start
    up, down = np.arange(n + 1, dtype=np.float64), np.arange(n + m, -1, -1, dtype=np.float64)
    was_lo, was_hi = 0, 0
    for s in range(1, n + m + 1):
        # |i m - (s - i) n| < far, so i (n + m) lies in (s n - far, s n + far).
        lo, hi = max(0, s - m, (s * n - far) // (n + m) + 1), min(s, n, -((-s * n - far) // (n + m)) - 1)
        if lo > hi:
            return 1.0
        # What the last diagonal left outside its band is far, or outside the lattice, where i or s - i is 0.
        q[was_hi + 2:hi + 2] = 1.0
        q[lo:was_lo + 1] = 1.0
        before = q[lo + 1:hi + 2] * down[n + m - s + lo:n + m - s + hi + 1] + q[lo:hi + 1] * up[lo:hi + 1]
        q[lo + 1:hi + 2] = before / s
        was_lo, was_hi = lo, hi
    return float(min(1.0, q[n + 1])) if was_lo <= n <= was_hi else 1.0


@F.pandas_udf(DoubleType())
def ks_exact_udf(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """One row a feature and group; null where a sample is empty or too large for the exact way."""
    ok = d.notna() & (n > 0) & (m > 0) & (n <= EXACT_KS_ROWS) & (m <= EXACT_KS_ROWS)
    return pd.Series([ks_exact_p(float(x), int(a), int(b)) if y else None for x, a, b, y in zip(d, n, m, ok)], dtype="float64")
