"""Special functions on Spark columns (``COL``), numpy arrays (``ARR``) and Python numbers (``NUM``).

A kernel has the same methods in all forms, so a formula that is written with a
kernel works on each. The continued fractions and series are folds of a depth
that depends on the parameters (``20 + 5 sqrt(max(a, b))`` and ``60 + 8 sqrt(a)``
levels). On columns they, the quantiles and densities with log-gammas run on arrays, in Arrow batches (see
:func:`by_arrow`): a level is a few numpy calls for all rows of a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..workers import importable

#: Lanczos coefficients for g = 7, n = 9.
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: B_2k / 2k of the asymptotic series of digamma.
DIGAMMA_TERMS = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12)

#: Rows of a batch whose last levels are folded one by one: an array of fewer costs more than numbers do.
FEW = 12

Number = Column | np.ndarray | float | int


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


class ColumnKernel:
    """The functions as Spark expressions."""

    pi = math.pi
    inf, nan = float("inf"), float("nan")

    def const(self, x: Number) -> Column:
        return _c(x)

    def where(self, cond: Column, a: Number, b: Number) -> Column:
        return F.when(cond, _c(a)).otherwise(_c(b))

    def exp(self, x: Number) -> Column:
        return F.exp(_c(x))

    def log(self, x: Number) -> Column:
        return F.log(_c(x))

    def sqrt(self, x: Number) -> Column:
        return F.sqrt(_c(x))

    def abs(self, x: Number) -> Column:
        return F.abs(_c(x))

    def floor(self, x: Number) -> Column:
        return F.floor(_c(x)).cast("double")

    def pow(self, x: Number, y: Number) -> Column:
        return F.pow(_c(x), _c(y))

    def maximum(self, a: Number, b: Number) -> Column:
        return F.greatest(_c(a), _c(b))

    def minimum(self, a: Number, b: Number) -> Column:
        return F.least(_c(a), _c(b))

    def both(self, a: Column, b: Column) -> Column:
        return a & b

    def lgamma(self, x: Number) -> Column:
        y = self.const(x)
        series = LANCZOS[0]
        for i, c in enumerate(LANCZOS[1:]):
            series = series + c / (y + float(i))
        t = y + (LANCZOS_G - 0.5)
        return (y - 0.5) * self.log(t) - t + self.log(math.sqrt(2 * math.pi) * series)


class NumberKernel:
    """The functions on Python floats."""

    pi = math.pi
    inf, nan = float("inf"), float("nan")

    def const(self, x: float) -> float:
        return float(x)

    def where(self, cond: bool, a: float, b: float) -> float:
        return a if cond else b

    def exp(self, x: float) -> float:
        return math.exp(x) if x < 709.7 else math.inf

    def log(self, x: float) -> float:
        return math.log(x) if x > 0 else -math.inf if x == 0 else math.nan

    def sqrt(self, x: float) -> float:
        return math.sqrt(x) if x >= 0 else math.nan

    def abs(self, x: float) -> float:
        return abs(x)

    def floor(self, x: float) -> float:
        return float(math.floor(x))

    def pow(self, x: float, y: float) -> float:
        return x**y

    def maximum(self, a: float, b: float) -> float:
        return max(a, b)

    def minimum(self, a: float, b: float) -> float:
        return min(a, b)

    def both(self, a: bool, b: bool) -> bool:
        return a and b

    def fold(self, depth: float, start: float, step: Callable, *args: float) -> float:
        """``step(kernel, t, n, *args)`` for n from ``depth`` down to 1."""
        t = float(start)
        for n in range(math.ceil(depth), 0, -1):
            t = step(self, t, float(n), *args)
        return t

    def lgamma(self, x: float) -> float:
        return math.lgamma(x) if x > 0 else math.nan


class ArrayKernel:
    """The functions on numpy arrays."""

    pi = math.pi
    inf, nan = float("inf"), float("nan")

    const = staticmethod(lambda x: np.asarray(x, float))
    where, exp, log, sqrt, abs, floor, pow, maximum, minimum, both = (staticmethod(f) for f in (np.where, np.exp, np.log, np.sqrt, np.abs, np.floor, np.power, np.maximum, np.minimum, np.logical_and))

    def fold(self, depth: np.ndarray, start: float, step: Callable, *args: np.ndarray) -> np.ndarray:
        """As for numbers, each row to its own depth: the rows are ordered by depth, so that a level runs on those that reach it."""
        depth = np.ceil(np.where(np.isfinite(depth), depth, 0)).astype(np.int64)
        order = np.argsort(-depth, kind="stable")
        deep, args = depth[order], [np.broadcast_to(a, depth.shape)[order] for a in args]
        t = np.full(len(deep), float(start))
        shared = int(deep[FEW]) if len(deep) > FEW else 0
        for i in range(min(FEW, len(deep))):
            t[i] = self._alone(int(deep[i]), shared, float(start), step, [float(a[i]) for a in args])
        reach = np.searchsorted(-deep, -np.arange(shared + 1), side="right")
        for n in range(shared, 0, -1):
            m = int(reach[n])
            t[:m] = step(self, t[:m], float(n), *[a[:m] for a in args])
        out = np.empty(len(t))
        out[order] = t
        return out

    def _alone(self, depth: int, end: int, start: float, step: Callable, args: list[float]) -> float:
        """The levels of one row above ``end``."""
        t = start
        try:
            for n in range(depth, end, -1):
                t = step(NUM, t, float(n), *args)
        except (ZeroDivisionError, OverflowError):  # numpy goes on with infinity
            one, t = [np.array([a]) for a in args], np.array([start])
            for n in range(depth, end, -1):
                t = step(self, t, float(n), *one)
        return float(np.ravel(t)[0])

    lgamma = ColumnKernel.lgamma


COL, ARR, NUM = ColumnKernel(), ArrayKernel(), NumberKernel()


def of(*xs: Number):
    """The kernel for the arguments: columns if one of them is a column, else arrays if one is an array."""
    return COL if any(isinstance(x, Column) for x in xs) else ARR if any(isinstance(x, np.ndarray) for x in xs) else NUM


def by_arrow(f: Callable, *args: Number) -> Column:
    """``f`` of arrays as a column of ``args``, null where one of them is null. Equal arguments within a batch are computed once."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        importable(spark)
    numbers = {i: float(a) for i, a in enumerate(args) if not isinstance(a, Column)}
    columns = [a.cast("double") for a in args if isinstance(a, Column)]
    many = len(args)

    def run(*batch: pd.Series) -> pd.Series:
        rows = pd.concat([b.rename(i) for i, b in enumerate(batch)], axis=1)
        at = rows.groupby(list(rows.columns), sort=False, dropna=False).ngroup().to_numpy()
        rest = iter(rows[~rows.duplicated()].to_numpy(float).T.copy())
        with np.errstate(all="ignore"):
            got = f(*[numbers[i] if i in numbers else next(rest) for i in range(many)])
        return pd.Series(np.asarray(got, float)[at])

    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.coalesce(F.pandas_udf(run, "double")(*columns), F.lit(math.nan)))  # pandas has one missing number for both


def _safe(k, x: Number, low: float = 1e-300, high: float | None = None):
    x = k.maximum(x, low)
    return x if high is None else k.minimum(x, high)


def lgamma(x: Number):
    """Logarithm of the gamma function for x > 0."""
    return of(x).lgamma(x)


def gamma(x: Number):
    """The gamma function for x > 0."""
    k = of(x)
    return k.exp(k.lgamma(x))


def factorial(x: Number):
    """Gamma(x + 1) for real x > -1."""
    return gamma(x + 1)


def beta(a: Number, b: Number):
    k = of(a, b)
    return k.exp(k.lgamma(a) + k.lgamma(b) - k.lgamma(a + b))


def _beta_tail(k, a, b, x):
    """I_x(a, b) by the continued fraction that converges for x <= (a + 1) / (a + b + 2); x is inside (0, 1)."""

    def level(_, t, i, a, b, x):
        m = i // 2
        over = m * (b - m) if 2 * m == i else -(a + m) * (a + b + m)
        return over * x / ((a + i - 1) * (a + i)) / (1 + t)

    depth = 20 + 5 * k.sqrt(k.maximum(a, b))
    front = k.exp(k.lgamma(a + b) - k.lgamma(a) - k.lgamma(b) + a * k.log(x) + b * k.log(1 - x)) / a
    return front / (1 + k.fold(depth, 0.0, level, a, b, x))


def regularized_beta(a: Number, b: Number, x: Number):
    """I_x(a, b): 0 for x <= 0, 1 for x >= 1."""
    k = of(a, b, x)
    if k is COL:
        return by_arrow(regularized_beta, a, b, x)
    a, b, x = (k.const(v) for v in (a, b, x))
    if k is ARR:
        a, b, x = np.broadcast_arrays(a, b, x)
    inside = k.minimum(_safe(k, x), 1 - 1e-16)
    left = inside <= (a + 1) / (a + b + 2)
    if k is NUM:
        got = _beta_tail(k, a, b, inside) if left else 1 - _beta_tail(k, b, a, 1 - inside)
    else:  # one fold: the arguments are swapped where the other side converges
        p, q, z = k.where(left, a, b), k.where(left, b, a), k.where(left, inside, 1 - inside)
        tail = _beta_tail(k, p, q, k.minimum(_safe(k, z), 1 - 1e-16))
        got = k.where(left, tail, 1 - tail)
    return k.where(x <= 0, 0.0, k.where(x >= 1, 1.0, got))


def incomplete_beta(a: Number, b: Number, x: Number):
    """B(a, b) I_x(a, b)."""
    return beta(a, b) * regularized_beta(a, b, x)


def _gamma_series(k, a, x):
    """P(a, x) for x <= a + 1."""
    total = k.fold(60 + 8 * k.sqrt(a), 1.0, lambda _, t, n, a, x: 1 + x / (a + n) * t, a, x)
    return total * k.exp(a * k.log(x) - x - k.lgamma(a + 1))


def _gamma_fraction(k, a, x):
    """Q(a, x) for x > a + 1."""
    t = k.fold(60 + 8 * k.sqrt(a), 0.0, lambda _, t, n, a, x: n * (n - a) / (x + 2 * n + 1 - a - t), a, x)
    return k.exp(a * k.log(x) - x - k.lgamma(a)) / (x + 1 - a - t)


def _gamma_pair(a: Number, x: Number, upper: bool):
    k = of(a, x)
    if k is COL:
        return by_arrow(gamma_q if upper else gamma_p, a, x)
    a, x = k.const(a), k.const(x)
    if k is ARR:
        a, x = np.broadcast_arrays(a, x)
    z = _safe(k, x)
    small = z <= a + 1
    if k is NUM:
        got = _gamma_series(k, a, z) if small else _gamma_fraction(k, a, z)
        got = got if small != upper else 1 - got
    else:
        got, other = np.empty(z.shape), ~small
        got[small], got[other] = _gamma_series(k, a[small], z[small]), _gamma_fraction(k, a[other], z[other])
        got = np.where(small != upper, got, 1 - got)
    return k.where(x <= 0, 1.0 if upper else 0.0, got)


def gamma_p(a: Number, x: Number):
    """Regularized lower incomplete gamma function."""
    return _gamma_pair(a, x, False)


def gamma_q(a: Number, x: Number):
    """Regularized upper incomplete gamma function."""
    return _gamma_pair(a, x, True)


def incomplete_gamma_upper(a: Number, x: Number):
    return gamma(a) * gamma_q(a, x)


def incomplete_gamma_lower(a: Number, x: Number):
    return gamma(a) * gamma_p(a, x)


def erf(x: Number):
    k = of(x)
    p = gamma_p(0.5, x * x)
    return k.where(x < 0, -p, p)


def digamma(x: Number):
    """Derivative of the logarithm of the gamma function; NaN for x <= 0."""
    k = of(x)
    x = k.const(x)
    z = _safe(k, x)
    y = z + 9
    r = 1 / (y * y)
    tail = 0.0
    for c in reversed(DIGAMMA_TERMS):
        tail = (tail + c) * r
    below = 1 / z
    for i in range(1, 9):
        below = below + 1 / (z + i)
    return k.where(x <= 0, math.nan, k.log(y) - 1 / (2 * y) - tail - below)


def normal_cdf(z: Number):
    k = of(z)
    half = 0.5
    q = 0.5 * gamma_q(half, z * z / 2)
    return k.where(z > 0, 1 - q, q)


def two_sided_t(t: Number, dof: Number):
    """P(|T| >= |t|) for Student's t."""
    k = of(t, dof)
    half = 0.5
    return regularized_beta(dof / 2, half, dof / (dof + t * t))


def t_quantile(p: float, dof: float) -> float:
    """The t with P(T <= t) = p, a number for numbers: Fisher's expansion around the normal quantile where it is exact to double precision, else safeguarded Newton steps."""
    if not 0 < p < 1 or not dof > 0:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    z = NormalDist().inv_cdf(p)
    g = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    t = z + sum(c / dof ** (i + 1) for i, c in enumerate(g))
    if dof >= 1e4 and z < 8:
        return t
    low, high = 0.0, max(2 * abs(t), 2.0)
    tail = 1 - p
    while 0.5 * two_sided_t(high, dof) > tail:
        low, high = high, 4 * high
    t = min(max(t, low), high)
    for _ in range(200):
        over = 0.5 * two_sided_t(t, dof) - tail  # falls in t
        low, high = (t, high) if over > 0 else (low, t)
        density = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi) - (dof + 1) / 2 * math.log1p(t * t / dof))
        step = t + over / density if density > 0 else math.inf
        new = step if low < step < high else (low + high) / 2
        if abs(new - t) <= 1e-15 * abs(new):
            return new
        t = new
    return t


def f_upper(f: Number, d1: Number, d2: Number):
    """P(F >= f), without cancellation."""
    return regularized_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: Number, dof: Number):
    return gamma_q(dof / 2, x / 2)


#: Logarithms of the numbers between which quantiles are sought: those of the least and the largest double. So many halvings leave a relative error of 1e-16.
LOG_LOW, LOG_HIGH, HALVINGS = -745.0, 709.75, 64


def invert_tail(k, tail: Callable, q: Number, steps: int = HALVINGS):
    """The x > 0 with tail(x) = q, for a tail that falls: halving of the logarithm, so that any double is found to the same relative precision."""
    return _positive(k, lambda x: tail(x) > q, steps)


def invert_positive(k, cdf: Callable, sf: Callable, p: Number, most: Number | None = None, steps: int = HALVINGS):
    """The x > 0, and at most ``most``, with cdf(x) = p. Above a half it is sought in the upper tail, where 1 - cdf would cancel."""
    if k is NUM:
        return _positive(k, (lambda x: sf(x) > 1 - p) if p > 0.5 else (lambda x: cdf(x) < p), steps, most)
    return _positive(k, lambda x: np.where(p > 0.5, sf(x) > 1 - p, cdf(x) < p), steps, most)


def _positive(k, short: Callable, steps: int, most: Number | None = None):
    """Where ``short`` (x is too small) turns false."""
    lo, hi = LOG_LOW, k.const(LOG_HIGH) if most is None else k.log(most)
    for _ in range(steps):
        mid = (lo + hi) / 2
        right = short(k.exp(mid))
        lo, hi = k.where(right, mid, lo), k.where(right, hi, mid)
    return k.exp((lo + hi) / 2)
