"""Linear regression per group: sums in Spark, small solves in numpy.

The data-sized work is one aggregate of powers of the centred and scaled
predictor; each group then is one row, and the normal equations of that row are
solved in Arrow batches, where the statistics of the coefficients are finished too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInputError
from ..functions import kernel as K
from ..sources.shared import counted
from ..workers import importable
from .qr import r_factors, solved


#: Polynomials up to this order are solved from sums of products, higher ones from triangular factors.
SUMS_ORDER = 3


def r_squared(df: DataFrame, measured: str, modelled: str, by: Sequence[str] = (), parameters: int | None = None) -> DataFrame:
    """by, r_squared: 1 - sum (x - xm)^2 / ((n - 1) s^2); with ``parameters`` also adjusted_r_squared."""
    x, m = F.col(measured).cast("double"), F.col(modelled).cast("double")
    s = df.filter(x.isNotNull() & m.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_samp(x).alias("v"), F.sum((x - m) * (x - m)).alias("e"))
    s = s.withColumn("r_squared", 1 - F.col("e") / F.nullif((F.col("n") - 1) * F.col("v"), F.lit(0.0)))
    if parameters is None:
        return s.select(*by, "r_squared")
    return s.select(*by, "r_squared", (1 - (1 - F.col("r_squared")) * (F.col("n") - 1) / (F.col("n") - parameters - 1)).alias("adjusted_r_squared"))


def adjusted_r_squared(df: DataFrame, parameters: int, measured: str, modelled: str, by: Sequence[str] = ()) -> DataFrame:
    return r_squared(df, measured, modelled, by, parameters).select(*by, "adjusted_r_squared")


def design_matrix(df: DataFrame, x: str, order: int, intercept: bool = True) -> DataFrame:
    """``df`` with the columns c0 (1, with an intercept), c1 = x, c2 = x^2, ..."""
    if order < 1:
        raise InvalidInputError("the order is at least 1")
    v = F.col(x).cast("double")
    out = df.withColumn("c0", F.lit(1.0)) if intercept else df
    power = v
    for i in range(1, order + 1):
        out = out.withColumn(f"c{i}", power)
        power = power * v
    return out


def covariance_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, i, j, value: the pseudo-inverse of X'X (unscaled covariance of the coefficients), from merged triangular factors of X. Rows with a null are left out."""
    p, by = len(columns), list(by)

    def invert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                r = np.zeros((p + 1, p + 1))
                r[:p, :p] = np.asarray(row.r, float).reshape(p, p)
                c = solved(r, scaled=False)[1]
                out += [[getattr(row, b) for b in by] + [i, j, float(c[i, j])] for i in range(p) for j in range(p)]
            yield pd.DataFrame(out, columns=[*by, "i", "j", "value"])

    g = r_factors(df, columns, by)
    schema = T.StructType([*[g.schema[b] for b in by], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])
    return importable(g).mapInPandas(invert, schema)


def _statistics(parts: Iterator[pd.DataFrame], alpha: float) -> Iterator[pd.DataFrame]:
    quantiles: dict[float, float] = {}
    for part in parts:
        out = []
        for b, c, sse, n, p in zip(part["coefficient"], part["c"], part["sse"], part["n"], part["p"], strict=True):
            dof = float(n - p)
            se = math.sqrt(max(sse, 0.0) / dof * c) if dof > 0 and sse == sse and c >= 0 else math.nan
            t = b / se if se > 0 else math.nan
            if dof > 0 and dof not in quantiles:
                quantiles[dof] = K.t_quantile(1 - alpha / 2, dof)
            out.append((se, t, K.two_sided_t(float(t), dof) if t == t else math.nan, quantiles.get(dof, math.nan) * se))
        yield part.assign(**dict(zip(("standard_error", "t_statistic", "probability", "confidence_interval"), np.array(out, float).reshape(-1, 4).T, strict=True)))


def coefficient_statistics(fit: DataFrame, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Adds standard_error, t_statistic, probability, confidence_interval (half width) to rows with coefficient, c (the diagonal of (X'X)^-1), sse, n and p.

    These are a few numbers per group and come out of Python already: they are
    finished there, not as column expressions. Without degrees of freedom all four are null.
    """
    schema = T.StructType([*fit.schema, *[T.StructField(k, T.DoubleType()) for k in ("standard_error", "t_statistic", "probability", "confidence_interval")]])
    return importable(fit).mapInPandas(lambda it: _statistics(it, alpha), schema)


def _solve_factors(parts: Iterator[pd.DataFrame], by: list[str], order: int, intercept: bool) -> Iterator[pd.DataFrame]:
    """:func:`_solve` from the factors of the powers."""
    first = 0 if intercept else 1
    size = order + 1 - first
    for part in parts:
        out = []
        for row in part.itertuples(index=False):
            beta, inv, sse = solved(np.asarray(row.r, float).reshape(size + 1, size + 1))
            out += _raw_rows([getattr(row, b) for b in by], beta, inv, sse, int(row.n), row, order, first)
        yield pd.DataFrame(out, columns=[*by, "term", "coefficient", "c", "sse", "n", "p"])


def _raw_rows(keys: list, beta: np.ndarray, inv: np.ndarray, sse: float, n: int, row, order: int, first: int) -> list[list]:
    """Coefficients of the powers of z = (x - m) / d as those of the powers of x."""
    size = order + 1 - first
    change = np.zeros((order + 1, order + 1))
    poly = np.array([1.0])
    for k in range(order + 1):
        change[: len(poly), k] = poly
        poly = np.convolve(poly, [-row.m / row.d, 1 / row.d])
    change = change[first:, first:]
    raw, cov = change @ beta, change @ inv @ change.T
    out = []
    if first:
        out.append([*keys, 0, 0.0, 0.0, sse, n, size])
    elif row.y_mid:
        raw[0] += row.y_mid
    return out + [[*keys, i, float(raw[i - first]), float(cov[i - first, i - first]), sse, n, size] for i in range(first, order + 1)]


def _solve(parts: Iterator[pd.DataFrame], by: list[str], order: int, intercept: bool) -> Iterator[pd.DataFrame]:
    """Per row: centred sums -> coefficients of the raw powers, diagonal of (X'X)^-1 in the raw basis, sum of squared residuals."""
    first = 0 if intercept else 1
    for part in parts:
        out = []
        for row in part.itertuples(index=False):
            keys = [getattr(row, b) for b in by]
            s, t = np.asarray(row.s, float), np.asarray(row.t, float)
            idx = np.arange(first, order + 1)
            a = s[idx[:, None] + idx[None, :]]
            inv = np.linalg.pinv(a, rcond=1e-13, hermitian=True)
            beta = inv @ t[idx]
            sse = float(row.yy - 2 * beta @ t[idx] + beta @ a @ beta)
            out += _raw_rows(keys, beta, inv, sse, int(row.n), row, order, first)
        yield pd.DataFrame(out, columns=[*by, "term", "coefficient", "c", "sse", "n", "p"])


def linear_least_squares(df: DataFrame, x: str, y: str, order: int = 1, intercept: bool = True, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Polynomial least squares: by, term (0..order), coefficient, standard_error, t_statistic, probability, confidence_interval.

    The centres and scales of the groups are one aggregate; they are broadcast to
    the rows if there are few groups, so that the data are read twice and never
    moved. Without an intercept term 0 is 0 and has no statistics, and x is scaled
    but not centred. Rows with a null are left out.
    """
    if order < 1:
        raise InvalidInputError("the order is at least 1")
    by = list(by)
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(*by, u.alias("__x"), v.alias("__y")).dropna(subset=["__x", "__y"])
    mid = rows.groupBy(*by).agg(F.avg("__x").alias("m"), F.stddev_pop("__x").alias("d"), F.sqrt(F.avg(F.col("__x") * F.col("__x"))).alias("r"), F.avg("__y").alias("y_mid"))
    mid = mid.select(*[F.col(b).alias(f"__{b}") for b in by], (F.col("m") if intercept else F.lit(0.0)).alias("m"), F.when((F.col("d") if intercept else F.col("r")) > 0, F.col("d") if intercept else F.col("r")).otherwise(1.0).alias("d"), (F.col("y_mid") if intercept else F.lit(0.0)).alias("y_mid"))
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    mid = counted(mid)
    rows = rows.join(mid, same) if by else rows.crossJoin(mid)
    z, w = (F.col("__x") - F.col("m")) / F.col("d"), F.col("__y") - F.col("y_mid")
    power = lambda k: F.lit(1.0) if k == 0 else z if k == 1 else F.pow(z, F.lit(float(k)))
    if order > SUMS_ORDER:
        factors = r_factors(rows, [*[power(k) for k in range(0 if intercept else 1, order + 1)], w], by)
        keyed = mid if not by else mid.select("m", "d", "y_mid", *[F.col(f"__{b}") for b in by])
        sums = factors.join(keyed, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]) if by else factors.crossJoin(keyed)
    else:
        sums = rows.groupBy(*by).agg(F.array(*[F.sum(power(k)) for k in range(2 * order + 1)]).alias("s"), F.array(*[F.sum(power(k) * w) for k in range(order + 1)]).alias("t"), F.sum(w * w).alias("yy"), F.count(F.lit(1)).alias("n"), F.first("m").alias("m"), F.first("d").alias("d"), F.first("y_mid").alias("y_mid"))
    schema = T.StructType([*[rows.schema[b] for b in by], *[T.StructField(k, t) for k, t in (("term", T.IntegerType()), ("coefficient", T.DoubleType()), ("c", T.DoubleType()), ("sse", T.DoubleType()), ("n", T.LongType()), ("p", T.IntegerType()))]])
    solve = _solve_factors if order > SUMS_ORDER else _solve
    fit = importable(sums).mapInPandas(lambda it: solve(it, by, order, intercept), schema)
    stats = coefficient_statistics(fit, by, alpha)
    return stats.select(*by, "term", "coefficient", "standard_error", "t_statistic", "probability", "confidence_interval")


def predict(df: DataFrame, fit: DataFrame, x: str, y: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with modelled (and residual = modelled - y). ``fit`` has one row per term and group and is joined as an array per group."""
    c = fit.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("term", "coefficient"))).alias("__b"))
    c = c.select(*[F.col(b).alias(f"__{b}") for b in by], "__b")
    c = counted(c)
    rows = df.join(c, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]) if by else df.crossJoin(c)
    v = F.col(x).cast("double")
    out = rows.withColumn("modelled", F.aggregate(F.reverse("__b"), F.lit(0.0), lambda t, b: t * v + b["coefficient"]))
    out = out if y is None else out.withColumn("residual", F.col("modelled") - F.col(y))
    return out.drop("__b", *[f"__{b}" for b in by])


def jacobian(df: DataFrame, f: Callable[[Column, Sequence[Column]], Column], x: str, params: Sequence[float], step: float = 1.4901161193847656e-08) -> DataFrame:
    """``df`` with j0, j1, ...: forward differences of f(x, params) in each parameter, as expressions."""
    at = [F.lit(float(p)) for p in params]
    base = f(F.col(x), at)
    out = df
    for i in range(len(params)):
        moved = [*at[:i], F.lit(float(params[i]) + step), *at[i + 1 :]]
        out = out.withColumn(f"j{i}", (f(F.col(x), moved) - base) / F.lit(step))
    return out
