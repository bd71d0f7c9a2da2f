"""One-dimensional interpolation: knots become segments, values find their segment by an as-of join.

Few segments are searched where the values are; many are put in one order with
the values and scanned in pieces, the last segment before a piece being carried
into it (no range join, no nested loop, no series in one task). Outside the knots
the end segments extrapolate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArraySizeError, InvalidArgumentError, NonMonotonicError, PolynomialOrderError
from ..workers import importable
from .scan import PIECE_ROWS, ordered_scan

#: Segments that are sent to every task at most.
FEW_SEGMENTS = 20_000

SPLINE_QUADRATIC_OVER_INTERVAL, SPLINE_KNOWN_FIRST_DERIVATIVE, SPLINE_KNOWN_SECOND_DERIVATIVE, SPLINE_CONTINUOUS_THIRD_DERIVATIVE = 1000, 1001, 1002, 1003


def _asof(segments: DataFrame, values: DataFrame, x: str, by: Sequence[str], out: Column, few: int = FEW_SEGMENTS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``values`` with ``out`` of the segment (struct ``seg``) whose start is the last at or before x, or the first.

    Segments are counted. Up to ``few`` of them go to every task, where a sorted
    search finds those of a whole batch, and the values are not moved. More of
    them are put in one order with the values and scanned in pieces: the last
    segment before a piece is carried into it.
    """
    by = list(by)
    known = segments.select(*by, "start", "seg").limit(few + 1).collect()
    if len(known) <= few:
        return _asof_search(known, segments.select(*by, "start", "seg"), values, x, by, out)
    left = segments.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("start").alias("__x"), F.lit(0).alias("__kind"), "seg", *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in values.columns])
    right = values.select(*[F.col(b).alias(f"__{b}") for b in by], F.col(x).cast("double").alias("__x"), F.lit(1).alias("__kind"), F.lit(None).cast(segments.schema["seg"].dataType).alias("seg"), *values.columns)
    found = ordered_scan(left.unionByName(right), ["__x", "__kind"], [f"__{b}" for b in by], latest={"__seg": F.col("seg")}, piece_rows=piece_rows)
    found = found.filter("__kind = 1").drop("seg").withColumnRenamed("__seg", "seg")
    return found.select(*values.columns, F.when(F.col("__x").isNotNull(), out).alias("interpolated"))


def _asof_search(known: list, segments: DataFrame, values: DataFrame, x: str, by: list[str], out: Column) -> DataFrame:
    """:func:`_asof` with the segments ``known``: each value's place among the starts of its group by a sorted search in Arrow batches, then a broadcast join on that place."""
    spark = values.sparkSession
    # groups in the order of their first segment; a null is a value like others
    group_of = {key: i for i, key in enumerate(dict.fromkeys(tuple(r[b] for b in by) for r in known))}
    known = sorted(known, key=lambda r: (group_of[tuple(r[b] for b in by)], r["start"]))
    code = np.array([group_of[tuple(r[b] for b in by)] for r in known], np.int64)
    starts = np.array([r["start"] for r in known], float)
    first = np.searchsorted(code, np.arange(len(group_of) + 1))

    @F.pandas_udf("int")
    def place(g: pd.Series, at: pd.Series) -> pd.Series:
        g, at = g.to_numpy(), at.to_numpy()
        order = np.argsort(g, kind="stable")
        found = np.empty(len(g), np.int32)
        for part in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            if len(part):
                a, b = first[g[part[0]]], first[g[part[0]] + 1]
                found[part] = a + np.maximum(np.searchsorted(starts[a:b], at[part], side="right") - 1, 0)
        return pd.Series(found)

    seg = segments.schema["seg"]
    table = importable(spark).createDataFrame([(i, r["seg"]) for i, r in enumerate(known)], T.StructType([T.StructField("__place", T.IntegerType()), seg]))
    groups = spark.createDataFrame([(*key, i) for key, i in group_of.items()], T.StructType([*[T.StructField(f"__by{i}", segments.schema[b].dataType) for i, b in enumerate(by)], T.StructField("__code", T.IntegerType())]))
    rows = values.withColumn("__x", F.col(x).cast("double"))
    rows = rows.join(F.broadcast(groups), [F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)], "left") if by else rows.withColumn("__code", F.lit(0 if known else None).cast("int"))
    # values without a place or a group have no segment
    sought = F.when(F.col("__x").isNotNull() & F.col("__code").isNotNull(), place(F.coalesce("__code", F.lit(0)), F.coalesce("__x", F.lit(0.0))))
    rows = rows.withColumn("__place", sought).join(F.broadcast(table), "__place", "left")
    return rows.select(*values.columns, F.when(F.col("__x").isNotNull(), out).alias("interpolated"))


def _after(now: Column, later: Column) -> Column:
    """``later`` if it is beyond ``now``; equal knots are an error when the result is computed."""
    return F.when(later > now, later).when(later.isNotNull(), F.raise_error(F.lit("knots are strictly monotonic")).cast("double"))


def _knots(knots: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return knots.filter(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"))


def linear(knots: DataFrame, values: DataFrame, x: str, y: str, at: str, by: Sequence[str] = (), few: int = FEW_SEGMENTS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``values`` with interpolated: piecewise linear between the knots (x, y). Knots without an x are left out; two with the same x are an error."""
    by = list(by)
    k = ordered_scan(_knots(knots, x, y, by), ["x0"], by, rank="i", after={"x1": F.col("x0"), "y1": F.col("y0")}, piece_rows=piece_rows).filter("x1 is not null")
    seg = k.select(*by, F.when(F.col("i") == 1, F.lit(float("-inf"))).otherwise(F.col("x0")).alias("start"), F.struct("x0", "y0", _after(F.col("x0"), F.col("x1")).alias("x1"), "y1").alias("seg"))
    s = F.col("seg")
    return _asof(seg, values, at, by, s["y0"] + (F.col("__x") - s["x0"]) / (s["x1"] - s["x0"]) * (s["y1"] - s["y0"]), few, piece_rows)


def polynomial(knots: DataFrame, values: DataFrame, x: str, y: str, at: str, order: int = 2, by: Sequence[str] = (), few: int = FEW_SEGMENTS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``values`` with interpolated: the polynomial through the order + 1 knots from the one before the value's segment on, shifted to lie inside the knots. Knots without an x are left out; two with the same x are an error."""
    if order < 1:
        raise PolynomialOrderError("the order is at least 1")
    by = list(by)
    k = ordered_scan(_knots(knots, x, y, by), ["x0"], by, rank="i", size="n", before={"was": F.col("x0")}, piece_rows=piece_rows)
    k = k.withColumn("x0", F.when(F.col("was").isNull(), F.col("x0")).otherwise(_after(F.col("was"), F.col("x0"))))
    # every knot goes to the windows of order + 1 knots that it is in; a window is a group of that size
    sent = k.select(*by, F.struct("i", "x0", "y0").alias("knot"), F.explode(F.sequence(F.greatest(F.col("i") - order, F.lit(1)), F.col("i"))).alias("__first"))
    runs = sent.groupBy(*[F.col(b).alias(f"__{b}") for b in by], "__first").agg(F.sort_array(F.collect_list("knot")).alias("run"))
    # the window starts at the segment for order 1, else one before it
    back = 0 if order == 1 else 1
    first = F.greatest(F.least(F.col("i") - back, F.col("n") - order), F.lit(1))
    seg = k.filter(F.col("i") < F.col("n")).withColumn("first", first).select(*by, F.when(F.col("i") == 1, F.lit(float("-inf"))).otherwise(F.col("x0")).alias("start"), "first")
    seg = seg.join(runs, [*[F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.col("first") == F.col("__first")]).select(*by, "start", F.struct("run").alias("seg"))
    p, z = F.col("seg.run"), F.col("__x")
    total = F.lit(0.0)
    for i in range(order + 1):
        term = F.get(p, F.lit(i))["y0"]
        for j in range(order + 1):
            if j != i:
                term = term * (z - F.get(p, F.lit(j))["x0"]) / (F.get(p, F.lit(i))["x0"] - F.get(p, F.lit(j))["x0"])
        total = total + term
    return _asof(seg, values, at, by, total, few, piece_rows)


def check_knots(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots in increasing order; errors for other sizes and for values that are not strictly monotonic."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) != len(y):
        raise ArraySizeError("as many y as x")
    if len(x) < 2:
        raise ArraySizeError("at least two knots")
    d = np.diff(x)
    if not ((d > 0).all() or (d < 0).all()):
        raise NonMonotonicError("knots are strictly monotonic")
    return (x, y) if d[0] > 0 else (x[::-1], y[::-1])


def spline_second_derivatives(x: np.ndarray, y: np.ndarray, begin: int = SPLINE_QUADRATIC_OVER_INTERVAL, begin_value: float = 0.0, end: int = SPLINE_QUADRATIC_OVER_INTERVAL, end_value: float = 0.0) -> np.ndarray:
    """y'' at the knots of a cubic spline with the given end conditions; unknown conditions count as quadratic over the end interval."""
    n, h = len(x), np.diff(x)
    if n == 2 and begin not in (1001, 1002) and end not in (1001, 1002):
        return np.zeros(2)
    if n > 4:
        return _sweep(h, np.diff(y) / h, (begin, begin_value), (end, end_value))
    slope = np.diff(y) / h
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1] / 6, (h[i - 1] + h[i]) / 3, h[i] / 6
        b[i] = slope[i] - slope[i - 1]

    def close(row: int, kind: int, value: float, last: bool) -> None:
        i, j = (n - 1, n - 2) if last else (0, 1)
        step = h[-1] if last else h[0]
        if kind == SPLINE_KNOWN_FIRST_DERIVATIVE:
            a[row, i], a[row, j] = step / 3, step / 6
            b[row] = value - slope[-1] if last else slope[0] - value
        elif kind == SPLINE_KNOWN_SECOND_DERIVATIVE:
            a[row, i], b[row] = 1, value
        elif kind == SPLINE_CONTINUOUS_THIRD_DERIVATIVE and n > 2:
            k = n - 3 if last else 2
            g = h[-2] if last else h[1]
            a[row, i], a[row, j], a[row, k] = -g, step + g, -step
        else:
            a[row, i], a[row, j] = 1, -1

    close(0, begin, begin_value, False)
    close(n - 1, end, end_value, True)
    return np.linalg.solve(a, b) if np.linalg.matrix_rank(a) == n else np.linalg.lstsq(a, b, rcond=None)[0]


def _outermost(kind: int, value: float, h: np.ndarray, slope: float) -> tuple[float, float, float]:
    """(p, q, r): y'' at an end is p times that of the next knot, q times that of the one after, plus r. ``h`` and the end interval's ``slope`` are given outwards in."""
    if kind == SPLINE_KNOWN_FIRST_DERIVATIVE:
        return -0.5, 0.0, 3 * (slope - value) / h[0]
    if kind == SPLINE_KNOWN_SECOND_DERIVATIVE:
        return 0.0, 0.0, value
    if kind == SPLINE_CONTINUOUS_THIRD_DERIVATIVE:
        return (h[0] + h[1]) / h[1], -h[0] / h[1], 0.0
    return 1.0, 0.0, 0.0


def _sweep(h: np.ndarray, slope: np.ndarray, begin: tuple[int, float], end: tuple[int, float]) -> np.ndarray:
    """y'' at five knots or more: with the ends replaced by what they are in terms of their neighbours, the inner rows are tridiagonal and dominated by their diagonal."""
    low, mid, up, right = h[:-1] / 6, (h[:-1] + h[1:]) / 3, h[1:] / 6, np.diff(slope)
    p, q, r = _outermost(*begin, h[:2], slope[0])
    u, v, w = _outermost(*end, h[:-3:-1], slope[-1])
    if end[0] == SPLINE_KNOWN_FIRST_DERIVATIVE:
        w = -w
    mid[0], up[0], right[0] = mid[0] + low[0] * p, up[0] + low[0] * q, right[0] - low[0] * r
    mid[-1], low[-1], right[-1] = mid[-1] + up[-1] * u, low[-1] + up[-1] * v, right[-1] - up[-1] * w
    for i in range(1, len(mid)):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        right[i] -= f * right[i - 1]
    m = right / mid
    for i in range(len(mid) - 2, -1, -1):
        m[i] = (right[i] - up[i] * m[i + 1]) / mid[i]
    return np.concatenate([[p * m[0] + q * m[1] + r], m, [u * m[-1] + v * m[-2] + w]])


def spline(knots: DataFrame, values: DataFrame, x: str, y: str, at: str, begin: int = SPLINE_QUADRATIC_OVER_INTERVAL, begin_value: float = 0.0, end: int = SPLINE_QUADRATIC_OVER_INTERVAL, end_value: float = 0.0, by: Sequence[str] = (), few: int = FEW_SEGMENTS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``values`` with interpolated: cubic spline. The knots of a group are solved in one task; values join their segment as in :func:`linear`."""
    by = list(by)
    rows = knots.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        u, v = check_knots(part["x"].to_numpy(), part["y"].to_numpy())
        m = spline_second_derivatives(u, v, begin, begin_value, end, end_value)
        h = np.diff(u)
        out = part.iloc[:-1][by].copy()
        out["start"], out["x0"], out["c0"] = u[:-1], u[:-1], v[:-1]
        out["c1"] = np.diff(v) / h - h * (2 * m[:-1] + m[1:]) / 6
        out["c2"], out["c3"] = m[:-1] / 2, np.diff(m) / (6 * h)
        out.iloc[0, len(by)] = -np.inf
        return out

    names = ["start", "x0", "c0", "c1", "c2", "c3"]
    seg = importable(rows).groupBy(*by).applyInPandas(one, T.StructType([*[rows.schema[b] for b in by], *[T.StructField(c, T.DoubleType()) for c in names]]))
    seg = seg.select(*by, "start", F.struct(*names[1:]).alias("seg"))
    s, d = F.col("seg"), F.col("__x") - F.col("seg.x0")
    return _asof(seg, values, at, by, s["c0"] + d * (s["c1"] + d * (s["c2"] + d * s["c3"])), few, piece_rows)


def hermite_coefficients(x: np.ndarray, y: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled knots and divided differences of the one polynomial through values and slopes."""
    x, y, dy = np.asarray(x, float), np.asarray(y, float), np.asarray(dy, float)
    if not len(x) == len(y) == len(dy):
        raise ArraySizeError("as many values and slopes as knots")
    if len(np.unique(x)) < len(x):
        raise InvalidArgumentError("knots differ")
    z = np.repeat(x, 2)
    c = np.repeat(y, 2)
    for k in range(1, len(z)):
        top = c[1 : len(z) - k + 1] - c[: len(z) - k]
        gap = z[k:] - z[:-k]
        c_next = np.where(gap == 0, np.repeat(dy, 2)[: len(z) - k], top / np.where(gap == 0, 1, gap))
        if k == 1:
            table = [c[0]]
        table.append(c_next[0])
        c = c_next
    return z, np.array(table if len(z) > 1 else [y[0]])


def hermite(values: DataFrame, at: str, x: Sequence[float], y: Sequence[float], dy: Sequence[float]) -> DataFrame:
    """``values`` with interpolated and derivative of the global Hermite polynomial, by Horner's rule with literal coefficients."""
    z, c = hermite_coefficients(np.asarray(x), np.asarray(y), np.asarray(dy))
    v = F.col(at).cast("double")
    p, d = F.lit(float(c[-1])), F.lit(0.0)
    for i in range(len(c) - 2, -1, -1):
        gap = v - F.lit(float(z[i]))
        p, d = p * gap + F.lit(float(c[i])), d * gap + p
    return values.withColumn("interpolated", p).withColumn("derivative", d)

