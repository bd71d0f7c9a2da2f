"""Merged triangular factors against solutions in higher precision."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import doe, regression
from statloom.operators.qr import r_factors


def exact(x, y):
    """Least squares by rational arithmetic: (coefficients, (X'X)^-1, sum of squared residuals)."""
    x, y = [[Fraction(v) for v in r] for r in x], [Fraction(v) for v in y]
    p = len(x[0])
    a = [[sum(r[i] * r[j] for r in x) for j in range(p)] + [Fraction(int(i == j)) for j in range(p)] + [sum(r[i] * v for r, v in zip(x, y))] for i in range(p)]
    for i in range(p):
        k = next(k for k in range(i, p) if a[k][i])
        a[i], a[k] = a[k], a[i]
        a[i] = [v / a[i][i] for v in a[i]]
        for k in range(p):
            if k != i and a[k][i]:
                a[k] = [u - a[k][i] * v for u, v in zip(a[k], a[i])]
    b = [r[-1] for r in a]
    sse = sum((v - sum(c * z for c, z in zip(b, r))) ** 2 for r, v in zip(x, y))
    return [float(v) for v in b], np.array([[float(v) for v in r[p : 2 * p]] for r in a]), float(sse)


def test_factors_do_not_depend_on_the_cut(spark):
    d = np.random.default_rng(1)
    x = d.normal(size=(500, 3))
    g = d.choice(["a", "b", None], 500).tolist()
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in zip(g, x)] + [("a", None, 1.0, 1.0)], "g string, u double, v double, w double")
    for parts in (1, 9):
        got = {r.g: (r.n, np.array(r.r).reshape(3, 3)) for r in r_factors(df.repartition(parts), ["u", "v", "w"], ["g"]).collect()}
        assert set(got) == {"a", "b", None}
        for k, (n, r) in got.items():
            part = x[[i for i, z in enumerate(g) if z == k]]
            assert n == len(part) and r.T @ r == pytest.approx(part.T @ part, rel=1e-12)
    assert r_factors(df.limit(0), ["u"], ["g"]).count() == 0


@pytest.mark.parametrize("offset", [0, 1000])
def test_order_eight(spark, offset):
    d = np.random.default_rng(3)
    x = (d.integers(0, 97, 300) / 16 + offset).tolist()
    y = [round(float(np.sin(v) + e), 6) for v, e in zip(x, d.normal(size=300))]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double").repartition(5)
    mid = offset + 3
    b, c, sse = exact([[(Fraction(v) - mid) ** k for k in range(9)] for v in x], y)
    fit = regression.linear_least_squares(df.withColumn("z", F.col("x") - mid), "z", "y", 8).orderBy("term").collect()
    assert [r.coefficient for r in fit] == pytest.approx(b, rel=1e-9)
    assert [r.standard_error for r in fit] == pytest.approx(np.sqrt(sse / 291 * np.diag(c)), rel=1e-8)
    back = regression.predict(df, regression.linear_least_squares(df, "x", "y", 8), "x", "y") if offset == 0 else None
    if back is not None:
        assert back.agg(F.sum(F.col("residual") * F.col("residual"))).first()[0] == pytest.approx(sse, rel=1e-9)


def test_covariance_with_an_offset(spark):
    x = [1e6 + i / 8 for i in range(200)]
    df = spark.createDataFrame([(1.0, v) for v in x], "one double, x double")
    _, c, _ = exact([[1, v] for v in x], [0] * 200)
    got = {(r.i, r.j): r.value for r in regression.covariance_matrix(df, ["one", "x"]).collect()}
    assert [got[i, j] for i in (0, 1) for j in (0, 1)] == pytest.approx(c.ravel().tolist(), rel=1e-7)


def test_three_ways_with_equal_columns(spark):
    """Terms that are equal as columns share the coefficient of their sum; the mask drops terms; offsets do no harm."""
    d = np.random.default_rng(5)
    u = (d.integers(-4, 5, (400, 2)) / 4 + 20).tolist()
    y = [float(a * b * 0.5 - a * a * b * 0.25 + d.normal() * 0.1) for a, b in u]
    df = spark.createDataFrame([(a, b, z) for (a, b), z in zip(u, y)], "a double, b double, y double").repartition(4)
    every = doe.terms(3, 2)
    columns = sorted({tuple(sorted(t)) for t in every})
    b, _, _ = exact([[np.prod([Fraction(r[i]) for i in t]) if t else 1 for t in columns] for r in u], y)
    share = {t: v / sum(tuple(sorted(e)) == t for e in every) for t, v in zip(columns, b)}
    got = {r.term: r.coefficient for r in doe.fit_rows(df, 3, ["a", "b"], "y").collect()}
    assert [got[i] for i in range(len(every))] == pytest.approx([share[tuple(sorted(t))] for t in every], rel=1e-6)
    kept = [len(t) < 2 or t == (0, 1) for t in every]
    got = {r.term: r.coefficient for r in doe.fit_rows(df, 3, ["a", "b"], "y", kept).collect()}
    b, _, _ = exact([[1, r[0], r[1], r[0] * r[1]] for r in u], y)
    assert [got[i] for i, k in enumerate(kept) if k] == pytest.approx(b, rel=1e-9)
    assert all(np.isnan(got[i]) for i, k in enumerate(kept) if not k)
