import json
import math
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.functions import distributions as D
from statloom.functions import kernel as K

GOLD = json.loads((Path(__file__).parent / "fixtures/goldens.json").read_text())["distributions"]
FAMILIES = {"t20": D.TDistribution(20.0), "normal": D.NormalDistribution.standardize(), "f8_10": D.FDistribution(8.0, 10.0), "chi5": D.ChiSquaredDistribution(5.0)}


def test_special_values():
    assert K.beta(2, 2) == pytest.approx(1 / 6)
    assert K.beta(4, 3) == pytest.approx(1 / 60)
    assert K.beta(1, 1) == pytest.approx(1)
    assert K.regularized_beta(1, 3, 0.4) == pytest.approx(0.784)
    assert K.incomplete_beta(1, 3, 0.4) == pytest.approx(0.784 / 3)
    assert K.incomplete_gamma_upper(1, 2) == pytest.approx(math.exp(-2))
    assert K.incomplete_gamma_lower(1, 2) == pytest.approx(1 - math.exp(-2))
    assert (K.incomplete_gamma_upper(1, 0), K.incomplete_gamma_lower(1, 0)) == (1, 0)
    assert K.incomplete_gamma_upper(1, 4) == pytest.approx(math.exp(-4))
    assert K.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert math.isnan(K.digamma(-1.0))
    assert K.factorial(5) == pytest.approx(120)


@pytest.mark.parametrize("name", GOLD)
def test_golden_densities(spark, name):
    dist, g = FAMILIES[name], GOLD[name]
    df = spark.createDataFrame([(float(x),) for x in g["x"]], "x double").select("x", dist.pdf(F.col("x")).alias("p"), dist.cdf(F.col("x")).alias("c"))
    got = {r.x: r for r in df.collect()}
    for x, p, c in zip(g["x"], g["pdf"], g["cdf"], strict=True):
        assert got[x].p == pytest.approx(p, abs=1.5e-8) and got[x].c == pytest.approx(c, abs=1.5e-8)
        assert dist.pdf(x) == pytest.approx(p, abs=1.5e-8) and dist.cdf(x) == pytest.approx(c, abs=1.5e-8)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.2, 5000), st.floats(0.2, 5000), st.floats(0.001, 0.999))
def test_beta_symmetry(a, b, x):
    assert K.regularized_beta(a, b, x) + K.regularized_beta(b, a, 1 - x) == pytest.approx(1, abs=1e-9)


@settings(max_examples=30, deadline=None)
@given(st.sampled_from([D.TDistribution(7.0), D.NormalDistribution(2.0, 1.0), D.FDistribution(5.0, 9.0), D.ChiSquaredDistribution(300.0), D.LogNormalDistribution(0.5, 1.0)]), st.floats(0.01, 0.99))
def test_ppf_inverts(dist, p):
    assert dist.cdf(dist.ppf(p)) == pytest.approx(p, abs=1e-8)


def test_large_degrees_of_freedom():
    """The folds are deep enough: twice the depth changes nothing."""
    for d in (1e3, 1e5):
        x = d / 2 * 1.01
        assert K.gamma_p(d / 2, x) + K.gamma_q(d / 2, x) == pytest.approx(1)
        assert D.FDistribution(d, d).cdf(1.0) == pytest.approx(0.5, abs=1e-9)


def test_ppf_of_columns(spark):
    row = spark.range(1).select(D.TDistribution(F.lit(10.0)).ppf(F.lit(0.975)).alias("t"), D.TDistribution(F.lit(30.0)).ppf(F.lit(0.975)).alias("u")).first()
    assert row.t == pytest.approx(2.228, abs=1e-3) and row.u == pytest.approx(2.042, abs=1e-3)


def test_properties():
    assert math.isnan(D.TDistribution(0.5).mean()) and D.TDistribution(1.5).variance() == math.inf
    assert math.isnan(D.FDistribution(3.0, 2.0).mean()) and D.FDistribution(3.0, 6.0).mean() == pytest.approx(1.5)
    assert D.BinomialDistribution(100.0, 0.25).variance() == pytest.approx(18.75)
    assert D.PoissonDistribution(4.0).cdf(2.0) == pytest.approx(math.exp(-4) * 13)
    assert D.LogNormalDistribution(0.5, 1.0).cdf(math.e) == pytest.approx(0.5)
    m = D.MultivariateNormalDistribution().initialize([0, 0], [[1, 0.5], [0.5, 2]])
    assert m.pdf(0.0, 0.0) == pytest.approx(1 / (2 * math.pi * math.sqrt(1.75)))


def test_t_quantile():
    """Closed forms for 1 and 2 degrees of freedom, the cdf between, and the expansion for very many."""
    for p in (0.6, 0.9, 0.975, 0.9999):
        assert K.t_quantile(p, 1) == pytest.approx(math.tan(math.pi * (p - 0.5)), rel=1e-12)
        assert K.t_quantile(p, 2) == pytest.approx((2 * p - 1) * math.sqrt(2 / (4 * p * (1 - p))), rel=1e-12)
        assert K.t_quantile(1 - p, 5) == pytest.approx(-K.t_quantile(p, 5), rel=1e-12)
        for dof in (3, 17.5, 400, 9999, 20_000):
            assert 0.5 * K.two_sided_t(K.t_quantile(p, dof), float(dof)) == pytest.approx(1 - p, rel=1e-10)
    assert K.t_quantile(0.975, 1e12) == pytest.approx(1.959963984540054, abs=1e-10)
    assert math.isnan(K.t_quantile(0.975, 0)) and math.isnan(K.t_quantile(1.0, 5))


EXTREME = [1e-12, 1e-8, 0.001, 0.3, 0.5, 0.7, 0.999, 1 - 1e-8, 1 - 1e-12]
QUANTILE_FAMILIES = {
    "t1": (D.TDistribution, (1.0,)), "t7": (D.TDistribution, (7.5,)), "t_big": (D.TDistribution, (1e5,)), "f": (D.FDistribution, (1.0, 1.0)), "f2": (D.FDistribution, (3.0, 40.0)), "chi": (D.ChiSquaredDistribution, (1.0,)),
    "chi_big": (D.ChiSquaredDistribution, (4e6,)), "normal": (D.NormalDistribution, (2.0, -3.0)), "log_normal": (D.LogNormalDistribution, (0.5, 1.0)), "poisson": (D.PoissonDistribution, (2e6,)), "binomial": (D.BinomialDistribution, (40.0, 0.3)),
}


def test_quantiles_of_columns_and_numbers(spark):
    """No bracket clips a quantile: columns and numbers agree over families and extreme probabilities."""
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(EXTREME)], "i int, p double").repartition(8)
    got = {r.i: r for r in rows.select("i", *[kind(*[F.lit(x) for x in args]).ppf(F.col("p")).alias(name) for name, (kind, args) in QUANTILE_FAMILIES.items()]).collect()}
    for i, p in enumerate(EXTREME):
        for name, (kind, args) in QUANTILE_FAMILIES.items():
            assert got[i][name] == pytest.approx(kind(*args).ppf(p), rel=1e-9, abs=1e-12), (name, p)


@pytest.mark.parametrize("p", EXTREME)
def test_quantiles_in_closed_form(p):
    q = 1 - p
    t = math.tan(math.pi * (p - 0.5)) if 0.01 < p < 0.99 else -1 / math.tan(math.pi * p) if p < 0.5 else 1 / math.tan(math.pi * q)
    assert D.TDistribution(1.0).ppf(p) == pytest.approx(t, rel=1e-9, abs=1e-12)
    assert D.FDistribution(1.0, 1.0).ppf(p) == pytest.approx(math.tan(math.pi * p / 2) ** 2 if p < 0.5 else 1 / math.tan(math.pi * q / 2) ** 2, rel=1e-9)
    assert D.FDistribution(2.0, 30.0).ppf(p) == pytest.approx(15 * math.expm1(-math.log(q) / 15) if p > 0.5 else 15 * math.expm1(-math.log1p(-p) / 15), rel=1e-9)
    assert D.FDistribution(6.0, 2.0).ppf(p) == pytest.approx((lambda lc: math.exp(lc) / (3 * -math.expm1(lc)))(math.log(p) / 3 if p < 0.5 else math.log1p(-q) / 3), rel=1e-9)
    assert D.ChiSquaredDistribution(2.0).ppf(p) == pytest.approx(-2 * (math.log(q) if p > 0.5 else math.log1p(-p)), rel=1e-9)


def test_quantiles_at_the_ends_and_beyond(spark):
    for d, low in ((D.NormalDistribution(), -math.inf), (D.TDistribution(3.0), -math.inf), (D.FDistribution(2.0, 3.0), 0.0), (D.ChiSquaredDistribution(3.0), 0.0)):
        assert d.ppf(0.0) == low and d.ppf(1.0) == math.inf and math.isnan(d.ppf(1.5))
        r = spark.sql("SELECT stack(4, 0D, 1D, 1.5D, null) AS p").select(d.ppf(F.col("p")).alias("x")).collect()
        assert r[0].x == low and r[1].x == math.inf and math.isnan(r[2].x) and r[3].x is None
    assert D.ChiSquaredDistribution(4e6).ppf(0.5) == pytest.approx(3_999_999.3333, rel=1e-9)
    x = D.ChiSquaredDistribution(1e8).ppf(0.999)
    assert x == pytest.approx(1e8 + 3.090232306167813 * math.sqrt(2e8) + 2 / 3 * (3.090232306167813**2 - 1), rel=1e-9)


def test_arrays_and_columns_are_as_numbers(spark):
    """Arrays with shallow and deep folds side by side, in any order; columns keep nulls, and hold no fold per row."""
    rng = np.random.default_rng(5)
    a, b, x = np.exp(rng.uniform(-2, 9, 200)), np.exp(rng.uniform(-2, 9, 200)), rng.uniform(0, 1, 200)
    y = a * rng.uniform(0.5, 1.5, 200)
    for f, args in ((K.regularized_beta, (a, b, x)), (K.gamma_p, (a, y)), (K.gamma_q, (a, y)), (K.erf, (x - 0.5,))):
        want = [f(*map(float, r)) for r in zip(*args, strict=True)]
        assert f(*args).tolist() == pytest.approx(want, rel=1e-9, abs=1e-13)
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(*args, strict=True))] + [(-1, *[None] * len(args))], ["i", *[f"a{j}" for j in range(len(args))]])
        cols = df.select("i", f(*[F.col(f"a{j}") for j in range(len(args))]).alias("v"))
        got = {r.i: r.v for r in cols.collect()}
        assert got.pop(-1) is None and [got[i] for i in range(200)] == pytest.approx(want, rel=1e-9, abs=1e-13)
        assert "aggregate(" not in cols._jdf.queryExecution().toString()


def test_many_quantiles_of_columns(spark):
    """A table of quantiles: 64 halvings of 64 levels and more each took over a millisecond a row as expressions."""
    began = time.perf_counter()
    p = (F.col("id") + 0.5) / 100_000
    worst = spark.range(100_000).select(F.max(F.abs(D.NormalDistribution().cdf(D.NormalDistribution().ppf(p)) - p)), F.max(F.abs(D.TDistribution(F.lit(3.0)).pdf(D.TDistribution(F.lit(3.0)).ppf(p))))).first()
    assert worst[0] < 1e-12 and worst[1] == pytest.approx(D.TDistribution(3.0).pdf(0.0), rel=1e-6)
    assert time.perf_counter() - began < 120
