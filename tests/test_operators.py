import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.errors import ArraySizeError, InvalidInputError, NonMonotonicError, UnderdefinedProblemError
from statloom.functions import distributions as D
from statloom.operators import anova, descriptive, doe, hypothesis, interp, mcmc, nonlinear, regression, sampling, series

G = json.loads((Path(__file__).parent / "fixtures/goldens.json").read_text())


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def two(spark, a, b):
    return frame(spark, [("1", i, v) for i, v in enumerate(a)] + [("2", i, v) for i, v in enumerate(b)], "g string, i int, v double").repartition(3)


def test_order_statistics(spark):
    df = frame(spark, [(float(v),) for v in (1, 2, 2, 4, 7, 9, 3)], "v double")
    assert descriptive.median(df, "v").first()[0] == 3.0
    assert descriptive.quantile(frame(spark, [(1.0,), (2.0,), (4.0,), (7.0,)], "v double"), "v", 0.25).first().quantile == 1.25
    one = frame(spark, [(5.0,), (None,)], "v double")
    assert descriptive.quantile(one, "v", 0.9).first().quantile == 5.0
    assert descriptive.variance(one, "v").first()[0] is None and descriptive.variance(one, "v", compat=True).first()[0] == 0
    assert descriptive.median(one.limit(0), "v").count() == 0


def test_quantiles_equal_numpy_by_group(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.exponential(1, 3000), 2)
    g = np.where(rng.random(3000) < 0.9, "hot", None)
    df = frame(spark, [(None if x is None else str(x), float(y)) for x, y in zip(g, v)], "g string, v double").repartition(5)
    got = {(r.g, r.q): r.quantile for r in descriptive.quantiles(df, "v", [0.05, 0.5, 0.99], ["g"]).collect()}
    trimmed = {r.g: r.trimmed_mean for r in descriptive.trimmed_mean(df, "v", 0.1, ["g"]).collect()}
    for name in ("hot", None):
        s = np.sort(v[[x is None if name is None else x == name for x in g]])
        for q in (0.05, 0.5, 0.99):
            assert got[name, q] == pytest.approx(np.quantile(s, q, method="weibull"))
        i = max(math.floor(len(s) * 0.1), 1)
        assert trimmed[name] == pytest.approx(s[i - 1 : len(s) - i + 1].mean())


def test_t_tests(spark):
    df = two(spark, G["t_test"]["a"], G["t_test"]["b"])
    assert hypothesis.t_test_equal_variance(df, "v", "g", "1", "2").first().p == pytest.approx(0.400311271833311, abs=1.5e-8)
    assert hypothesis.t_test_unequal_variance(df, "v", "g", "1", "2").first().p == pytest.approx(0.393261072269881, abs=1.5e-8)
    n = len(G["t_test"]["a"])
    pairs = frame(spark, list(zip(G["t_test"]["a"], G["t_test"]["b"][:n])) + [(None, 1.0)], "a double, b double")
    assert hypothesis.t_test_paired(pairs, "a", "b").first().p == pytest.approx(0.336451697935195, abs=1.5e-8)


def test_f_bartlett_levene(spark):
    assert hypothesis.f_test(two(spark, G["f_test"]["a"], G["f_test"]["b"]), "v", "g", "1", "2").first().p == pytest.approx(0.917845200397729, abs=1.5e-8)
    df = two(spark, *G["groups"])
    b, l = hypothesis.bartlett(df, "v", "g").first(), hypothesis.levene(df, "v", "g").first()
    assert (b.statistic, b.p) == (pytest.approx(1.52960933869, abs=1e-8), pytest.approx(0.21617108550, abs=1e-8))
    assert (l.statistic, l.p) == (pytest.approx(4.85959468188, abs=1e-8), pytest.approx(0.03231972203, abs=1e-8))
    assert hypothesis.bartlett(df.filter("g = '1'"), "v", "g").first().statistic is None


def test_intervals():
    assert hypothesis.sample_size(D.NormalDistribution(), 1.0, 1.0, 0.8, 0.05) == pytest.approx(15.698, abs=1e-3)
    for dof, f in ((10, 2.228), (20, 2.086), (30, 2.042)):
        assert hypothesis.half_width(D.TDistribution(dof), 0.05, 1.0, 1.0) == pytest.approx(f, abs=1e-3)


def test_anova(spark):
    v = G["anova1"]
    df = frame(spark, [(i // 10, x) for i, x in enumerate(v)], "level int, v double")
    r = {x.source: x for x in anova.one_factor(df, "v", "level").collect()}
    assert r["main"].variance == pytest.approx(352.8, abs=1e-3) and r["within"].variance == pytest.approx(164.344, abs=1e-3)
    assert r["main"].f_statistic == pytest.approx(2.147, abs=1e-3) and r["main"].probability == pytest.approx(0.160, abs=1e-3)
    assert r["total"].sum_of_squares == pytest.approx(3311.0, abs=0.1) and r["within"].f_statistic is None
    rows = [(i // 5, k, x) for k, part in enumerate(G["anova2"]) for i, x in enumerate(part)]
    df = frame(spark, rows, "f1 int, f2 int, v double")
    r = {x.source: x for x in anova.two_factor(df, "v", "f1", "f2").collect()}
    for name, ms, f, p in (("main", 352.8, 2.003, 0.176), ("main2", 135.2, 0.768, 0.394), ("interaction", 5.0, 0.028, 0.868)):
        assert (r[name].variance, r[name].f_statistic, r[name].probability) == tuple(pytest.approx(z, abs=1e-3) for z in (ms, f, p))
    assert r["within"].variance == pytest.approx(176.125, abs=1e-3)
    with pytest.raises(Exception, match="not balanced"):
        anova.two_factor(df.limit(19), "v", "f1", "f2").collect()
    df = frame(spark, list(zip(G["anova_fit"]["ymeas"], G["anova_fit"]["ymod"])), "y double, m double")
    r = {x.source: x for x in anova.model_fit(df, "y", "m", 2).collect()}
    assert r["main"].variance == pytest.approx(5.871, abs=1e-3) and r["main"].f_statistic == pytest.approx(10226.742, rel=1e-3)


def test_linear_regression(spark):
    x, y = G["linreg"]["x"], G["linreg"]["y"]
    df = frame(spark, list(zip(x, y)), "x double, y double")
    r = regression.linear_least_squares(df, "x", "y", 1).orderBy("term").collect()
    assert [z.standard_error for z in r] == [pytest.approx(0.008, abs=1e-3), pytest.approx(0.005, abs=1e-3)]
    assert [z.t_statistic for z in r] == [pytest.approx(67.836, abs=1e-3), pytest.approx(101.127, abs=1e-3)]
    r = regression.linear_least_squares(df, "x", "y", 1, intercept=False).orderBy("term").collect()
    assert [z.coefficient for z in r] == [0, pytest.approx(0.7668972622, abs=1e-8)]
    for order in (2, 3, 4):
        got = [z.coefficient for z in regression.linear_least_squares(df, "x", "y", order).orderBy("term").collect()]
        assert got == pytest.approx(np.polyfit(x, y, order)[::-1], abs=1e-8)
    with pytest.raises(InvalidInputError):
        regression.linear_least_squares(df, "x", "y", 0)
    r2 = frame(spark, list(zip(G["r2"]["x"], G["r2"]["xm"])), "x double, xm double")
    assert regression.r_squared(r2, "x", "xm").first()[0] == pytest.approx(0.99964955179438, abs=1.5e-8)
    assert regression.adjusted_r_squared(r2, 2, "x", "xm").first()[0] == pytest.approx(0.999631107152, abs=1.5e-8)


def test_many_groups_equal_single_fits(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(a), float(2 * k + 3 * a + e)) for k in range(6) for a, e in zip(rng.random(20) + 1000, rng.normal(0, 0.1, 20))]
    df = frame(spark, rows, "k int, x double, y double").repartition(5)
    got = {(r.k, r.term): r.coefficient for r in regression.linear_least_squares(df, "x", "y", 1, by=["k"]).collect()}
    for k in range(6):
        xs, ys = zip(*[(a, b) for j, a, b in rows if j == k])
        m = np.mean(xs)
        slope, at_mean = np.polyfit(np.array(xs) - m, ys, 1)
        assert got[k, 1] == pytest.approx(slope) and got[k, 0] + got[k, 1] * m == pytest.approx(at_mean)


@pytest.mark.parametrize("method", [1, 2, 3])
def test_nonlinear_fit(method):
    controls = nonlinear.IterationControls(residual_tolerance=1e-12, change_in_solution_tolerance=1e-11)
    f = nonlinear.fit(lambda x, p: p[0] * x**3 + p[1] * x**2 + p[2] * x + p[3], G["nlls"]["x"], G["nlls"]["y"], [1, 1, 1, 1], controls=controls, options=nonlinear.SolverOptions(method=method))
    assert f.params == pytest.approx([1.0647627571, -0.1223202909, 0.4466134462, 1.1866142244], abs=1e-3)


def test_nonlinear_bounds_weights_and_checks(spark):
    x = np.linspace(0, 2, 21)
    y = 2 * np.exp(-0.7 * x)
    f = nonlinear.fit(lambda x, p: p[0] * np.exp(-p[1] * x), x, y, [1, 1], upper=[1.5, 9])
    assert f.params[0] == pytest.approx(1.5)
    with pytest.raises(UnderdefinedProblemError):
        nonlinear.fit(lambda x, p: x, x[:1], y[:1], [1, 1])
    with pytest.raises(ArraySizeError):
        nonlinear.fit(lambda x, p: x, x, y[:3], [1.0])
    df = frame(spark, [(g, float(a), float(g * b)) for g in (1, 2) for a, b in zip(x, y)], "g int, x double, y double")
    got = {(r.g, r.parameter): r.estimate for r in nonlinear.nonlinear_least_squares(df, lambda x, p: p[0] * np.exp(-p[1] * x), "x", "y", [1.0, 1.0], by=["g"], controls=nonlinear.IterationControls(residual_tolerance=1e-13)).collect()}
    assert got == {(1, 0): pytest.approx(2, abs=1e-3), (1, 1): pytest.approx(0.7, abs=1e-3), (2, 0): pytest.approx(4, abs=1e-3), (2, 1): pytest.approx(0.7, abs=1e-3)}


def test_jacobian(spark):
    df = frame(spark, [(-1.25,), (0.0,), (1.25,)], "x double")
    for r in regression.jacobian(df, lambda x, p: p[0] * x * x + p[1] * x + p[2], "x", [0.5, -1.35, 1.2]).collect():
        assert (r.j0, r.j1, r.j2) == (pytest.approx(r.x**2, abs=1e-4), pytest.approx(r.x, abs=1e-4), pytest.approx(1, abs=1e-4))


def test_experimental_design(spark):
    assert doe.full_factorial_size([2, 4, 3]) == (24, 3)
    rows = [(r.f1, r.f2, r.f3) for r in doe.full_factorial(spark, [2, 4, 3]).orderBy("run").collect()]
    assert rows == [(a, b, c) for a in (1, 2) for b in (1, 2, 3, 4) for c in (1, 2, 3)]
    assert len(doe.terms(2, 3)) == 10 and len(doe.terms(3, 3)) == 34
    df = frame(spark, list(zip(G["linreg"]["x"], G["linreg"]["y"])), "x double, y double")
    a = doe.fit_rows(df, 1, ["x"], "y").orderBy("term").collect()
    b = regression.linear_least_squares(df, "x", "y", 1).orderBy("term").collect()
    for p, q in zip(a, b):
        assert p.coefficient == pytest.approx(q.coefficient, abs=1e-6) and p.probability == pytest.approx(q.probability, abs=1e-6) and p.confidence_interval == pytest.approx(q.confidence_interval, abs=1e-6)
    m = doe.fit_model(df.withColumn("z", F.col("x") * F.col("x")), 2, ["x", "z"], "y", [True, True, False, False, False])
    assert math.isnan(m.coefficients[2]) and doe.evaluate(df.withColumn("z", F.lit(0.0)), m).filter("isnan(modelled)").count() == 0


def test_bootstrap(spark):
    df = frame(spark, [(i, float(v)) for i, v in enumerate(G["boot"])], "i int, v double")
    for method in ("random", "replacement"):
        r = sampling.bootstrap(df, "v", "mean", ["i"], 1000, method).first()
        assert (r.lower, r.upper, r.standard_error) == (pytest.approx(0.583, abs=5e-2), pytest.approx(0.746, abs=5e-2), pytest.approx(0.042, abs=5e-2))
    r = sampling.bootstrap(df, "v", lambda a: float(np.ptp(a)), ["i"], 30, "replacement").first()
    assert r.statistic == pytest.approx(np.ptp(G["boot"]))
    a = sampling.resample(df, "v", ["i"], 3).collect()
    b = sampling.resample(df.repartition(7), "v", ["i"], 3).collect()
    assert sorted(a) == sorted(b)


def test_sampling(spark):
    v = np.array([r.value for r in sampling.box_muller_sample(spark, 5.0, 2.0, 20_000).collect()])
    assert v.mean() == pytest.approx(5, abs=0.06) and v.std() == pytest.approx(2, abs=0.05)
    assert sampling.box_muller_sample(spark, 0.0, 1.0, 0).count() == 0
    v = np.array([r.value for r in sampling.rejection_sample(spark, D.NormalDistribution(), 5000, -4, 4).collect()])
    assert len(v) == 5000 and v.mean() == pytest.approx(0, abs=0.06) and v.std() == pytest.approx(1, abs=0.05)
    m = D.MultivariateNormalDistribution().initialize([1, 2], [[2, 0.6], [0.6, 1]])
    s = sampling.sample_normal_multivariate(spark, m, 20_000).select("x0", "x1").toPandas()
    assert s.cov().to_numpy() == pytest.approx(np.array([[2, 0.6], [0.6, 1]]), abs=0.08)


def test_allan(spark):
    v = np.random.default_rng(3).random(100)
    df = frame(spark, [(i, float(x)) for i, x in enumerate(v)], "i int, v double").repartition(4)
    got = {r.m: r for r in series.allan_variance(df, "v", ["i"], 0.000973).collect()}
    some = {r.m: r.allan_variance for r in series.allan_variance(df, "v", ["i"], 1.0, factors=[1, 7, 30]).collect()}
    assert sorted(got) == list(range(1, 50))
    for m, r in got.items():
        means = np.array([v[j : j + m].mean() for j in range(100 - m + 1)])
        d = means[m:] - means[:-m]
        want = (d[: 100 - 2 * m + 1] ** 2).sum() / (2 * (100 - 2 * m + 1))
        assert r.allan_variance == pytest.approx(want) and r.tau == pytest.approx(m * 0.000973)
        assert m not in some or some[m] == pytest.approx(want)


def test_difference(spark):
    df = frame(spark, [(1, 5.0), (2, 7.0), (3, 4.0)], "i int, v double")
    assert [r.difference for r in series.difference(df, "v", ["i"]).orderBy("i").collect()] == [2.0, -3.0]


def test_lowess_plain_is_a_local_line():
    """Without robust passes each value is the tricube-weighted line of its nearest points."""
    rng = np.random.default_rng(4)
    x = np.sort(rng.random(60))
    y = np.sin(6 * x) + rng.normal(0, 0.1, 60)
    fit, w, rest = series.lowess_arrays(x, y, 0.3, 0)
    near = int(0.3 * 60)
    for i in range(60):
        d = np.abs(x - x[i])
        h = np.sort(d)[near - 1]
        k = np.where(d <= 0.999 * h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0)
        a = np.polyfit(x, y, 1, w=np.sqrt(k))
        assert fit[i] == pytest.approx(np.polyval(a, x[i]), abs=1e-6)
    assert rest == pytest.approx(y - fit)


def test_lowess_resists_outliers(spark):
    x = np.linspace(0, 1, 50)
    y = 2 * x + np.random.default_rng(6).normal(0, 0.01, 50)
    y[25] += 10
    df = frame(spark, list(zip(map(float, x), map(float, y))), "x double, y double")
    s = series.lowess(df, "x", "y", 0.4, 3).orderBy("x").toPandas()
    assert s.smoothed.to_numpy() == pytest.approx(2 * x, abs=0.05)
    one = series.lowess_arrays(np.array([1.0]), np.array([2.0]))
    assert one[0].tolist() == [2.0]


def test_interpolation(spark):
    x, y = np.array([-1.5, 0, 1.5, 3]), np.array([0.3, 1.1, -0.4, 2.0])
    knots = frame(spark, list(zip(map(float, x), map(float, y))), "x double, y double")
    at = frame(spark, [(-0.2,), (2.75,), (-2.0,), (4.0,), (None,)], "z double")
    got = {r.z: r.interpolated for r in interp.linear(knots, at, "x", "y", "z").collect()}
    for z, (i, j) in {-0.2: (0, 1), 2.75: (2, 3), -2.0: (0, 1), 4.0: (2, 3)}.items():
        assert got[z] == pytest.approx(y[i] + (z - x[i]) / (x[j] - x[i]) * (y[j] - y[i]))
    assert got[None] is None
    got = {r.z: r.interpolated for r in interp.polynomial(knots, at, "x", "y", "z", 2).collect()}
    for z, i in {-0.2: 0, 2.75: 1, -2.0: 0, 4.0: 1}.items():
        assert got[z] == pytest.approx(np.polyval(np.polyfit(x[i : i + 3], y[i : i + 3], 2), z))
    cubic = interp.polynomial(knots, at, "x", "y", "z", 3).filter("z = 4").first().interpolated
    assert cubic == pytest.approx(np.polyval(np.polyfit(x, y, 3), 4.0))


def test_spline_and_hermite(spark):
    x = np.array([-2.0, -1.2, 0.1, 1.0, 2.0])
    f, df_, d2 = (lambda z: z**3 - z), (lambda z: 3 * z**2 - 1), (lambda z: 6 * z)
    knots = frame(spark, [(float(a), float(f(a))) for a in x], "x double, y double")
    at = frame(spark, [(float(z),) for z in (-1.9, -0.5, 0.7, 1.5)], "z double")
    for kind, a, b in ((interp.SPLINE_KNOWN_FIRST_DERIVATIVE, df_(-2.0), df_(2.0)), (interp.SPLINE_KNOWN_SECOND_DERIVATIVE, d2(-2.0), d2(2.0)), (interp.SPLINE_CONTINUOUS_THIRD_DERIVATIVE, 0.0, 0.0)):
        for r in interp.spline(knots, at, "x", "y", "z", kind, a, kind, b).collect():
            assert r.interpolated == pytest.approx(f(r.z), abs=1e-9)
    for r in interp.hermite(at, "z", x, np.tanh(x), 1 / np.cosh(x) ** 2).collect():
        assert r.interpolated == pytest.approx(np.tanh(r.z), abs=0.05)
    for r in interp.hermite(at, "z", x, f(x), df_(x)).collect():
        assert r.interpolated == pytest.approx(f(r.z)) and r.derivative == pytest.approx(df_(r.z))
    with pytest.raises(NonMonotonicError):
        interp.check_knots(np.array([0.0, 2.0, 1.0]), np.zeros(3))


def test_mcmc(spark):
    rng = np.random.default_rng(5)
    x = np.linspace(0, 2, 40)
    y = 1.5 * x + 0.5 + rng.normal(0, 0.1, 40)
    t = mcmc.Target(lambda x, p: p[0] * x + p[1], [D.NormalDistribution(1.0, 1.2), D.NormalDistribution(1.0, 0.8)])
    s = mcmc.summary(mcmc.burn_in(mcmc.sample(spark, x, y, t, 3, 4000, mcmc.Proposal(scale=0.05)), 0.4)).collect()
    slope, cut = np.polyfit(x, y, 1)
    for r in s:
        assert r["mean"] == pytest.approx(slope if r.parameter == 0 else cut, abs=0.05) and 0.02 < r.acceptance_rate < 0.95
    again = mcmc.run_chain(x, y, t, mcmc.Proposal(), 50, np.random.default_rng([0, 1]))[0].get_chain()
    assert (again == mcmc.run_chain(x, y, t, mcmc.Proposal(), 50, np.random.default_rng([0, 1]))[0].get_chain()).all()
    want = math.exp(sum(math.log(D.NormalDistribution(0.1).pdf(float(b - a))) for a, b in zip(_line(x, [1.5, 0.5]), y)))
    assert t.likelihood(x, y, [1.5, 0.5], 0.01) == pytest.approx(want, rel=1e-9)
    c = mcmc.ChainBuilder(2)
    for i in range(10):
        c.push_new_state([i, -i])
    assert c.get_chain_length() == 10 and len(c.get_chain(0.35)) == 7 and c.get_chain(0.0)[0].tolist() == [0, 0]
    with pytest.raises(ArraySizeError):
        c.push_new_state([1])


def _line(x, p):
    return p[0] * x + p[1]


def test_variance_prior_stays_in_its_range():
    """Draws are those of the log-normal inside the range: none piles up at a bound; variance 0 counts as 1."""
    target = mcmc.Target(lambda x, p: p[0] * x, [D.NormalDistribution(1.0, 0.0)], 0.5)
    v = target.sample_variance_prior(1.0, 4000, np.random.default_rng(1))
    assert v.min() > 6e-6 * 0.5 and v.max() < 3 and (v == v.max()).sum() == 1
    assert np.median(v) == pytest.approx(0.99, abs=0.05)
    x = np.array([1.0, 2.0])
    assert target.log_likelihood(x, 2 * x, [1.0], 0) == pytest.approx(target.log_likelihood(x, 2 * x, [1.0], 1.0))


def test_two_factor_unequal_cells(spark):
    """Brute force by unweighted means, over all rows; a missing cell is an error."""
    rng = np.random.default_rng(5)
    rows = [(f"r{i}", f"c{j}", float(i * 2 + j + i * j + rng.standard_normal())) for i in range(2) for j in range(3) for _ in range(2 + 3 * i + j)]
    df = spark.createDataFrame(rows, "f1 string, f2 string, v double")
    got = {x.source: x for x in anova.two_factor(df, "v", "f1", "f2", check=False).collect()}
    cell = {(a, b): np.array([v for x, y, v in rows if (x, y) == (a, b)]) for a in ("r0", "r1") for b in ("c0", "c1", "c2")}
    m = np.array([[cell[a, b].mean() for b in ("c0", "c1", "c2")] for a in ("r0", "r1")])
    h = 6 / sum(1 / len(x) for x in cell.values())
    r, c = m.mean(axis=1, keepdims=True), m.mean(axis=0, keepdims=True)
    v = np.array([x[2] for x in rows])
    want = {"main": h * 3 * ((r - m.mean()) ** 2).sum(), "main2": h * 2 * ((c - m.mean()) ** 2).sum(), "interaction": h * ((m - r - c + m.mean()) ** 2).sum(), "within": sum(((x - x.mean()) ** 2).sum() for x in cell.values()), "total": ((v - v.mean()) ** 2).sum()}
    for k, ss in want.items():
        assert got[k].sum_of_squares == pytest.approx(ss, rel=1e-9)
    assert [got[k].dof for k in want] == [1, 2, 2, len(rows) - 6, len(rows) - 1]
    with pytest.raises(Exception, match="not balanced"):
        anova.two_factor(df, "v", "f1", "f2").collect()
    with pytest.raises(Exception, match="no values"):
        anova.two_factor(df.filter("f1 = 'r0' or f2 <> 'c2'"), "v", "f1", "f2", check=False).collect()


def test_likelihood_of_condensed_rows(spark):
    """The sums per x give the likelihood of every row."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 5, 200).astype(float)
    y = 2 * x + 1 + rng.standard_normal(200)
    rows = mcmc.condense(spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (1.0, None)], "x double, y double"), "x", "y").collect()
    cx, cy, n, ss = (np.array([r[c] for r in rows], float) for c in ("x", "y", "n", "ss"))
    t = mcmc.Target(lambda x, p: p[0] * x + p[1], [D.NormalDistribution(2.0, 0.0), D.NormalDistribution(1.0, 0.0)])
    for p, v in (((2.0, 1.0), 1.0), ((1.5, 0.2), 3.0)):
        assert t.log_likelihood(cx, cy, np.array(p), v, n, ss) == pytest.approx(t.log_likelihood(x, y, np.array(p), v), rel=1e-12)
    seen = []
    chain, moves = mcmc.run_chain(cx, cy, t, mcmc.Proposal(), 30, np.random.default_rng(1), lambda *a: seen.append(1), lambda *a: seen.append(0), n, ss)
    assert len(seen) == 29 and sum(seen) == moves.sum()
    with pytest.raises(Exception):
        t.log_likelihood(cx, cy, np.array([1.0, 1.0]), 1.0, n[1:], ss)


def test_spline_ends_by_definition():
    """The second derivatives fulfil the rows of the system: continuity inside, the conditions at both ends; for all ends, few knots and many."""
    rng = np.random.default_rng(7)
    for n in (5, 6, 40, 20_000):
        x = np.cumsum(rng.uniform(0.5, 2, n)) if n != 6 else np.arange(6.0)
        y = rng.standard_normal(n)
        h, slope = np.diff(x), np.diff(y) / np.diff(x)
        for begin in (1000, 1001, 1002, 1003):
            for end in (1000, 1001, 1002, 1003):
                m = interp.spline_second_derivatives(x, y, begin, 0.7, end, -0.4)
                assert np.allclose(h[:-1] * m[:-2] / 6 + (h[:-1] + h[1:]) * m[1:-1] / 3 + h[1:] * m[2:] / 6, np.diff(slope), atol=1e-9)
                first, last = slope[0] - h[0] * (2 * m[0] + m[1]) / 6, slope[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6
                third = np.diff(m) / h
                want = {1000: (m[0] - m[1], m[-1] - m[-2]), 1001: (first - 0.7, last + 0.4), 1002: (m[0] - 0.7, m[-1] + 0.4), 1003: (third[0] - third[1], third[-1] - third[-2])}
                assert abs(want[begin][0]) < 1e-8 and abs(want[end][1]) < 1e-8


@pytest.mark.parametrize("method", [interp.linear, interp.polynomial])
def test_equal_knots_are_an_error(spark, method):
    knots = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (2.0, 5.0), (None, 9.0)], "x double, y double")
    values = spark.createDataFrame([(0.5,), (2.0,)], "at double")
    want = {interp.linear: 1.5, interp.polynomial: 1.25}[method]
    assert {r.at: r.interpolated for r in method(knots, values, "x", "y", "at").collect()} == {0.5: want, 2.0: 5.0}
    with pytest.raises(Exception, match="strictly monotonic"):
        method(knots.unionByName(knots.filter("x = 1")), values, "x", "y", "at").collect()
