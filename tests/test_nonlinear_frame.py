"""Fits whose steps are aggregates against the in-memory fit."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.errors import ArraySizeError, InvalidArgumentError, InvalidInputError, TooFewIterationsError, UnderdefinedProblemError
from statloom.operators import nonlinear as N

G = json.loads((Path(__file__).parent / "fixtures" / "goldens.json").read_text())["nlls"]
TIGHT = N.IterationControls(residual_tolerance=1e-14, gradient_tolerance=1e-9, change_in_solution_tolerance=1e-9)


def cubic(x, p):
    return p[0] * x[0] * x[0] * x[0] + p[1] * x[0] * x[0] + p[2] * x[0] + p[3]


@pytest.mark.parametrize("method", [N.LEVENBERG_MARQUARDT_UPDATE, N.QUADRATIC_UPDATE, N.NIELSEN_UPDATE])
def test_equals_the_fit_in_memory(spark, method):
    x, y = np.array(G["x"]), np.array(G["y"])
    options = N.SolverOptions(method=method)
    # the second method nears the optimum slowly, in memory too
    tight, near = (N.IterationControls(residual_tolerance=1e-14, gradient_tolerance=1e-8, change_in_solution_tolerance=1e-6), 2e-7) if method == 2 else (TIGHT, 2e-8)
    want = N.fit(lambda x, p: p[0] * x**3 + p[1] * x**2 + p[2] * x + p[3], x, y, [1, 1, 1, 1], controls=tight, options=options)
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double").repartition(3)
    got = N.distributed_least_squares(df, cubic, "x", "y", [1, 1, 1, 1], controls=tight, options=options).orderBy("parameter").collect()
    assert [r.estimate for r in got] == pytest.approx(want.params.tolist(), rel=near, abs=near)
    assert np.array([r.covariance for r in got]) == pytest.approx(want.covariance, rel=1e-6)
    assert got[0].chi_squared == pytest.approx(want.chi_squared, rel=1e-10)
    for r, s in zip(got, N.statistics(want), strict=True):
        assert (r.standard_error, r.t_statistic, r.probability, r.confidence_interval) == pytest.approx(tuple(s.values()), rel=1e-6)
    assert got[0].n == len(x) and got[0].info.iteration_count > 2 and (got[0].info.converge_on_solution_change or got[0].info.converge_on_gradient)


def decay(x, p):
    return p[0] * F.exp(-p[1] * x[0]) + p[2] * x[1]


def rows(spark):
    d = np.random.default_rng(2)
    out = []
    for g, a, b in (("a", 2.0, 0.5), ("b", 1.0, 2.0), (None, 3.0, 0.1)):
        x, z = d.uniform(0, 4, 200), d.normal(size=200)
        y = a * np.exp(-b * x) + 0.3 * z + d.normal(size=200) * 0.05
        out += [(g, float(u), float(v), float(t), float(s)) for u, v, t, s in zip(x, z, y, d.uniform(0.5, 2, 200), strict=True)]
    return out, spark.createDataFrame(out + [("a", None, 1.0, 1.0, 1.0), ("b", 1.0, 1.0, None, 1.0)], "g string, x double, z double, y double, w double")


def test_groups_weights_bounds(spark):
    data, df = rows(spark)
    how = {"lower": [0, 0, -1], "upper": [2.5, 5, 1]}
    got = N.distributed_least_squares(df, decay, ["x", "z"], "y", [1.0, 1.0, 0.0], weight="w", by=["g"], controls=TIGHT, **how)
    fit = {(r.g, r.parameter): r for r in got.collect()}
    assert len(fit) == 9
    for g in ("a", "b", None):
        x, z, y, w = (np.array([r[i] for r in data if r[0] == g]) for i in (1, 2, 3, 4))
        t = np.stack([x, z], axis=1)
        if g is None:  # one parameter ends at its bound: the others are as if it were fixed there
            assert fit[g, 0].estimate == 2.5
            want = N.fit(lambda t, p: 2.5 * np.exp(-p[0] * t[:, 0]) + p[1] * t[:, 1], t, y, [0.5, 0.0], w, controls=TIGHT).params.tolist()
            assert [fit[g, i].estimate for i in (1, 2)] == pytest.approx(want, rel=1e-6)
        else:
            want = N.fit(lambda t, p: p[0] * np.exp(-p[1] * t[:, 0]) + p[2] * t[:, 1], t, y, [1.0, 1.0, 0.0], w, controls=TIGHT, **how).params.tolist()
            assert [fit[g, i].estimate for i in range(3)] == pytest.approx(want, rel=1e-6)
        assert fit[g, 0].info.iteration_count < 60
    back = N.predict(df, got, decay, ["x", "z"], "y", ["g"]).filter("x is not null and y is not null").collect()
    assert len(back) == 600
    for r in back[:20]:
        p = [fit[r.g, i].estimate for i in range(3)]
        assert r.modelled == pytest.approx(p[0] * np.exp(-p[1] * r.x) + p[2] * r.z)
        assert r.residual == pytest.approx(r.y - r.modelled)


def test_only_aggregates_reach_the_driver(spark, monkeypatch):
    """Each pass has one row per group that still moves; groups that are done are not asked again."""
    passes, plain = [], N._pass
    monkeypatch.setattr(N, "_pass", lambda rows, model, by, asked, k: passes.append(set(asked)) or plain(rows, model, by, asked, k))
    _, df = rows(spark)
    start = {("a",): [2.0, 0.5, 0.3], ("b",): [2.0, 1.0, 1.0], (None,): [3.0, 0.1, 0.3]}
    seen = []
    N.distributed_least_squares(df, decay, ["x", "z"], "y", start, by=["g"], update=lambda k, i, p: seen.append((k, i)) or (k == ("a",) and i == 1))
    assert len(passes[0]) == 3 and ("a",) not in passes[-1]
    assert all(later <= sooner for sooner, later in zip(passes, passes[1:]))
    assert (("a",), 1) in seen and (("a",), 2) not in seen


def test_stops_and_errors(spark, monkeypatch):
    _, df = rows(spark)
    one = df.filter("g = 'a'")
    r = N.distributed_least_squares(one, decay, ["x", "z"], "y", [1.0, 2.0, 0.0], controls=N.IterationControls(max_iteration_count=2)).first()
    assert r.info.reach_iteration_limit and not r.info.converge_on_gradient
    r = N.distributed_least_squares(one, decay, ["x", "z"], "y", [1.0, 2.0, 0.0], controls=N.IterationControls(max_function_evaluations=10)).first()
    assert r.info.reach_function_evaluation_limit
    with pytest.raises(UnderdefinedProblemError):
        N.distributed_least_squares(one.limit(2), decay, ["x", "z"], "y", [1.0, 1.0, 1.0])
    with pytest.raises(UnderdefinedProblemError):
        N.distributed_least_squares(one.limit(0), decay, ["x", "z"], "y", [1.0, 1.0, 1.0])
    with pytest.raises(ArraySizeError):
        N.distributed_least_squares(one, decay, ["x", "z"], "y", [1.0, 1.0, 1.0], lower=[0.0])
    with pytest.raises(InvalidInputError):
        N.distributed_least_squares(one, decay, ["x", "z"], "y", [1.0, 1.0, 1.0], options=N.SolverOptions(method=7))
    with pytest.raises(TooFewIterationsError):
        N.distributed_least_squares(one, decay, ["x", "z"], "y", [1.0, 1.0, 1.0], controls=N.IterationControls(max_iteration_count=1))
    monkeypatch.setattr(N, "MOST_GROUPS", 2)
    with pytest.raises(InvalidArgumentError):
        N.distributed_least_squares(df, decay, ["x", "z"], "y", [1.0, 1.0, 1.0], by=["g"])
    assert N.distributed_least_squares(df.limit(0), decay, ["x", "z"], "y", [1.0, 1.0, 1.0], by=["g"]).count() == 0


def test_large_groups_are_not_in_one_task(spark):
    """Groups above the limit are fitted by sums of all tasks, and as they are in memory; a null key is a group."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0.5, 4, 6000)
    keys = ["a" if i % 2 else None if i % 10 else "few" for i in range(6000)]
    y = 3 * np.exp(-0.7 * x) + rng.normal(0, 0.01, 6000)
    df = spark.createDataFrame(list(zip(keys, map(float, x), map(float, y), strict=True)) + [("a", None, 1.0)], "g string, x double, y double").repartition(5)
    model = lambda x, p: p[0] * np.exp(p[1] * x)
    controls = N.IterationControls(residual_tolerance=1e-12, change_in_solution_tolerance=1e-9)
    how = dict(by=["g"], controls=controls)
    want = {(r.g, r.parameter): r for r in N.nonlinear_least_squares(df, model, "x", "y", [1.0, -0.1], **how).collect()}
    fits = N.nonlinear_least_squares(df, model, "x", "y", [1.0, -0.1], group_rows=1000, **how)
    got = {(r.g, r.parameter): r for r in fits.collect()}
    assert set(got) == set(want) and len(got) == 6
    for k, r in got.items():
        assert r.converged and r.estimate == pytest.approx(want[k].estimate, rel=1e-6) and r.standard_error == pytest.approx(want[k].standard_error, rel=1e-4)
    assert N.nonlinear_least_squares(df, model, "x", "y", [1.0, -0.1], controls=controls, group_rows=1000).count() == 2
