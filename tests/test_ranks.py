"""Order statistics by closing in on ranks, against sorted arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import descriptive as O

QS = [0.0, 0.001, 0.1, 0.5, 0.77, 0.999, 1.0]


def type6(x, q):
    x, n = np.sort(x), len(x)
    at = (n + 1) * q
    lo = int(max(1, min(np.floor(at), n)))
    return x[lo - 1] + min(1, max(0, at - lo)) * (x[min(lo + 1, n) - 1] - x[lo - 1])


def trimmed(x, p):
    x, n = np.sort(x), len(x)
    i = max(int(n * p), 1)
    return x[i - 1 : n - i + 1].mean()


def frame(spark):
    """Groups with heavy tails, few different values, one value, few rows, a null name; nulls among the values."""
    d = np.random.default_rng(4)
    groups = {"tails": np.exp(d.normal(size=20_000) * 30) * d.choice([-1, 1], 20_000), "ties": d.integers(0, 5, 8000).astype(float), "one": np.full(3000, 7.0), "few": np.array([3.0, 1.0]), None: d.normal(size=5000), "single": np.array([2.5])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("one", None), ("none", None)]
    d.shuffle(rows)
    return groups, spark.createDataFrame([(g, None if v in (None, "None") else float(v)) for g, v in rows], "g string, v double").repartition(6)


@pytest.mark.parametrize(("small", "inside"), [(1 << 20, 1 << 16), (100, 1 << 16), (100, 20)])
def test_quantiles_and_trimmed_means(spark, small, inside):
    groups, df = frame(spark)
    got = {(r.g, r.q): r.quantile for r in O.quantiles(df, "v", QS, ["g"], small, inside).collect()}
    assert set(got) == {(g, q) for g in groups for q in QS}
    for (g, q), v in got.items():
        assert v == pytest.approx(type6(groups[g], q), rel=1e-12), (g, q)
    for p in (0.05, 0.3, 0.5):
        got = {r.g: r.trimmed_mean for r in O.trimmed_mean(df, "v", p, ["g"], small, inside).collect()}
        for g, x in groups.items():
            if 2 * max(int(len(x) * p), 1) <= len(x) + 1:
                assert got[g] == pytest.approx(trimmed(x, p), rel=1e-9), (g, p)


def test_without_groups_and_empty(spark):
    groups, df = frame(spark)
    every = np.concatenate(list(groups.values()))
    for small in (1 << 20, 100):
        got = {r.q: r.quantile for r in O.quantiles(df, "v", QS, (), small, 50).collect()}
        assert got == pytest.approx({q: type6(every, q) for q in QS}, rel=1e-12)
    assert O.quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_nothing_is_shuffled_by_value(spark):
    """The passes shuffle aggregates per group; only what is left inside a bracket is grouped by value."""
    _, df = frame(spark)
    plan = O.order_values(df, "v", lambda n: {"a": F.ceil(n / 2).cast("long")}, ["g"], 100, 200)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 3


def test_data_are_not_moved_to_their_group(spark):
    """Means, coefficients and the like come to the rows: with broadcasts by size switched off no plan shuffles rows of the data."""
    from statloom.operators import hypothesis, regression

    df = spark.range(5000).selectExpr("cast(id % 3 as string) AS g", "id % 50 + 0.0D AS x", "3 * (id % 50) + id % 7 + 0.0D AS y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fit = regression.linear_least_squares(df, "x", "y", 1, by=["g"])
        p = regression.predict(df, fit, "x", "y", ["g"])
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        for other in (fit, hypothesis.levene(df, "y", "g")):
            assert "SortMergeJoin" not in other._jdf.queryExecution().executedPlan().toString()
        assert p.count() == 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
