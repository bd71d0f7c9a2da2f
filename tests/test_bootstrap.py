"""Resampling by weights against exact enumeration, and the caller's own resampling."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.errors import InvalidArgumentError
from statloom.operators import sampling as S


def test_draws_of_blocks_add_up():
    for n, size in ((1, 4), (17, 4), (1000, 64), (64, 64)):
        blocks = -(-n // size)
        for b in range(5):
            assert sum(S.block_draws(n, k, size, 3, b) for k in range(blocks)) == n
    many = np.array([[S.block_draws(40, k, 16, 9, b) for k in range(3)] for b in range(4000)])
    share = np.array([16, 16, 8]) / 40
    assert many.mean(axis=0) == pytest.approx(40 * share, abs=0.2)
    assert many.var(axis=0) == pytest.approx(40 * share * (1 - share), rel=0.08)


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_distribution_is_that_of_all_resamples(spark, block):
    """All 5^5 resamples of five values: the shares of their means and variances."""
    x = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = spark.createDataFrame(list(enumerate(x)) + [(9, None)], "i int, v double")
    n = 20_000
    for name, f in (("mean", np.mean), ("variance", lambda z: np.var(z, ddof=1)), ("sum", np.sum)):
        got = Counter(round(r.statistic, 6) for r in S.multinomial_population(df, "v", name, ["i"], n, block=block).collect())
        want = Counter(round(float(f(z)), 6) for z in itertools.product(x, repeat=5))
        assert set(got) <= set(want)
        for v, k in want.most_common(12):
            p = k / 5**5
            assert abs(got[v] / n - p) < 5 * np.sqrt(p * (1 - p) / n)


def test_partitioning_changes_nothing(spark):
    d = np.random.default_rng(8)
    df = spark.createDataFrame([(i, "a" if i % 3 else None, float(v)) for i, v in enumerate(d.normal(size=3000))], "i int, g string, v double")
    how = dict(statistic="standard_deviation", order=["i"], samples=50, by=["g"], seed=4, block=256)
    one, two = ({(r.g, r.b): r.statistic for r in S.multinomial_population(df.repartition(k), "v", piece_rows=rows, **how).collect()} for k, rows in ((1, 1 << 20), (7, 300)))
    assert len(one) == 100 and one == pytest.approx(two, rel=1e-12)


def test_summary(spark):
    d = np.random.default_rng(2)
    x = d.exponential(size=4000) + 1e6
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    r = S.bootstrap(df, "v", "mean", ["i"], 2000, "multinomial").first()
    assert r.statistic == pytest.approx(x.mean(), rel=1e-14) and abs(r.bias) < 0.003
    assert r.standard_error == pytest.approx(x.std() / np.sqrt(4000), rel=0.06)
    assert r.lower < r.statistic < r.upper
    with pytest.raises(InvalidArgumentError):
        S.multinomial_population(df, "v", "median", ["i"], 5)
    with pytest.raises(InvalidArgumentError):
        S.bootstrap(df, "v", "mean", ["i"], 5, "other")
    assert S.bootstrap(df.limit(0).selectExpr("i", "v", "i AS g"), "v", "mean", ["i"], 5, "multinomial", by=["g"]).count() == 0


def test_own_resampling(spark):
    """A block bootstrap of the caller: resamples keep neighbours together."""
    df = spark.createDataFrame([(g, i, float(i)) for g in ("a", None) for i in range(40)], "g string, i int, v double")

    def blocks(x, rng):
        at = rng.integers(0, len(x) - 4, len(x) // 5)
        return np.concatenate([x[a : a + 5] for a in at])

    def breaks(z):
        return float((np.diff(z) != 1).sum())

    got = S.bootstrap_population(df, "v", breaks, ["i"], 150, blocks, ["g"], 3).collect()
    assert len(got) == 300 and {r.statistic for r in got if r.b == 1} == {0.0}
    assert all(r.statistic <= 7 for r in got)
    again = {(r.g, r.b): r.statistic for r in S.bootstrap_population(df.repartition(5), "v", breaks, ["i"], 150, blocks, ["g"], 3).collect()}
    assert again == {(r.g, r.b): r.statistic for r in got}
    assert S.bootstrap(df, "v", "median", ["i"], 60, blocks, by=["g"]).count() == 2


def test_draws_are_not_broadcast(spark):
    """The planner takes the rows of an explode for as few as those before it: the draws went to the driver to be broadcast."""
    df = spark.range(3000).selectExpr("id", "id % 3 AS g", "cast(id AS double) AS v")
    got = S.resample(df, "v", ["id"], 40, ["g"], 1)
    plan = got._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    assert got.count() == 120_000 and got.select("g", "b", "i").distinct().count() == 120_000
    assert S.resample(df, "v", ["id"], 0, ["g"], 1).count() == 0


def test_draws_are_dealt_over_the_tasks(spark):
    """All draws of a group, or of all groups, used to be made by one task."""
    df = spark.range(50_000).selectExpr("id", "cast(id AS double) AS v")
    for got in (S.random_resample(df, "v", 8), S._draws(df.groupBy().count().withColumnRenamed("count", "n"), 1, 8)):
        held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == 400_000 and len(held) == 4 and max(held) < 200_000
        assert got.select("b", "i").distinct().count() == 400_000


def test_a_block_splits_its_draws_once(monkeypatch):
    """Each block used to walk down the tree anew for each resample: generators went with resamples times levels."""
    made = []
    real = S._generator
    monkeypatch.setattr(S, "_generator", lambda *key: made.append(key) or real(*key))
    rows = np.random.default_rng(1).normal(size=64)
    part = S.pd.DataFrame({"v": rows, "c": rows.mean(), "n": 64 * 1000, "block": 17})
    got = S._weighted(part, 2, 1500, 5, 64)
    assert got[:, 0].tolist() == list(range(2, 1501)) and len(made) <= 1499 + 2 * 10
    assert got[:, 1].mean() == pytest.approx(64, abs=1.5) and [S.block_draws(64_000, 17, 64, 5, b) for b in (2, 1023, 1024, 1500)] == [got[b - 2, 1] for b in (2, 1023, 1024, 1500)]
