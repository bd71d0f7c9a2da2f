"""The ordered scan against plain windows: the same columns whatever the pieces."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.operators.scan import ordered_scan


def series(spark, rows=5000):
    """One series of four fifths of all rows, short ones, one without a name, ties in time, nulls in the value."""
    d = spark.range(rows, numPartitions=5).select((F.col("id") * 7919 % rows).alias("i"))
    g = F.when(F.col("i") % 5 > 0, "long").when(F.col("i") % 3 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("i") % 40).cast("string")))
    return d.select(g.alias("g"), F.floor(F.col("i") / 3).alias("t"), "i", F.when(F.col("i") % 11 > 3, F.sin("i")).alias("v"))


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("piece_rows", [64, 1000, 1 << 20])
def test_against_windows(spark, by, piece_rows):
    df, v = series(spark), F.col("v")
    got = ordered_scan(df, ["t", "i"], by, rank="place", size="n", running={"s": v, "k": F.lit(1)}, latest={"seen": v}, before={"was": v, "id": F.col("i")}, after={"next": v, "more": F.lit(1)}, piece_rows=piece_rows)
    w = Window.partitionBy(*by)
    o = w.orderBy("t", "i")
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.round(F.sum(v).over(upto), 8).alias("s"), F.sum(F.lit(1)).over(upto).alias("k"), F.last(v, True).over(upto).alias("seen"), F.lag(v).over(o).alias("was"), F.lag("i").over(o).alias("id"), F.lead(v).over(o).alias("next"), F.lead(F.lit(1)).over(o).alias("more"), F.row_number().over(o).cast("long").alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    got = got.withColumn("s", F.round("s", 8))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_window_above_the_piece(spark):
    """Every row has its piece's number of rows as a stand-in for the task that scans it."""
    from statloom.operators import scan

    seen = []
    plain, scan.written = scan.written, lambda df: seen.append(plain(df)) or seen[-1]
    try:
        ordered_scan(series(spark, 40_000), ["t", "i"], ["g"], rank="r", piece_rows=4000).count()
    finally:
        scan.written = plain
    most = seen[0].groupBy("__piece", "g").count().agg(F.max("count")).first()[0]
    assert most <= 4000


def test_empty_and_ties(spark):
    df = series(spark).limit(0)
    assert ordered_scan(df, ["t"], ["g"], rank="r").count() == 0
    same = spark.range(900).select(F.lit(1).alias("t"), (F.col("id") % 2).alias("v"))
    got = ordered_scan(same, ["t"], rank="r", size="n", running={"s": F.col("v")}, piece_rows=100)
    assert sorted(r.r for r in got.collect()) == list(range(1, 901))
    assert got.agg(F.max("s")).first()[0] == 450


def walk(spark, n=600):
    """Two groups of values and a null one; the last value of each has no place."""
    rows = spark.range(n * 3).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"), F.floor(F.col("id") / 3).alias("i"))
    return rows.select("g", "i", F.round(F.sin("i") * 3, 6).alias("v"))


def test_series_in_pieces(spark):
    from statloom.operators import sampling, series as S

    df = walk(spark)
    for pieced, plain in ((f(df, p) for p in (50, 1 << 20)) for f in (lambda d, p: S.difference(d, "v", ["i"], ["g"], p), lambda d, p: S.allan_variance(d, "v", ["i"], 1.0, ["g"], [1, 3, 40], p), lambda d, p: sampling._ranked(d, "v", ["i"], ["g"], p))):
        cut = lambda t: sorted(repr([round(x, 8) if isinstance(x, float) else x for x in r]) for r in t.collect())
        assert cut(pieced) == cut(plain)


@pytest.mark.parametrize("method", ["linear", "polynomial", "spline"])
def test_interpolation_ways_agree(spark, method):
    """Few segments searched where the values are, many scanned with the values in one piece or in many: one result, also outside the knots, for nulls and for groups without knots."""
    from statloom.operators import interp

    knots = walk(spark).filter("i % 5 = 0 and g is not null").select("g", (F.col("i") + F.col("i") * F.col("i") / 1000).alias("x"), "v")
    knots = knots.unionByName(knots.filter("g = 'a'").withColumn("g", F.lit(None).cast("string")))
    at = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").when(F.col("id") % 4 == 2, "none").alias("g"), F.when(F.col("id") % 50 > 0, F.col("id") / 3 - 100).alias("z"))
    f = getattr(interp, method)
    few, one, many = ({r.id: r.interpolated for r in f(knots, at, "x", "v", "z", by=["g"], **how).collect()} for how in ({}, {"few": 0}, {"few": 0, "piece_rows": 100}))
    assert few == one == many
    assert len(few) == 4000
    assert all((few[i] is None) == (i % 50 == 0 or i % 4 == 2) for i in few)


@pytest.mark.parametrize("block", [4, 7, 64, 2048])
def test_all_allan_factors_in_tiles(spark, block):
    """Tiles of any size against the definition; series of four values and fewer; a series without a name."""
    import numpy as np

    from statloom.operators import series as S

    d = np.random.default_rng(1)
    data = {"a": d.normal(size=61), None: d.normal(size=40) + 100, "four": d.normal(size=4), "three": d.normal(size=3)}
    df = spark.createDataFrame([(g, i, float(v)) for g, x in data.items() for i, v in enumerate(x)], "g string, i int, v double")
    got = {(r.g, r.m): (r.tau, r.allan_variance) for r in S.allan_variance(df, "v", ["i"], 0.5, ["g"], block=block).collect()}
    want = {}
    for g, x in data.items():
        n = len(x)
        for m in range(1, n // 2):
            mean = [x[j : j + m].mean() for j in range(n - m + 1)]
            want[g, m] = (m * 0.5, sum((mean[j + m] - mean[j]) ** 2 for j in range(n - 2 * m + 1)) / (2 * (n - 2 * m + 1)))
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)
