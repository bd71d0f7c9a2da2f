"""Analysis of variance as rows (source, dof, sum_of_squares, variance, f_statistic, probability)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError
from ..functions import kernel as K


def _rows(s: DataFrame, by: Sequence[str], parts: Sequence[tuple[str, str, str]], error: str) -> DataFrame:
    """Long rows from columns: (source, dof column, sum of squares column); those named before ``error`` are tested against it."""
    names = [p[0] for p in parts]
    tested = names[: names.index(error)]
    base = next(p for p in parts if p[0] == error)
    s = s.select(*by, F.col(base[1]).alias("__d2"), F.col(base[2]).alias("__s2"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("source"), F.col(d).cast("double").alias("dof"), F.col(q).alias("ss")) for i, (n, d, q) in enumerate(parts)])).alias("r"))
    ms = F.col("r.ss") / F.nullif(F.col("r.dof"), F.lit(0.0))
    s = s.select(*by, "__d2", F.col("r.i").alias("i"), F.col("r.source").alias("source"), F.col("r.dof").alias("dof"), F.col("r.ss").alias("sum_of_squares"), ms.alias("variance"), (F.col("__s2") / F.nullif(F.col("__d2").cast("double"), F.lit(0.0))).alias("__e"))
    s = s.withColumn("f_statistic", F.when(F.col("source").isin(*tested), F.col("variance") / F.nullif(F.col("__e"), F.lit(0.0))))
    p = K.f_upper(F.greatest(F.col("f_statistic"), F.lit(0.0)), F.col("dof"), F.col("__d2").cast("double"))
    return s.withColumn("probability", F.when(F.col("f_statistic").isNotNull(), p)).select(*by, "source", "dof", "sum_of_squares", "variance", "f_statistic", "probability")


def one_factor(df: DataFrame, value: str, level: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows main, within, total. Levels may have different sizes. Sums of squares are centred: no cancellation of raw moments."""
    v = F.col(value).cast("double")
    g = df.groupBy(*by, level).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2")).filter("n > 0")
    s = g.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum((F.col("n") - 1) * F.coalesce("s2", F.lit(0.0))).alias("ss_within"), F.collect_list(F.struct("n", "m")).alias("g"), F.avg("m").alias("c"))
    grand = F.aggregate("g", F.lit(0.0), lambda t, x: t + x["n"] * (x["m"] - F.col("c"))) / F.col("total") + F.col("c")
    s = s.withColumn("grand", grand).withColumn("ss_main", F.aggregate("g", F.lit(0.0), lambda t, x: t + x["n"] * (x["m"] - F.col("grand")) * (x["m"] - F.col("grand"))))
    s = s.select(*by, (F.col("k") - 1).alias("d1"), (F.col("total") - F.col("k")).alias("d2"), (F.col("total") - 1).alias("d3"), "ss_main", "ss_within", (F.col("ss_main") + F.col("ss_within")).alias("ss_total"))
    return _rows(s, by, [("main", "d1", "ss_main"), ("within", "d2", "ss_within"), ("total", "d3", "ss_total")], "within")


def two_factor(df: DataFrame, value: str, factor1: str, factor2: str, by: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Rows main, main2, interaction, within, total of a two-factor design with replication.

    Cells of unequal sizes are analysed by their unweighted means: the effects are
    those of the cell means, scaled by the harmonic mean of the cell sizes; within
    and total are over all values. In a balanced design that is the usual analysis,
    in others the parts do not add up to the total. With ``check`` an unbalanced
    design raises an error when the result is computed; a pair of levels without
    values always does. One aggregate over the rows, the rest over the cells.
    """
    by = list(by)
    if factor1 == factor2:
        raise InvalidArgumentError("two different factors")
    v = F.col(value).cast("double")
    cells = df.groupBy(*by, F.col(factor1).alias("f1"), F.col(factor2).alias("f2")).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2")).filter("n > 0")
    sets = [[*by, "f1", "f2"], [*by, "f1"], [*by, "f2"], by]
    g = cells.groupingSets(sets, *by, "f1", "f2").agg(F.grouping("f1").alias("no1"), F.grouping("f2").alias("no2"), F.sum("n").alias("n"), F.avg("m").alias("u"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"), (F.count(F.lit(1)) / F.sum(1 / F.col("n"))).alias("nh"), F.sum((F.col("n") - 1) * F.coalesce("s2", F.lit(0.0))).alias("ssw"), F.min("n").alias("least"), F.max("n").alias("most"))
    of = lambda a, b, c: F.when((F.col("no1") == a) & (F.col("no2") == b), c)
    # in a complete design the mean of row (column, cell) means is the unweighted grand mean
    spread = lambda a, b: F.var_pop(of(a, b, F.col("u")))
    s = g.groupBy(*by).agg(F.collect_list(of(0, 0, F.struct("n", "m"))).alias("cell"), *[F.count(of(*x, F.lit(1))).alias(k) for k, x in (("a", (0, 1)), ("b", (1, 0)), ("c", (0, 0)))], *[spread(*x).alias(k) for k, x in (("v1", (0, 1)), ("v2", (1, 0)), ("vc", (0, 0)))], *[F.max(of(1, 1, F.col(c))).alias(c) for c in ("n", "m", "nh", "ssw", "least", "most")])
    between = F.aggregate("cell", F.lit(0.0), lambda t, x: t + x["n"] * (x["m"] - F.col("m")) * (x["m"] - F.col("m")))
    scale = F.col("nh") * F.col("c")
    s = s.select(*by, "n", "least", "most", "a", "b", "c", (scale * F.col("v1")).alias("ss1"), (scale * F.col("v2")).alias("ss2"), (scale * F.col("vc")).alias("ssc"), (between + F.col("ssw")).alias("sst"), "ssw")
    right = F.col("c") == F.col("a") * F.col("b")
    if check:
        right = right & (F.col("least") == F.col("most"))
    s = s.withColumn("ssw", F.when(right, F.col("ssw")).otherwise(F.raise_error(F.lit("the design is not balanced" if check else "a pair of levels has no values")).cast("double")))
    s = s.select(*by, (F.col("a") - 1).alias("d1"), (F.col("b") - 1).alias("d2"), ((F.col("a") - 1) * (F.col("b") - 1)).alias("d3"), (F.col("n") - F.col("c")).alias("d4"), (F.col("n") - 1).alias("d5"), "ss1", "ss2", (F.col("ssc") - F.col("ss1") - F.col("ss2")).alias("ss3"), F.col("ssw").alias("ss4"), F.col("sst").alias("ss5"))
    return _rows(s, by, [("main", "d1", "ss1"), ("main2", "d2", "ss2"), ("interaction", "d3", "ss3"), ("within", "d4", "ss4"), ("total", "d5", "ss5")], "within")


def model_fit(df: DataFrame, measured: str, modelled: str, parameters: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows main, within, total for a model with ``parameters`` parameters. The overall mean is that of measured and modelled values together.

    Second moments about the pooled mean follow from each column's own mean and
    variance, so one pass is enough.
    """
    y, f = F.col(measured).cast("double"), F.col(modelled).cast("double")
    s = df.filter(y.isNotNull() & f.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(f).alias("mf"), F.var_pop(y).alias("vy"), F.var_pop(f).alias("vf"), F.avg((y - f) * (y - f)).alias("r2"))
    mid = (F.col("my") + F.col("mf")) / 2
    s = s.select(*by, F.lit(parameters - 1).alias("d1"), (F.col("n") - parameters).alias("d2"), (F.col("n") - 1).alias("d3"), (F.col("n") * (F.col("vf") + (F.col("mf") - mid) * (F.col("mf") - mid))).alias("ss1"), (F.col("n") * F.col("r2")).alias("ss2"), (F.col("n") * (F.col("vy") + (F.col("my") - mid) * (F.col("my") - mid))).alias("ss3"))
    return _rows(s, by, [("main", "d1", "ss1"), ("within", "d2", "ss2"), ("total", "d3", "ss3")], "within")
