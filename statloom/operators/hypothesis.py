"""Hypothesis tests per group: one or two aggregates, then expressions on the few rows that are left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..functions.distributions import Distribution
from ..sources.shared import counted


def two_samples(df: DataFrame, value: str, group: str, a, b, by: Sequence[str] = ()) -> DataFrame:
    """by, n1, m1, v1, n2, m2, v2 of the rows whose ``group`` is ``a`` and ``b``, in one pass."""
    v = F.col(value).cast("double")
    cols = [f(F.when(F.col(group) == F.lit(x), v)).alias(f"{name}{i}") for i, x in ((1, a), (2, b)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    return df.filter(F.col(group).isin(a, b)).groupBy(*by).agg(*cols)


def t_test_equal_variance(df: DataFrame, value: str, group: str, a, b, by: Sequence[str] = ()) -> DataFrame:
    """by, statistic (absolute), p, dof. Variances are pooled; null where a sample has fewer than two values."""
    s = two_samples(df, value, group, a, b, by).withColumn("dof", (F.col("n1") + F.col("n2") - 2).cast("double"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.col("dof")
    s = s.withColumn("statistic", F.abs(F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    return s.select(*by, "statistic", K.two_sided_t(F.col("statistic"), F.col("dof")).alias("p"), "dof")


def t_test_unequal_variance(df: DataFrame, value: str, group: str, a, b, by: Sequence[str] = ()) -> DataFrame:
    """Welch's test: by, statistic (signed), p, dof."""
    s = two_samples(df, value, group, a, b, by)
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    s = s.withColumn("statistic", (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)).withColumn("dof", (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1)))
    return s.select(*by, "statistic", K.two_sided_t(F.col("statistic"), F.col("dof")).alias("p"), "dof")


def t_test_paired(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """by, statistic (signed), p, dof for two columns of a row; join on the key first if the samples are in two tables. Rows with a null are left out."""
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.filter(u.isNotNull() & v.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(u).alias("m1"), F.avg(v).alias("m2"), F.var_samp(u).alias("v1"), F.var_samp(v).alias("v2"), F.covar_samp(u, v).alias("c"))
    s = s.withColumn("dof", (F.col("n") - 1).cast("double")).withColumn("statistic", (F.col("m1") - F.col("m2")) / F.sqrt((F.col("v1") + F.col("v2") - 2 * F.col("c")) / F.col("n")))
    return s.select(*by, "statistic", K.two_sided_t(F.col("statistic"), F.col("dof")).alias("p"), "dof")


def f_test(df: DataFrame, value: str, group: str, a, b, by: Sequence[str] = ()) -> DataFrame:
    """by, statistic, p (two-sided), dof1, dof2; the larger variance is on top."""
    s = two_samples(df, value, group, a, b, by)
    first = F.col("v1") >= F.col("v2")
    d = lambda n: (F.col(n) - 1).cast("double")
    s = s.select(*by, F.when(first, F.col("v1") / F.col("v2")).otherwise(F.col("v2") / F.col("v1")).alias("statistic"), F.when(first, d("n1")).otherwise(d("n2")).alias("dof1"), F.when(first, d("n2")).otherwise(d("n1")).alias("dof2"))
    s = s.withColumn("p", 2 * K.f_upper(F.col("statistic"), F.col("dof1"), F.col("dof2")))
    return s.select(*by, "statistic", F.when(F.col("p") > 1, 2 - F.col("p")).otherwise(F.col("p")).alias("p"), "dof1", "dof2")


def _samples(df: DataFrame, value: str | Column, group: str, by: Sequence[str]) -> DataFrame:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.groupBy(*by, group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2")).filter("n > 0")


def bartlett(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """by, statistic, p, dof for equal variances over the groups. Null if there is one group, or a group without a variance."""
    w = F.col("n") - 1
    s = _samples(df, value, group, by).groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(w * F.col("s2")).alias("ss"), F.sum(w * F.log("s2")).alias("logs"), F.sum(1 / w.cast("double")).alias("inv"), F.min("s2").alias("least"), F.count("s2").alias("with_s2"))
    dof, rest = (F.col("k") - 1).cast("double"), (F.col("total") - F.col("k")).cast("double")
    top = rest * F.log(F.col("ss") / rest) - F.col("logs")
    stat = F.when((F.col("k") > 1) & (F.col("with_s2") == F.col("k")) & (F.col("least") > 0), top / (1 + (F.col("inv") - 1 / rest) / (3 * dof)))
    s = s.select(*by, stat.alias("statistic"), dof.alias("dof"))
    return s.select(*by, "statistic", K.chi2_upper(F.greatest(F.col("statistic"), F.lit(0.0)), F.col("dof")).alias("p"), "dof")


def levene(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """by, statistic, p, dof1, dof2 with deviations from the group means.

    Deviations need the means first; they come from one row per group that is
    broadcast to the rows if there are few groups, not from a window over a group.
    """
    by = list(by)
    keys = [*by, group]
    means = _samples(df, value, group, by).select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("m").alias("__m"))
    means = counted(means)
    near = df.select(*keys, F.col(value).cast("double").alias("__v")).join(means, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]).select(*keys, F.abs(F.col("__v") - F.col("__m")).alias("z"))
    g = _samples(near, "z", group, by)
    s = g.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum((F.col("n") - 1) * F.coalesce("s2", F.lit(0.0))).alias("within"), F.avg("m").alias("c"), F.collect_list(F.struct("n", "m")).alias("g"))
    # between the groups, centred at the grand mean; groups are few
    grand = F.aggregate("g", F.lit(0.0), lambda t, x: t + x["n"] * (x["m"] - F.col("c"))) / F.col("total") + F.col("c")
    s = s.withColumn("grand", grand).withColumn("between", F.aggregate("g", F.lit(0.0), lambda t, x: t + x["n"] * (x["m"] - F.col("grand")) * (x["m"] - F.col("grand"))))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("total") - F.col("k")).cast("double")
    s = s.select(*by, F.when((d1 > 0) & (d2 > 0) & (F.col("within") > 0), d2 / d1 * F.col("between") / F.col("within")).alias("statistic"), d1.alias("dof1"), d2.alias("dof2"))
    return s.select(*by, "statistic", K.f_upper(F.col("statistic"), F.col("dof1"), F.col("dof2")).alias("p"), "dof1", "dof2")


def half_width(dist: Distribution, alpha, s, n):
    """Half of a confidence interval: ppf(1 - alpha / 2) s / sqrt(n); numbers or columns."""
    k = K.of(s, n)
    return dist.ppf(1 - alpha / 2) * s / k.sqrt(n)


def confidence_interval(df: DataFrame, value: str, dist: Distribution, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """by, mean, half_width. The caller chooses the distribution (and its degrees of freedom)."""
    v = F.col(value).cast("double")
    s = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("s"), F.count(v).cast("double").alias("n"))
    q = dist.ppf(1 - alpha / 2)
    return s.select(*by, "mean", (q * F.col("s") / F.sqrt("n")).alias("half_width"))


def sample_size(dist: Distribution, variance, delta, power: float = 0.8, alpha: float = 0.05):
    """2 (z_{1 - alpha / 2} + z_power)^2 variance / delta^2; numbers or columns."""
    z = dist.ppf(1 - alpha / 2) + dist.ppf(power)
    return 2 * z * z * variance / (delta * delta)


