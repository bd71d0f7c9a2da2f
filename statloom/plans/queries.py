"""One query per statistical operator, over whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import kernel as K
from ..operators import anova, descriptive, doe, hypothesis, interp, mcmc, nonlinear, regression, sampling, series
from ..sources.tables import table
from ..streaming.moments import windowed_moments
from . import sqlkernel as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    kinds = dict(df.dtypes)
    k = digits if isinstance(digits, dict) else {}
    d = lambda c: k.get(c, 6 if k else digits)
    return df.select(*[F.round(c, d(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


# --- descriptive statistics ---
@query("SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, round(stddev_samp(l_quantity), 6) AS standard_deviation FROM lineitem GROUP BY ALL")
def moments(spark, sf):
    return rounded(descriptive.moments(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL")
def mean(spark, sf):
    return rounded(descriptive.mean(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"]), 4)


@query("SELECT event_type, round(coalesce(var_samp(value), 0), 6) AS variance FROM events GROUP BY ALL")
def variance(spark, sf):
    return rounded(descriptive.variance(table(spark, sf, "events"), "value", ["event_type"], compat=True))


@query("SELECT event_type, round(stddev_samp(value), 6) AS standard_deviation FROM events GROUP BY ALL")
def standard_deviation(spark, sf):
    return rounded(descriptive.standard_deviation(table(spark, sf, "events"), "value", ["event_type"]))


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY ALL")
def median(spark, sf):
    return rounded(descriptive.median(table(spark, sf, "events"), "value", ["event_type"]))


@query("""
WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
p AS (SELECT *, (n + 1) * q AS pos, greatest(1, least(floor((n + 1) * q), n)) AS lo FROM r, (SELECT unnest([0.1, 0.25, 0.5, 0.9]::DOUBLE[]) AS q))
SELECT l_returnflag, q, round(max(CASE WHEN i = lo THEN v END) + max(least(1, greatest(0, pos - lo))) * (max(CASE WHEN i = least(lo + 1, n) THEN v END) - max(CASE WHEN i = lo THEN v END)), 4) AS quantile FROM p GROUP BY ALL""")
def quantile(spark, sf):
    return rounded(descriptive.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.1, 0.25, 0.5, 0.9], ["l_returnflag"]), 4)


@query("""
WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(v), 6) AS trimmed_mean FROM r WHERE i BETWEEN greatest(floor(n * 0.05), 1) AND n - greatest(floor(n * 0.05), 1) + 1 GROUP BY ALL""")
def trimmed_mean(spark, sf):
    return rounded(descriptive.trimmed_mean(table(spark, sf, "events"), "value", 0.05, ["event_type"]))


@query("SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance FROM lineitem GROUP BY ALL")
def covariance(spark, sf):
    return rounded(descriptive.covariance(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 2)


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS correlation FROM lineitem GROUP BY ALL")
def correlation(spark, sf):
    return rounded(descriptive.correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 8)


@query("WITH g AS (SELECT c_mktsegment, count(*) AS n, var_samp(c_acctbal) AS s2 FROM customer GROUP BY ALL) SELECT round(sum((n - 1) * s2) / sum(n - 1), 4) AS pooled_variance FROM g")
def pooled_variance(spark, sf):
    return rounded(descriptive.pooled_variance(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment"), 4)


@query("SELECT round(sum((n - 1) * s2) / sum(n - 1), 4) AS pooled_variance FROM (SELECT count(*) AS n, var_samp(c_acctbal) AS s2 FROM customer GROUP BY c_nationkey)")
def pooled_variance_of_variances(spark, sf):
    g = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.var_samp("c_acctbal").alias("s2"))
    return rounded(descriptive.pooled_variance_of(g, "s2", "n"), 4)


# --- hypothesis tests ---
_AR = "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS n1, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2 FROM lineitem GROUP BY ALL"


@query(f"WITH s AS ({_AR}), t AS (SELECT l_linestatus, (n1 + n2 - 2)::DOUBLE AS dof, abs(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM s) SELECT l_linestatus, round(t, 6) AS statistic, round({S.two_sided_t('t', 'dof')}, 6) AS p, dof FROM t")
def t_test_equal_variance(spark, sf):
    return rounded(hypothesis.t_test_equal_variance(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", ["l_linestatus"]))


@query(f"WITH s AS ({_AR}), t AS (SELECT l_linestatus, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS dof, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t FROM s) SELECT l_linestatus, round(t, 6) AS statistic, round({S.two_sided_t('t', 'dof')}, 6) AS p, round(dof, 4) AS dof FROM t")
def t_test_unequal_variance(spark, sf):
    return rounded(hypothesis.t_test_unequal_variance(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", ["l_linestatus"]), {"dof": 4})


@query(f"WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_discount - 0.01) AS m1, avg(l_tax) AS m2, var_samp(l_discount - 0.01) + var_samp(l_tax) - 2 * covar_samp(l_discount - 0.01, l_tax) AS v FROM lineitem GROUP BY ALL), t AS (SELECT l_returnflag, (n - 1)::DOUBLE AS dof, (m1 - m2) / sqrt(v / n) AS t FROM s) SELECT l_returnflag, round(t, 5) AS statistic, round({S.two_sided_t('t', 'dof')}, 6) AS p, dof FROM t")
def t_test_paired(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.01).alias("a"), F.col("l_tax").alias("b"))
    return rounded(hypothesis.t_test_paired(df, "a", "b", ["l_returnflag"]), {"statistic": 5})


@query(f"WITH s AS ({_AR}), t AS (SELECT l_linestatus, greatest(v1, v2) / least(v1, v2) AS f, (CASE WHEN v1 >= v2 THEN n1 ELSE n2 END - 1)::DOUBLE AS d1, (CASE WHEN v1 >= v2 THEN n2 ELSE n1 END - 1)::DOUBLE AS d2 FROM s), u AS (SELECT *, 2 * {S.f_upper('f', 'd1', 'd2')} AS p FROM t) SELECT l_linestatus, round(f, 8) AS statistic, round(CASE WHEN p > 1 THEN 2 - p ELSE p END, 6) AS p, d1 AS dof1, d2 AS dof2 FROM u")
def f_test(spark, sf):
    return rounded(hypothesis.f_test(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", ["l_linestatus"]), {"statistic": 8})


_SEG = "SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS s2 FROM customer GROUP BY ALL"


@query(f"WITH g AS ({_SEG}), s AS (SELECT count(*) AS k, sum(n) AS t, sum((n - 1) * s2) AS ss, sum((n - 1) * ln(s2)) AS l, sum(1.0 / (n - 1)) AS inv FROM g), q AS (SELECT (k - 1)::DOUBLE AS dof, ((t - k) * ln(ss / (t - k)) - l) / (1 + (inv - 1.0 / (t - k)) / (3 * (k - 1))) AS x FROM s) SELECT round(x, 6) AS statistic, round({S.gamma_q('dof / 2', 'x / 2')}, 6) AS p, dof FROM q")
def bartlett(spark, sf):
    return rounded(hypothesis.bartlett(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment"))


@query(f"WITH z AS (SELECT c_mktsegment, abs(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment)) AS z FROM customer), g AS (SELECT c_mktsegment, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS w FROM z GROUP BY ALL), s AS (SELECT count(*) AS k, sum(n) AS t, sum(w) AS w, (SELECT avg(z) FROM z) AS gm FROM g), q AS (SELECT (k - 1)::DOUBLE AS d1, (t - k)::DOUBLE AS d2, (t - k) / (k - 1) * (SELECT sum(n * (m - gm) ** 2) FROM g) / w AS x FROM s) SELECT round(x, 6) AS statistic, round({S.f_upper('x', 'd1', 'd2')}, 6) AS p, d1 AS dof1, d2 AS dof2 FROM q")
def levene(spark, sf):
    return rounded(hypothesis.levene(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(1.959963984540054 * stddev_samp(value) / sqrt(count(*)), 6) AS half_width FROM events GROUP BY ALL")
def confidence_interval(spark, sf):
    return rounded(hypothesis.confidence_interval(table(spark, sf, "events"), "value", D.NormalDistribution(), 0.05, ["event_type"]))


@query("SELECT event_type, round(2 * (1.959963984540054 + 0.8416212335729143) ** 2 * var_samp(value) / 9.0, 4) AS sample_size FROM events GROUP BY ALL")
def sample_size(spark, sf):
    v = descriptive.variance(table(spark, sf, "events"), "value", ["event_type"])
    return rounded(v.select("event_type", hypothesis.sample_size(D.NormalDistribution(), F.col("variance"), 3.0).alias("sample_size")), 4)


# --- analysis of variance ---
@query(f"""
WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) * (count(*) - 1) AS w FROM orders GROUP BY ALL),
s AS (SELECT count(*) AS k, sum(n) AS t, sum(w) AS w, sum(n * (m - (SELECT avg(o_totalprice) FROM orders)) ** 2) AS b FROM g),
q AS (SELECT *, (b / (k - 1)) / (w / (t - k)) AS f, (k - 1)::DOUBLE AS d1, (t - k)::DOUBLE AS d2 FROM s)
SELECT 'main' AS source, d1 AS dof, round(b / 1e9, 4) AS ss, round(f, 6) AS f_statistic, round({S.f_upper('f', 'd1', 'd2')}, 6) AS probability FROM q
UNION ALL SELECT 'within', d2, round(w / 1e9, 4), NULL, NULL FROM q UNION ALL SELECT 'total', (t - 1)::DOUBLE, round((b + w) / 1e9, 4), NULL, NULL FROM q""")
def anova_one_factor(spark, sf):
    a = anova.one_factor(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(a.select("source", "dof", (F.col("sum_of_squares") / 1e9).alias("ss"), "f_statistic", "probability"), {"ss": 4})


@query(f"""
WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, coalesce(var_samp(o_totalprice), 0) * (count(*) - 1) AS w FROM orders GROUP BY ALL),
r AS (SELECT avg(m) AS m FROM c GROUP BY a), l AS (SELECT avg(m) AS m FROM c GROUP BY b),
s AS (SELECT sum(n) AS n, sum(w) AS w, count(*)::DOUBLE AS k, count(*) / sum(1 / n) AS h, var_pop(m) AS vc, (SELECT var_pop(m) FROM r) AS v1, (SELECT var_pop(m) FROM l) AS v2, (SELECT count(*) FROM r)::DOUBLE AS k1, (SELECT count(*) FROM l)::DOUBLE AS k2, (SELECT var_pop(o_totalprice) * count(*) FROM orders) AS t FROM c),
q AS (SELECT 'main' AS source, k1 - 1 AS dof, h * k * v1 AS ss, w / (n - k) AS e, n - k AS d2 FROM s UNION ALL SELECT 'main2', k2 - 1, h * k * v2, w / (n - k), n - k FROM s UNION ALL SELECT 'interaction', (k1 - 1) * (k2 - 1), h * k * (vc - v1 - v2), w / (n - k), n - k FROM s)
SELECT source, dof, round(ss / 1e9, 4) AS ss, round(ss / dof / e, 6) AS f_statistic, round({S.f_upper('ss / dof / e', 'dof', 'd2')}, 6) AS probability FROM q
UNION ALL SELECT 'within', n - k, round(w / 1e9, 4), NULL, NULL FROM s UNION ALL SELECT 'total', n - 1, round(t / 1e9, 4), NULL, NULL FROM s""")
def anova_two_factor(spark, sf):
    a = anova.two_factor(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority", "o_orderstatus", check=False)
    return rounded(a.select("source", "dof", (F.col("sum_of_squares") / 1e9).alias("ss"), "f_statistic", "probability"), {"ss": 4})


@query(f"""
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS f FROM lineitem), s AS (SELECT count(*)::DOUBLE AS n, (avg(y) + avg(f)) / 2 AS m FROM d),
q AS (SELECT n, sum((f - m) ** 2) AS b, sum((y - f) ** 2) AS w, sum((y - m) ** 2) AS t FROM d, s GROUP BY n)
SELECT 'main' AS source, 1.0 AS dof, round(b, 2) AS ss, round(b / (w / (n - 2)), 4) AS f_statistic, round({S.f_upper('b / (w / (n - 2))', '1', 'n - 2')}, 6) AS probability FROM q
UNION ALL SELECT 'within', n - 2, round(w, 2), NULL, NULL FROM q UNION ALL SELECT 'total', n - 1, round(t, 2), NULL, NULL FROM q""")
def anova_model_fit(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("f"))
    a = anova.model_fit(df, "y", "f", 2)
    return rounded(a.select("source", "dof", F.col("sum_of_squares").alias("ss"), "f_statistic", "probability"), {"ss": 2, "f_statistic": 4})


# --- regression ---
@query("SELECT l_returnflag, round(1 - sum((l_extendedprice - 1500 * l_quantity) ** 2) / ((count(*) - 1) * var_samp(l_extendedprice)), 8) AS r_squared, round(1 - (sum((l_extendedprice - 1500 * l_quantity) ** 2) / ((count(*) - 1) * var_samp(l_extendedprice))) * (count(*) - 1) / (count(*) - 3), 8) AS adjusted_r_squared FROM lineitem GROUP BY ALL")
def r_squared(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", (1500 * F.col("l_quantity")).alias("m"))
    return rounded(regression.r_squared(df, "l_extendedprice", "m", ["l_returnflag"], 2), 8)


@query("SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS c0, l_quantity AS c1, l_quantity * l_quantity AS c2 FROM lineitem")
def design_matrix(spark, sf):
    return regression.design_matrix(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 2).drop("l_quantity")


@query("WITH s AS (SELECT count(*)::DOUBLE AS n, sum(l_quantity) AS a, sum(l_quantity ** 2) AS b FROM lineitem) SELECT unnest([0, 0, 1, 1])::INT AS i, unnest([0, 1, 0, 1])::INT AS j, round(unnest([b, -a, -a, n]) / (n * b - a * a), 10) AS value FROM s")
def covariance_matrix(spark, sf):
    return rounded(regression.covariance_matrix(regression.design_matrix(table(spark, sf, "lineitem"), "l_quantity", 1), ["c0", "c1"]), 10)


@query(f"""
WITH s AS (SELECT l_returnflag, count(*)::DOUBLE AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) AS sse, avg(l_quantity) AS m FROM lineitem GROUP BY ALL),
t AS (SELECT l_returnflag, unnest([0, 1])::INT AS term, unnest([a, b]) AS coefficient, sqrt(sse / (n - 2)) * unnest([sqrt(1 / n + m * m / sxx), sqrt(1 / sxx)]) AS se, n - 2 AS dof FROM s)
SELECT l_returnflag, term, round(coefficient, 4) AS coefficient, round(se, 6) AS standard_error, round(coefficient / se, 4) AS t_statistic, round({S.two_sided_t('coefficient / se', 'dof')}, 6) AS probability, round({S.t_quantile('1.959963984540054', 'dof')} * se, 6) AS confidence_interval FROM t""")
def linear_least_squares(spark, sf):
    f = regression.linear_least_squares(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 1, by=["l_returnflag"])
    return rounded(f, {"coefficient": 4, "t_statistic": 4})


@query("SELECT l_returnflag, unnest([0, 1])::INT AS term, round(unnest([0, sum(l_quantity * l_extendedprice) / sum(l_quantity ** 2)]), 4) AS coefficient FROM lineitem GROUP BY l_returnflag")
def linear_least_squares_origin(spark, sf):
    f = regression.linear_least_squares(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 1, intercept=False, by=["l_returnflag"])
    return rounded(f.select("l_returnflag", "term", "coefficient"), 4)


@query("""
WITH d AS (SELECT l_quantity - 25 AS z, l_extendedprice AS y FROM lineitem), s AS (SELECT count(*)::DOUBLE AS n, sum(z) AS z1, sum(z ** 2) AS z2, sum(z ** 3) AS z3, sum(z ** 4) AS z4, sum(y) AS y0, sum(z * y) AS y1, sum(z * z * y) AS y2 FROM d),
c AS (SELECT *, n * (z2 * z4 - z3 * z3) - z1 * (z1 * z4 - z2 * z3) + z2 * (z1 * z3 - z2 * z2) AS det FROM s),
e AS (SELECT (y0 * (z2 * z4 - z3 * z3) - z1 * (y1 * z4 - z3 * y2) + z2 * (y1 * z3 - z2 * y2)) / det AS a, (n * (y1 * z4 - z3 * y2) - y0 * (z1 * z4 - z2 * z3) + z2 * (z1 * y2 - z2 * y1)) / det AS b, (n * (z2 * y2 - z3 * y1) - z1 * (z1 * y2 - z2 * y1) + y0 * (z1 * z3 - z2 * z2)) / det AS c FROM c)
SELECT unnest([0, 1, 2])::INT AS term, round(unnest([a - 25 * b + 625 * c, b - 50 * c, c]), 4) AS coefficient FROM e""")
def quadratic_least_squares(spark, sf):
    return rounded(regression.linear_least_squares(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 2).select("term", "coefficient"), 4)


@query("WITH s AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, l_returnflag, round(a + b * l_quantity, 4) AS modelled, round(a + b * l_quantity - l_extendedprice, 4) AS residual FROM lineitem JOIN s USING (l_returnflag)")
def linear_prediction(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    f = regression.linear_least_squares(li, "l_quantity", "l_extendedprice", 1, by=["l_returnflag"])
    p = regression.predict(li, f, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(p.drop("l_quantity", "l_extendedprice"), 4)


@query("SELECT p_partkey, round(p_size * p_size, 3)::DOUBLE AS j0, p_size::DOUBLE AS j1, 1.0::DOUBLE AS j2 FROM part")
def jacobian(spark, sf):
    j = regression.jacobian(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x")), lambda x, p: p[0] * x * x + p[1] * x + p[2], "x", [0.5, -1.35, 1.2])
    return j.select("p_partkey", F.round("j0").alias("j0"), F.round("j1").alias("j1"), F.round("j2").alias("j2"))


@query("SELECT l_returnflag, unnest([0, 1])::INT AS parameter, round(unnest([regr_intercept(l_extendedprice / 1000, l_quantity), regr_slope(l_extendedprice / 1000, l_quantity)]), 3) AS estimate FROM lineitem GROUP BY l_returnflag")
def nonlinear_least_squares(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    f = nonlinear.nonlinear_least_squares(df, lambda x, p: p[0] + p[1] * x, "l_quantity", "y", [1.0, 1.0], by=["l_returnflag"], controls=nonlinear.IterationControls(residual_tolerance=1e-12))
    return rounded(f.select("l_returnflag", "parameter", "estimate"), 3)


#: y = a x^b by weighted least squares with weights 1 / x: b is where the derivative of the profile over a changes its sign, found by halving over sums per quantity.
_HALVE = "list_reduce(list_prepend([-1.0::DOUBLE, 1.0::DOUBLE], list_transform(range(60), lambda i: [0.0::DOUBLE, 0.0::DOUBLE])), lambda s, i: CASE WHEN {g} > 0 THEN [(s[1] + s[2]) / 2, s[2]] ELSE [s[1], (s[1] + s[2]) / 2] END)"
_SUM = "list_sum(list_transform(range(1, len(xs) + 1), lambda k: {e}))"
_B = "((s[1] + s[2]) / 2)"
_SLOPE = " - ".join(f"{_SUM.format(e=u)} * {_SUM.format(e=v)}" for u, v in ((f"ln(xs[k]) * xs[k] ** ({_B} - 1) * ys[k]", f"xs[k] ** (2 * {_B} - 1) * ns[k]"), (f"xs[k] ** ({_B} - 1) * ys[k]", f"ln(xs[k]) * xs[k] ** (2 * {_B} - 1) * ns[k]")))
_POWER = f"""q AS (SELECT l_returnflag, l_quantity::DOUBLE AS x, count(*)::DOUBLE AS n, sum(l_extendedprice / 1000)::DOUBLE AS y, sum((l_extendedprice / 1000) ** 2)::DOUBLE AS yy FROM lineitem GROUP BY ALL),
l AS (SELECT l_returnflag, list(x ORDER BY x) AS xs, list(n ORDER BY x) AS ns, list(y ORDER BY x) AS ys FROM q GROUP BY ALL),
e AS (SELECT l_returnflag, s[1] AS b FROM (SELECT l_returnflag, {_HALVE.format(g=_SLOPE)} AS s FROM l)),
f AS (SELECT l_returnflag, b, sum(x ** (b - 1) * y) / sum(x ** (2 * b - 1) * n) AS a FROM q JOIN e USING (l_returnflag) GROUP BY ALL)"""


@query(f"""
WITH {_POWER},
h AS (SELECT l_returnflag, a, b, sum(n) AS n, sum(yy - 2 * a * x ** b * y + n * a * a * x ** (2 * b)) AS squares, sum((yy - 2 * a * x ** b * y + n * a * a * x ** (2 * b)) / x) AS chi, sum(n * x ** (2 * b - 1)) AS aa, sum(n * a * ln(x) * x ** (2 * b - 1)) AS ab, sum(n * a * a * ln(x) ** 2 * x ** (2 * b - 1)) AS bb FROM q JOIN f USING (l_returnflag) GROUP BY ALL),
t AS (SELECT l_returnflag, n, chi, n - 2 AS dof, unnest([0, 1])::INT AS parameter, unnest([a, b]) AS estimate, sqrt(squares / (n - 2) * unnest([bb, aa]) / (aa * bb - ab * ab)) AS se FROM h)
SELECT l_returnflag, parameter, n::BIGINT AS n, round(chi / n, 5) AS chi_squared, round(estimate, 5) AS estimate, round(se, 6) AS standard_error, round(estimate / se, 2) AS t_statistic, round({S.two_sided_t('estimate / se', 'dof')}, 4) AS probability, round({S.t_quantile('1.959963984540054', 'dof')} * se, 6) AS confidence_interval, true AS converged FROM t""")
def nonlinear_fit_by_aggregates(spark, sf):
    """A power of the quantity through the prices of all rows, weighted, with bounds: every step of the fit is one aggregate."""
    f = nonlinear.distributed_least_squares(_power_rows(spark, sf), _power, "l_quantity", "y", [40.0, 0.2], "w", ["l_returnflag"], [0.0, -1.0], [1000.0, 1.0], _FINE)
    out = f.select("l_returnflag", "parameter", "n", (F.col("chi_squared") / F.col("n")).alias("chi_squared"), "estimate", "standard_error", "t_statistic", "probability", "confidence_interval", F.col("info.converge_on_solution_change").alias("converged"))
    return rounded(out, {"chi_squared": 5, "estimate": 5, "standard_error": 6, "t_statistic": 2, "probability": 4, "confidence_interval": 6})


@query(f"WITH {_POWER} SELECT l_orderkey, l_linenumber, l_returnflag, round(a * l_quantity ** b, 4) AS modelled, round(l_extendedprice / 1000 - a * l_quantity ** b, 4) AS residual FROM lineitem JOIN f USING (l_returnflag)")
def nonlinear_prediction(spark, sf):
    df = _power_rows(spark, sf, "l_orderkey", "l_linenumber")
    f = nonlinear.distributed_least_squares(df, _power, "l_quantity", "y", [40.0, 0.2], "w", ["l_returnflag"], [0.0, -1.0], [1000.0, 1.0], _FINE)
    return rounded(nonlinear.predict(df, f, _power, "l_quantity", "y", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_returnflag", "modelled", "residual"), 4)


_FINE = nonlinear.IterationControls(residual_tolerance=1e-13, change_in_solution_tolerance=1e-11)


def _power(x, p):
    return p[0] * F.pow(x[0], p[1])


def _power_rows(spark, sf, *columns):
    return table(spark, sf, "lineitem").select(*columns, "l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"), (1 / F.col("l_quantity")).alias("w"))


# --- experimental design ---
@query("""
WITH n AS (SELECT count(DISTINCT c_nationkey) AS u, count(DISTINCT c_mktsegment) AS v, (SELECT count(DISTINCT p_size) FROM part) AS w FROM customer)
SELECT ((a * v + b) * w + c)::BIGINT AS run, (a + 1)::INT AS f1, (b + 1)::INT AS f2, (c + 1)::INT AS f3 FROM (SELECT *, unnest(range(w)) AS c FROM (SELECT *, unnest(range(v)) AS b FROM (SELECT *, unnest(range(u)) AS a FROM n)))""")
def full_factorial(spark, sf):
    """All combinations of nation, market segment and part size, by number."""
    levels = [table(spark, sf, t).select(c).distinct().count() for t, c in (("customer", "c_nationkey"), ("customer", "c_mktsegment"), ("part", "p_size"))]
    return doe.full_factorial(spark, levels)


@query("""
WITH d AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) SELECT unnest([0, 1])::INT AS term, round(unnest([regr_intercept(y, x), regr_slope(y, x)]), 6) AS coefficient FROM d""")
def doe_fit_one_way(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(doe.fit_rows(df, 1, ["l_quantity"], "y").select("term", "coefficient"))


@query("SELECT l_orderkey, l_linenumber, round(1 + 2 * l_quantity - 3 * l_discount + 4 * l_quantity * l_discount + 5 * l_discount * l_quantity, 6) AS modelled FROM lineitem")
def doe_evaluate_two_way(spark, sf):
    m = doe.DoeModel(2, ("l_quantity", "l_discount"), (1.0, 2.0, -3.0, 4.0, 5.0), (True,) * 5)
    return rounded(doe.evaluate(table(spark, sf, "lineitem"), m).select("l_orderkey", "l_linenumber", "modelled"))


@query("SELECT unnest([0, 1, 2, 3, 4])::INT AS term, unnest([2.0, 0.5, -1.0, 0.25, 0.25])::DOUBLE AS coefficient")
def doe_fit_two_way(spark, sf):
    """An exact two-way surface on lineitem: the products i j and j i share their coefficient."""
    df = table(spark, sf, "lineitem").select("l_quantity", "l_discount", (2 + 0.5 * F.col("l_quantity") - F.col("l_discount") + 0.5 * F.col("l_quantity") * F.col("l_discount")).alias("y"))
    return doe.fit_rows(df, 2, ["l_quantity", "l_discount"], "y").select("term", (F.round("coefficient", 4) + 0.0).alias("coefficient"))


# --- distributions and special functions ---
#: Parameters and arguments come from a table: the size of each part, 1 to 50.
_GRID = "(SELECT p_partkey, p_size::BIGINT AS id FROM part)"


def parts(spark, sf):
    """Dealt over all cores: a row takes far more work than its bytes, by which files are split, tell."""
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("id")).repartition(spark.sparkContext.defaultParallelism, "p_partkey")


@query(f"SELECT p_partkey, id, round(exp(lgamma((id + 1) / 2.0) - lgamma(id / 2.0) - 0.5 * ln(id * pi()) - (id + 1) / 2.0 * ln(1 + 0.25 * 0.25 * id * id / id)), 8) AS t_pdf, round(1 - 0.5 * {S.two_sided_t('id * 0.25', 'id')}, 8) AS t_cdf, round(exp(-0.5 * (id * 0.1 - 2) ** 2) / sqrt(2 * pi()), 8) AS n_pdf, round(CASE WHEN id > 20 THEN 1 - 0.5 * {S.gamma_q('0.5', '(id * 0.1 - 2) ** 2 / 2')} ELSE 0.5 * {S.gamma_q('0.5', '(id * 0.1 - 2) ** 2 / 2')} END, 8) AS n_cdf, round(1 - {S.f_upper('id * 0.2', '8', '10')}, 8) AS f_cdf, round(exp(0.5 * ln(0.5 * id) * 3 - 0.25 * id - 2.5 * ln(2.0) - lgamma(2.5)), 8) AS c_pdf, round(1 - {S.gamma_q('2.5', '0.25 * id')}, 8) AS c_cdf, round(exp(lgamma(101) - lgamma(id + 1) - lgamma(101 - id) + id * ln(0.25) + (100 - id) * ln(0.75)), 8) AS b_pdf, round({S.ibeta('100 - id', 'id + 1', '0.75')}, 8) AS b_cdf, round(exp(id * ln(12.5) - 12.5 - lgamma(id + 1)), 8) AS p_pdf, round({S.gamma_q('id + 1', '12.5')}, 8) AS p_cdf, round(exp(-0.5 * ((ln(id * 0.5) - 1) / 0.5) ** 2) / (id * 0.5 * 0.5 * sqrt(2 * pi())), 8) AS l_pdf, round(exp(4 * ln(8.0) + 5 * ln(10.0) + 3 * ln(id * 0.2) - 9 * ln(8 * id * 0.2 + 10) - lgamma(4) - lgamma(5) + lgamma(9)), 8) AS f_pdf, round(CASE WHEN ln(id * 0.5) > 1 THEN 1 - 0.5 * {S.gamma_q('0.5', '((ln(id * 0.5) - 1) / 0.5) ** 2 / 2')} ELSE 0.5 * {S.gamma_q('0.5', '((ln(id * 0.5) - 1) / 0.5) ** 2 / 2')} END, 8) AS l_cdf FROM {_GRID}")
def distributions(spark, sf):
    x = F.col("id").cast("double")
    t, n, f, c, b, p, q = D.TDistribution(x), D.NormalDistribution(), D.FDistribution(8.0, 10.0), D.ChiSquaredDistribution(5.0), D.BinomialDistribution(100.0, 0.25), D.PoissonDistribution(12.5), D.LogNormalDistribution(0.5, 1.0)
    cols = {"t_pdf": t.pdf(x * 0.25), "t_cdf": t.cdf(x * 0.25), "n_pdf": n.pdf(x * 0.1 - 2), "n_cdf": n.cdf(x * 0.1 - 2), "f_cdf": f.cdf(x * 0.2), "c_pdf": c.pdf(x * 0.5), "c_cdf": c.cdf(x * 0.5), "b_pdf": b.pdf(x), "b_cdf": b.cdf(x), "p_pdf": p.pdf(x), "p_cdf": p.cdf(x), "l_pdf": q.pdf(x * 0.5), "f_pdf": f.pdf(x * 0.2), "l_cdf": q.cdf(x * 0.5)}
    return rounded(parts(spark, sf).select("p_partkey", "id", *[v.alias(k) for k, v in cols.items()]), 8)


@query("""
SELECT p_partkey, id, 0.0::DOUBLE AS t_mean, 0.0::DOUBLE AS t_mode, round((id + 2) / id::DOUBLE, 8) AS t_variance, round(id * 0.1::DOUBLE, 8) AS n_mean, round(id * 0.1::DOUBLE, 8) AS n_median, 0.25::DOUBLE AS n_variance, round((id + 4) / (id + 2.0), 8) AS f_mean, round(0.75 * (id + 4) / (id + 6.0), 8) AS f_mode,
round(2.0 * (id + 4) ** 2 * (id + 10) / (8.0 * (id + 2) ** 2 * id), 8) AS f_variance, id::DOUBLE AS c_mean, greatest(id - 2, 0)::DOUBLE AS c_mode, 2.0::DOUBLE * id AS c_variance, round(id * 0.25::DOUBLE, 8) AS b_mean, round(id * 0.1875::DOUBLE, 8) AS b_variance, id + 0.5::DOUBLE AS p_mean, id + 0.5::DOUBLE AS p_variance,
round(exp(id * 0.1 + 0.125), 6) AS l_mean, round(exp(id * 0.1), 6) AS l_median, round(exp(id * 0.1 - 0.25), 6) AS l_mode, round((exp(0.25) - 1) * exp(id * 0.2 + 0.25), 6) AS l_variance, round(exp(-0.5 * (2 - id) ** 2) / sqrt(2 * pi()), 8) AS recentred_pdf, round(id * 0.05::DOUBLE - 1, 6) AS n_quantile
FROM (SELECT p_partkey, p_size::BIGINT AS id FROM part)""")
def distribution_properties(spark, sf):
    x = F.col("id").cast("double")
    t, n, f, c, b, p, q = D.TDistribution(x + 2), D.NormalDistribution(F.lit(0.5), x * 0.1), D.FDistribution(F.lit(8.0), x + 4), D.ChiSquaredDistribution(x), D.BinomialDistribution(x, F.lit(0.25)), D.PoissonDistribution(x + 0.5), D.LogNormalDistribution(F.lit(0.5), x * 0.1)
    one = D.NormalDistribution(1.0, 0.0)
    cols = {"t_mean": t.mean(), "t_mode": t.mode(), "t_variance": t.variance(), "n_mean": n.mean(), "n_median": n.median(), "n_variance": n.variance(), "f_mean": f.mean(), "f_mode": f.mode(), "f_variance": f.variance(), "c_mean": c.mean(), "c_mode": c.mode(), "c_variance": c.variance(), "b_mean": b.mean(), "b_variance": b.variance(), "p_mean": p.mean(), "p_variance": p.variance(), "l_mean": q.mean(), "l_median": q.median(), "l_mode": q.mode(), "l_variance": q.variance(), "recentred_pdf": one.recenter(x).pdf(F.lit(2.0)), "n_quantile": one.ppf(one.cdf(x * 0.05 - 1))}
    out = parts(spark, sf).select("p_partkey", "id", *[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in cols.items()])
    return rounded(out, {k: 6 if k in ("l_mean", "l_median", "l_mode", "l_variance", "n_quantile") else 8 for k in cols})


@query(f"SELECT p_partkey, id, round(exp(lgamma(id * 0.5) + lgamma(2.5) - lgamma(id * 0.5 + 2.5)), 8) AS beta, round({S.ibeta('id * 0.5', '2.5', '0.4')}, 8) AS regularized_beta, round({S.gamma_q('id * 0.5', '5.0')} , 8) AS gamma_q, round(exp(lgamma(id * 0.1 + 1)), 6) AS factorial, round(CASE WHEN id = 20 THEN 0 ELSE sign(id - 20) * (1 - {S.gamma_q('0.5', '((id - 20) * 0.1) ** 2')}) END, 8) AS erf FROM {_GRID}")
def special_functions(spark, sf):
    x = F.col("id").cast("double")
    cols = {"beta": K.beta(x * 0.5, 2.5), "regularized_beta": K.regularized_beta(x * 0.5, F.lit(2.5), F.lit(0.4)), "gamma_q": K.gamma_q(x * 0.5, F.lit(5.0)), "factorial": K.factorial(x * 0.1), "erf": K.erf((x - 20) * 0.1)}
    out = parts(spark, sf).select("p_partkey", "id", *[v.alias(k) for k, v in cols.items()])
    return rounded(out, {"beta": 8, "regularized_beta": 8, "gamma_q": 8, "factorial": 6, "erf": 8}).withColumn("erf", F.col("erf") + 0.0)


@query(f"SELECT p_partkey, id, round(exp(lgamma(id * 0.25)) * {S.gamma_q('id * 0.25', '2.0')}, 6) AS upper, round(exp(lgamma(id * 0.25)) * (1 - {S.gamma_q('id * 0.25', '2.0')}), 6) AS lower, round(exp(lgamma(id * 0.25) + lgamma(3.0) - lgamma(id * 0.25 + 3)) * {S.ibeta('id * 0.25', '3', '0.4')}, 6) AS incomplete_beta FROM {_GRID}")
def incomplete_functions(spark, sf):
    x = F.col("id").cast("double") * 0.25
    return rounded(parts(spark, sf).select("p_partkey", "id", K.incomplete_gamma_upper(x, F.lit(2.0)).alias("upper"), K.incomplete_gamma_lower(x, F.lit(2.0)).alias("lower"), K.incomplete_beta(x, F.lit(3.0), F.lit(0.4)).alias("incomplete_beta")))


@query(f"SELECT p_partkey, id, round(-0.5772156649015329 + list_sum(list_transform(range(1, id), lambda k: 1.0 / k)), 10) AS digamma FROM {_GRID} WHERE id > 1 UNION ALL SELECT p_partkey, id, -0.5772156649 FROM {_GRID} WHERE id = 1")
def digamma(spark, sf):
    return rounded(parts(spark, sf).select("p_partkey", "id", K.digamma(F.col("id").cast("double")).alias("digamma")), 10)


@query("""
WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type HAVING count(*) > 1),
p AS (SELECT *, unnest([1e-8, 0.9, 0.99999999]::DOUBLE[]) AS p, unnest([-5.612001244174789, 1.2815515655446004, 5.612001243305505]::DOUBLE[]) AS z FROM g)
SELECT event_type, p, round(m + s * z, 4) AS normal, round(exp(m / 100 + s / 100 * z), 4) AS log_normal, round((2 * p - 1) / sqrt(2 * p * (1 - p)), 2) AS t2, round(-2 * ln(1 - p), 6) AS chi_squared2, round(ln((n - 1) / 2 * ((1 - p) ** (-2 / (n - 1)) - 1)), 3) AS log_f_low, round(ln(2 * p ** (2 / n) / (n * (1 - p ** (2 / n)))), 3) AS log_f_high FROM p""")
def distribution_quantiles(spark, sf):
    """Quantiles with parameters per group, far into both tails, where they have closed forms."""
    v = F.col("value").cast("double")
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).filter("n > 1")
    g = g.withColumn("p", F.explode(F.array(*[F.lit(x) for x in (1e-8, 0.9, 0.99999999)])))
    n, p, two = F.col("n"), F.col("p"), F.lit(2.0)
    cols = {"normal": D.NormalDistribution(F.col("s"), F.col("m")).ppf(p), "log_normal": D.LogNormalDistribution(F.col("s") / 100, F.col("m") / 100).ppf(p), "t2": D.TDistribution(two).ppf(p), "chi_squared2": D.ChiSquaredDistribution(two).ppf(p), "log_f_low": F.log(D.FDistribution(two, n - 1).ppf(p)), "log_f_high": F.log(D.FDistribution(n, two).ppf(p))}
    return rounded(g.select("event_type", "p", *[c.alias(k) for k, c in cols.items()]), {"p": 8, "normal": 4, "log_normal": 4, "t2": 2, "log_f_low": 3, "log_f_high": 3})


@query("SELECT label, vec_id, round(exp(-0.5 * ((embedding[1] - 0.01) ** 2 / 0.04 + (embedding[2] + 0.02) ** 2 / 0.09)) / (2 * pi() * 0.2 * 0.3), 5) AS density FROM (SELECT label, vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)")
def multivariate_normal(spark, sf):
    d = D.MultivariateNormalDistribution().initialize([0.01, -0.02], [[0.04, 0.0], [0.0, 0.09]])
    e = [F.element_at("embedding", i).cast("double") for i in (1, 2)]
    return rounded(table(spark, sf, "embeddings").select("label", "vec_id", d.pdf(*e).alias("density")), 5)


# --- sampling and the bootstrap ---
_ACCT = "SELECT count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer"


def _moments(spark, sf):
    """Number, mean and deviation of the customers' balances: one row."""
    return descriptive.moments(table(spark, sf, "customer"), "c_acctbal").first()


@query(f"SELECT i, round(m + s * {S.normal('7', 'i')}, 5) AS value FROM (SELECT m, s, unnest(range(n)) AS i FROM ({_ACCT}))")
def box_muller(spark, sf):
    """As many normal numbers as there are customers, with the mean and deviation of their balances."""
    r = _moments(spark, sf)
    return rounded(sampling.box_muller_sample(spark, r["mean"], r.standard_deviation, r.n, 7), 5)


@query(f"""
WITH t AS (SELECT n, m, s, unnest(range(20 * n)) AS i FROM ({_ACCT})), x AS (SELECT n, m, s, i, m - 4 * s + 8 * s * {S.uniform('3', 'i', chr(39) + 'x' + chr(39))} AS x FROM t WHERE i < 20 * n)
SELECT i, round(x, 5) AS value FROM x WHERE {S.uniform('3', 'i', chr(39) + 'u' + chr(39))} * 1.02 <= exp(-0.5 * ((x - m) / s) ** 2) QUALIFY row_number() OVER (ORDER BY i) <= n""")
def rejection(spark, sf):
    r = _moments(spark, sf)
    return rounded(sampling.rejection_sample(spark, D.NormalDistribution(r.standard_deviation, r["mean"]), r.n, r["mean"] - 4 * r.standard_deviation, r["mean"] + 4 * r.standard_deviation, 3), 5)


@query(f"""
WITH s AS (SELECT count(DISTINCT l_orderkey) AS n, avg(l_quantity) AS m0, avg(l_discount) AS m1, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS c FROM lineitem), t AS (SELECT *, unnest(range(n)) AS i FROM s)
SELECT i, round(m0 + sqrt(a) * {S.normal('5', 'i', '0')}, 6) AS x0, round(m1 + b / sqrt(a) * {S.normal('5', 'i', '0')} + sqrt(c - b * b / a) * {S.normal('5', 'i', '1')}, 8) AS x1 FROM t""")
def multivariate_sample(spark, sf):
    """As many pairs as there are orders, with the means and covariances of quantity and discount."""
    x, y = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    r = table(spark, sf, "lineitem").agg(F.count_distinct("l_orderkey").alias("n"), F.avg(x).alias("m0"), F.avg(y).alias("m1"), F.var_samp(x).alias("a"), F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("c")).first()
    d = D.MultivariateNormalDistribution().initialize([r.m0, r.m1], [[r.a, r.b], [r.b, r.c]])
    return rounded(sampling.sample_normal_multivariate(spark, d, r.n, 5), {"x0": 6, "x1": 8})


_CUST = "SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_acctbal AS v, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer"


@query(f"WITH d AS ({_CUST}), u AS (SELECT c_nationkey, b, i, n, floor({S.uniform('11', 'b', 'i')} * n)::BIGINT AS k FROM d, (SELECT unnest(range(1, 6)) AS b)) SELECT u.c_nationkey, b::INT AS b, u.i, d.v FROM u JOIN d ON d.c_nationkey = u.c_nationkey AND d.i = u.k")
def resample_with_replacement(spark, sf):
    return sampling.resample(table(spark, sf, "customer"), "c_acctbal", ["c_custkey"], 5, ["c_nationkey"], 11)


@query(f"""
WITH d AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, c_acctbal AS v, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
u AS (SELECT c_mktsegment, b, floor({S.uniform('0', 'b', 'i')} * n)::BIGINT AS k FROM d, (SELECT unnest(range(2, 201)) AS b)),
p AS (SELECT u.c_mktsegment, b, avg(v) AS m FROM u JOIN d ON d.c_mktsegment = u.c_mktsegment AND d.i = u.k GROUP BY ALL UNION ALL SELECT c_mktsegment, 1, avg(c_acctbal) FROM customer GROUP BY ALL)
SELECT c_mktsegment, round(max(m) FILTER (b = 1), 4) AS statistic, round(avg(m) - max(m) FILTER (b = 1), 4) AS bias, round(stddev_samp(m), 4) AS standard_error, round(list_sort(list(m))[5], 4) AS lower, round(list_sort(list(m))[196], 4) AS upper FROM p GROUP BY ALL""")
def bootstrap_replacement(spark, sf):
    return rounded(sampling.bootstrap(table(spark, sf, "customer"), "c_acctbal", "mean", ["c_custkey"], 200, "replacement", 0.05, ["c_mktsegment"]), 4)


@query(f"""
WITH s AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY ALL),
p AS (SELECT c_mktsegment, b, avg(m + s * {S.normal('0', 'b', 'i')}) AS m FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, unnest(range(2, 101)) AS b FROM s)) GROUP BY ALL UNION ALL SELECT c_mktsegment, 1, m FROM s)
SELECT c_mktsegment, round(max(m) FILTER (b = 1), 4) AS statistic, round(avg(m) - max(m) FILTER (b = 1), 4) AS bias, round(stddev_samp(m), 4) AS standard_error, round(list_sort(list(m))[2], 4) AS lower, round(list_sort(list(m))[99], 4) AS upper FROM p GROUP BY ALL""")
def bootstrap_parametric(spark, sf):
    return rounded(sampling.bootstrap(table(spark, sf, "customer"), "c_acctbal", "mean", (), 100, "random", 0.05, ["c_mktsegment"]), 4)


@query()
def bootstrap_multinomial(spark, sf):
    """The mean price of all line items, 1000 resamples, by weights of the rows: tested against exact enumeration, as its random numbers are not SQL's."""
    return rounded(sampling.bootstrap(table(spark, sf, "lineitem"), "l_extendedprice", "mean", ["l_orderkey", "l_linenumber"], 1000, "multinomial", 0.05, ["l_returnflag"]), 4)


# --- series ---
@query("SELECT user_id, ts, event_id, round(lead(value) OVER w - value, 6) AS difference FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lead(1) OVER w = 1")
def difference(spark, sf):
    return rounded(series.difference(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"]))


_DAILY = "SELECT event_type, date_trunc('day', ts) AS d, avg(value) AS v FROM events GROUP BY ALL"


def daily(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("d")).agg(F.avg("value").alias("v"), F.datediff(F.first(F.col("ts").cast("date")), F.lit("2024-01-01").cast("date")).cast("double").alias("t"))


@query(f"""
WITH p AS (SELECT event_type, row_number() OVER w AS i, sum(v) OVER w AS s, count(*) OVER (PARTITION BY event_type) AS n FROM ({_DAILY}) WINDOW w AS (PARTITION BY event_type ORDER BY d)), q AS (SELECT * FROM p UNION ALL SELECT DISTINCT event_type, 0, 0.0, n FROM p)
SELECT a.event_type, m::INT AS m, (m * 86400)::DOUBLE AS tau, round(sum((c.s - 2 * b.s + a.s) ** 2) / (2 * (a.n - 2 * m + 1) * m * m), 5) AS allan_variance
FROM (SELECT *, unnest(range(1, n // 2)) AS m FROM q) a JOIN q b ON a.event_type = b.event_type AND b.i = a.i + m JOIN q c ON a.event_type = c.event_type AND c.i = a.i + 2 * m GROUP BY a.event_type, m, a.n""")
def allan_variance(spark, sf):
    return rounded(series.allan_variance(daily(spark, sf), "v", ["d"], 86400.0, ["event_type"]), 5)


@query("""
WITH p AS (SELECT event_type, row_number() OVER w AS i, sum(value) OVER w AS s, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), q AS (SELECT * FROM p UNION ALL SELECT DISTINCT event_type, 0, 0.0, n FROM p)
SELECT a.event_type, m::INT AS m, m::DOUBLE AS tau, round(sum((c.s - 2 * b.s + a.s) ** 2) / (2 * (a.n - 2 * m + 1) * m * m), 4) AS allan_variance
FROM (SELECT *, unnest([1, 4, 16, 64]) AS m FROM q) a JOIN q b ON a.event_type = b.event_type AND b.i = a.i + m JOIN q c ON a.event_type = c.event_type AND c.i = a.i + 2 * m GROUP BY a.event_type, m, a.n""")
def allan_variance_factors(spark, sf):
    return rounded(series.allan_variance(table(spark, sf, "events"), "value", ["ts", "event_id"], 1.0, ["event_type"], [1, 4, 16, 64]), 4)


@query()
def lowess(spark, sf):
    return rounded(series.lowess(daily(spark, sf), "t", "v", 0.4, 2, 0.0, ["event_type"]), 8)


@query(f"""
WITH d AS (SELECT event_type, datediff('day', DATE '2024-01-01', d::DATE)::DOUBLE AS x, v AS y FROM ({_DAILY})), n AS (SELECT event_type, greatest(least(floor(0.4 * count(*)), count(*)), 2) AS near FROM d GROUP BY ALL),
p AS (SELECT a.event_type, a.x, a.y, b.x AS u, b.y AS v, abs(b.x - a.x) AS far, row_number() OVER (PARTITION BY a.event_type, a.x ORDER BY abs(b.x - a.x)) AS i FROM d a JOIN d b USING (event_type)),
h AS (SELECT event_type, x, max(far) AS h FROM p JOIN n USING (event_type) WHERE i <= near GROUP BY ALL),
w AS (SELECT p.*, CASE WHEN far <= 0.001 * h THEN 1.0 WHEN far <= 0.999 * h THEN (1 - (far / h) ** 3) ** 3 ELSE 0 END AS w FROM p JOIN h USING (event_type, x)),
s AS (SELECT event_type, x, y, sum(w * u) / sum(w) AS mu, sum(w * v) / sum(w) AS mv, sum(w * u * u) / sum(w) AS uu, sum(w * u * v) / sum(w) AS uv FROM w GROUP BY ALL),
r AS (SELECT event_type, x, y, mv + (x - mu) * (uv - mu * mv) / (uu - mu * mu) AS smoothed FROM s)
SELECT event_type, x, round(y, 6) AS y, round(smoothed, 6) AS smoothed, 1.0::DOUBLE AS weight, round(y - smoothed, 6) AS residual FROM r""")
def lowess_lines(spark, sf):
    """Without robustness steps."""
    return rounded(series.lowess(daily(spark, sf), "t", "v", 0.4, 0, 0.0, ["event_type"]), 6)


# --- interpolation ---
_KNOTS = f"SELECT event_type, datediff('day', DATE '2024-01-01', d::DATE)::DOUBLE AS x, v AS y FROM ({_DAILY})"
_AT = "SELECT event_id, event_type, epoch(ts - TIMESTAMP '2024-01-01') / 86400 AS x FROM events"


def at_time(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400 - 19723).alias("x"))


@query(f"""
WITH k AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS i FROM ({_KNOTS}) WINDOW w AS (PARTITION BY event_type ORDER BY x)), g AS (SELECT event_type, CASE WHEN i = 1 THEN -1e300 ELSE x END AS start, x AS x0, y AS y0, x1, y1 FROM k WHERE x1 IS NOT NULL)
SELECT e.event_id, round(y0 + (e.x - x0) / (x1 - x0) * (y1 - y0), 5) AS interpolated FROM ({_AT}) e ASOF JOIN g ON e.event_type = g.event_type AND e.x >= g.start""")
def interpolate_linear(spark, sf):
    return rounded(interp.linear(daily(spark, sf).select("event_type", "t", "v"), at_time(spark, sf), "t", "v", "x", ["event_type"]).select("event_id", "interpolated"), 5)


@query(f"""
WITH k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ({_KNOTS}) WINDOW w AS (PARTITION BY event_type ORDER BY x)), g AS (SELECT event_type, i, n, CASE WHEN i = 1 THEN -1e300 ELSE x END AS start FROM k WHERE i < n),
j AS (SELECT e.event_id, e.event_type, e.x, greatest(least(i - 1, n - 2), 1) AS f FROM ({_AT}) e ASOF JOIN g ON e.event_type = g.event_type AND e.x >= g.start)
SELECT event_id, round(a.y * (j.x - b.x) * (j.x - c.x) / ((a.x - b.x) * (a.x - c.x)) + b.y * (j.x - a.x) * (j.x - c.x) / ((b.x - a.x) * (b.x - c.x)) + c.y * (j.x - a.x) * (j.x - b.x) / ((c.x - a.x) * (c.x - b.x)), 4) AS interpolated
FROM j JOIN k a ON a.event_type = j.event_type AND a.i = f JOIN k b ON b.event_type = j.event_type AND b.i = f + 1 JOIN k c ON c.event_type = j.event_type AND c.i = f + 2""")
def interpolate_polynomial(spark, sf):
    return rounded(interp.polynomial(daily(spark, sf).select("event_type", "t", "v"), at_time(spark, sf), "t", "v", "x", 2, ["event_type"]).select("event_id", "interpolated"), 4)


@query(f"""
WITH RECURSIVE k AS (SELECT event_type, x, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s FROM ({_KNOTS}) WINDOW w AS (PARTITION BY event_type ORDER BY x)),
l AS (SELECT *, lag(h) OVER w AS g, lag(s) OVER w AS r FROM k WINDOW w AS (PARTITION BY event_type ORDER BY x)),
t AS (SELECT event_type, i, n, CASE WHEN i = 2 THEN 0 ELSE g / 6 END AS a, (g + h) / 3 + CASE WHEN i = 2 THEN g / 6 ELSE 0 END + CASE WHEN i = n - 1 THEN h / 6 ELSE 0 END AS b, CASE WHEN i = n - 1 THEN 0 ELSE h / 6 END AS c, s - r AS d FROM l WHERE i BETWEEN 2 AND n - 1),
f AS (SELECT event_type, i, n, c / b AS p, d / b AS q FROM t WHERE i = 2 UNION ALL SELECT t.event_type, t.i, t.n, t.c / (t.b - t.a * f.p), (t.d - t.a * f.q) / (t.b - t.a * f.p) FROM f JOIN t ON t.event_type = f.event_type AND t.i = f.i + 1),
u AS (SELECT event_type, i, n, q AS m FROM f WHERE i = n - 1 UNION ALL SELECT f.event_type, f.i, f.n, f.q - f.p * u.m FROM u JOIN f ON f.event_type = u.event_type AND f.i = u.i - 1),
m AS (SELECT event_type, i, m FROM u UNION ALL SELECT event_type, 1, m FROM u WHERE i = 2 UNION ALL SELECT event_type, n, m FROM u WHERE i = n - 1),
z AS (SELECT k.event_type, CASE WHEN k.i = 1 THEN -1e300 ELSE x END AS start, x AS x0, y AS c0, s - h * (2 * a.m + b.m) / 6 AS c1, a.m / 2 AS c2, (b.m - a.m) / (6 * h) AS c3 FROM k JOIN m a ON a.event_type = k.event_type AND a.i = k.i JOIN m b ON b.event_type = k.event_type AND b.i = k.i + 1)
SELECT e.event_id, round(c0 + (e.x - x0) * (c1 + (e.x - x0) * (c2 + (e.x - x0) * c3)), 4) AS interpolated FROM ({_AT}) e ASOF JOIN z ON e.event_type = z.event_type AND e.x >= z.start""")
def interpolate_spline(spark, sf):
    return rounded(interp.spline(daily(spark, sf).select("event_type", "t", "v"), at_time(spark, sf), "t", "v", "x", by=["event_type"]).select("event_id", "interpolated"), 4)


@query(f"""
WITH d AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS x, avg(value) AS y FROM events GROUP BY ALL), e AS (SELECT min(x) + 1 AS a, max(x) - 1 AS b FROM d),
k AS (SELECT a, b - a AS h, p.y AS y0, (p2.y - p1.y) / 2 AS d0, q.y AS y1, (q2.y - q1.y) / 2 AS d1 FROM e JOIN d p ON p.x = a JOIN d p1 ON p1.x = a - 1 JOIN d p2 ON p2.x = a + 1 JOIN d q ON q.x = b JOIN d q1 ON q1.x = b - 1 JOIN d q2 ON q2.x = b + 1),
t AS (SELECT event_id, (x - a) / h AS t, h, y0, d0, y1, d1 FROM ({_AT}), k)
SELECT event_id, round((1 + 2 * t) * (1 - t) ** 2 * y0 + t * (1 - t) ** 2 * h * d0 + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * d1, 5) AS interpolated,
round((6 * t * t - 6 * t) / h * (y0 - y1) + (3 * t * t - 4 * t + 1) * d0 + (3 * t * t - 2 * t) * d1, 5) AS derivative FROM t""")
def interpolate_hermite(spark, sf):
    """At the time of every event the cubic through daily means and their slopes near both ends of the time."""
    days = {r.x: r.y for r in table(spark, sf, "events").groupBy(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double").alias("x")).agg(F.avg("value").alias("y")).collect()}  # a row per day
    x = np.array([min(days) + 1, max(days) - 1])
    out = interp.hermite(at_time(spark, sf), "x", x, [days[k] for k in x], [(days[k + 1] - days[k - 1]) / 2 for k in x])
    return rounded(out.select("event_id", "interpolated", "derivative"), 5)


# --- Markov chains ---
@query()
def mcmc_regression(spark, sf):
    """A line through the prices of all rows by quantity, four chains. The likelihood is that of every row, from sums per quantity. Quantities are centred, so that the two parameters are nearly independent."""
    rows = mcmc.condense(table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y")), "l_quantity", "y").collect()  # one row per quantity, of which there are 50
    x, y, n, ss = (np.array([r[c] for r in rows], float) for c in ("x", "y", "n", "ss"))
    # weak priors around a flat line at the mean, where the chains start
    target = mcmc.Target(_line, [D.NormalDistribution(20.0, float(n @ y / n.sum())), D.NormalDistribution(2.0, 0.0)])
    return rounded(mcmc.summary(mcmc.burn_in(mcmc.sample(spark, x - 25.5, y, target, 4, 8000, mcmc.Proposal(scale=0.003), n=n, ss=ss), 0.5)), 8)


@query("""
WITH p(slope, v) AS (VALUES (1.5, 100.0), (1.4, 200.0), (0.0, 1.0)), r AS (SELECT slope, v, l_extendedprice / 1000 - 4 - slope * l_quantity AS r FROM lineitem, p)
SELECT slope::DOUBLE AS slope, v::DOUBLE AS variance, round(sum(-0.5 * (r * r / v + ln(2 * pi() * v))), 2) AS log_likelihood, round(exp(-0.5 * (4.0 / 20) ** 2) / (20 * sqrt(2 * pi())) * exp(-0.5 * ((slope - 1.5) / 2) ** 2) / (2 * sqrt(2 * pi())), 12) AS prior, round(exp(-0.5 * ln(v) ** 2) / (v * sqrt(2 * pi())), 12) AS variance_prior FROM r GROUP BY slope, v""")
def mcmc_likelihood(spark, sf):
    """What the sampler evaluates, for all rows: likelihood from sums per quantity, prior of the parameters, prior of the variance."""
    rows = mcmc.condense(table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y")), "l_quantity", "y").collect()  # one row per quantity, of which there are 50
    target = mcmc.Target(_line, [D.NormalDistribution(20.0, 0.0), D.NormalDistribution(2.0, 1.5)])
    x, y, n, ss = (np.array([r[c] for r in rows], float) for c in ("x", "y", "n", "ss"))
    of = [(b, v, target.log_likelihood(x, y, np.array([4.0, b]), v, n, ss), target.evaluate_prior([4.0, b]), float(target.evaluate_variance_prior(v))) for b, v in ((1.5, 100.0), (1.4, 200.0), (0.0, 1.0))]
    return rounded(spark.createDataFrame(of, "slope double, variance double, log_likelihood double, prior double, variance_prior double"), {"log_likelihood": 2, "prior": 12, "variance_prior": 12})


def _line(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[0] + p[1] * x


# --- extension ---
@query("SELECT event_type, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, round(stddev_samp(value), 6) AS standard_deviation FROM events GROUP BY ALL")
def windowed(spark, sf):
    return rounded(windowed_moments(table(spark, sf, "events"), "value", "ts", "1 day", "1 hour", ["event_type"]))
