"""Random sampling and the bootstrap, reproducible from counters.

Every uniform is a hash of (seed, stream, index): the same after a retry, a
repartitioning or on another cluster, and any SQL engine with md5 makes the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgumentError
from ..functions.distributions import Distribution, MultivariateNormalDistribution
from ..sources.shared import counted
from ..workers import importable
from .scan import PIECE_ROWS, ordered_scan


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) from the first 48 bits of the md5 of the parts, joined by |."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def standard_normal(*parts: Column | str | int) -> Column:
    """A standard normal number by the Box-Muller transform of two uniforms."""
    return F.sqrt(-2.0 * F.log(uniform(*parts, "a"))) * F.cos(2 * math.pi * uniform(*parts, "b"))


def box_muller_sample(spark: SparkSession, mu: float, sigma: float, n: int, seed: int = 0) -> DataFrame:
    """i, value: n normal numbers; no rows if n < 1."""
    return spark.range(max(n, 0)).select(F.col("id").alias("i"), (mu + sigma * standard_normal(seed, F.col("id"))).alias("value"))


def rejection_sample(spark: SparkSession, dist: Distribution, n: int, xmin: float, xmax: float, seed: int = 0, most_tries: int = 1000) -> DataFrame:
    """i, value: n draws from ``dist`` on [xmin, xmax] under a uniform envelope.

    The envelope's height comes from a grid; so does the share of candidates that
    are accepted, from which the number of candidates follows (``most_tries`` per
    draw at most). The accepted candidates with the least numbers are taken; if
    the most tries do not yield ``n`` of them, that is an error.
    """
    if n < 1:
        return spark.range(0).select(F.col("id").alias("i"), F.lit(0.0).alias("value"))
    if not xmax > xmin:
        raise InvalidArgumentError("xmax must be above xmin")
    grid = [dist.pdf(x) for x in np.linspace(xmin, xmax, 2049)]
    top = max(grid) * 1.02
    share = max(float(np.mean(grid)) / top, 1e-6)
    needed = n / share + 8 * math.sqrt(n) / share + 16
    tries = int(min(needed, n * most_tries))
    i = F.col("id")
    x = F.lit(float(xmin)) + (xmax - xmin) * uniform(seed, i, "x")
    got = spark.range(tries).select("id", x.alias("value")).filter(uniform(seed, i, "u") * top <= dist.pdf(F.col("value")))
    if tries < needed and got.limit(n).count() < n:
        raise InvalidArgumentError(f"{tries} candidates did not yield {n} draws: narrow the interval or allow more tries")
    return got.orderBy("id").limit(n).select(F.col("id").alias("i"), "value")


def sample_normal_multivariate(spark: SparkSession, dist: MultivariateNormalDistribution, n: int, seed: int = 0) -> DataFrame:
    """i, x0, x1, ...: mu + L u with standard normal u."""
    low, mu = dist.get_cholesky_factored_matrix(), dist.get_means()
    i = F.col("id")
    rows = spark.range(max(n, 0)).select(i, *[standard_normal(seed, i, j).alias(f"u{j}") for j in range(len(mu))])
    out = []
    for r in range(len(mu)):
        total = F.lit(float(mu[r]))
        for c in range(r + 1):
            total = total + F.lit(float(low[r, c])) * F.col(f"u{c}")
        out.append(total.alias(f"x{r}"))
    return rows.select(i.alias("i"), *out)


def _ranked(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """by, i (from 0, in the given order), v, n."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("v"))
    return ordered_scan(rows, [f"__o{i}" for i in range(len(order))], by, rank="__i", size="n", piece_rows=piece_rows).select(*by, (F.col("__i") - 1).alias("i"), "v", "n")


#: Draws in one row of work.
PIECE_DRAWS = 1 << 14


def _draws(groups: DataFrame, first: int, samples: int, piece: int = PIECE_DRAWS) -> DataFrame:
    """The rows of ``groups``, each for b from ``first`` and i from 0 to n - 1: pieces of draws are dealt evenly over the tasks before they become rows."""
    spark = groups.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pieces = groups.filter((F.col("n") > 0) & F.lit(samples > 0)).select("*", F.explode(F.sequence(F.lit(first), F.lit(max(first, first + samples - 1)))).alias("b"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(piece).cast("long"))).alias("__from"))
    upto = F.least(F.col("__from") + (piece - 1), F.col("n") - 1)
    return pieces.repartition(tasks).select("*", F.explode(F.sequence("__from", upto)).alias("i")).drop("__from")


def resample(df: DataFrame, value: str, order: Sequence[str], samples: int, by: Sequence[str] = (), seed: int = 0, first: int = 1) -> DataFrame:
    """by, b, i, v: ``samples`` resamples with replacement, numbered from ``first``. Draw i of resample b is row floor(u n) in ``order``.

    Draws are rows that are made all over the tasks from the sizes of the groups, and shuffled to the values on their
    places. Their number is not known to the planner, which would broadcast them.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.col(value)).alias("n"))
    draws = _draws(sizes, first, samples)
    draws = draws.withColumn("at", F.floor(uniform(seed, F.col("b"), F.col("i")) * F.col("n")).cast("long"))
    values = _ranked(df, value, order, by).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("i").alias("at"), "v").hint("shuffle_hash")
    return draws.join(values, [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], draws["at"] == values["at"]]).select(*by, "b", "i", "v")


def random_resample(df: DataFrame, value: str, samples: int, by: Sequence[str] = (), seed: int = 0, first: int = 1) -> DataFrame:
    """by, b, i, v: resamples of n normal draws with the mean and deviation of the group."""
    v = F.col(value).cast("double")
    s = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("s"))
    return _draws(s, first, samples).select(*by, "b", "i", (F.col("m") + F.col("s") * standard_normal(seed, F.col("b"), F.col("i"))).alias("v"))


#: Calls of a resampling routine in one row of work.
CALLS = 64
#: Rows whose weights one task draws at once.
BLOCK = 1 << 16
#: Statistics of the weighted rows of a block that merge: what is kept of each block, and the statistic from the merged sums n, s1 = sum (x - c), s2 = sum (x - c)^2 around a common centre c.
WEIGHTED = {
    "mean": lambda n, s1, s2, c: c + s1 / n,
    "sum": lambda n, s1, s2, c: n * c + s1,
    "variance": lambda n, s1, s2, c: (s2 - s1 * s1 / n) / F.nullif(n - 1, F.lit(0.0)),
    "standard_deviation": lambda n, s1, s2, c: F.sqrt(F.greatest((s2 - s1 * s1 / n) / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0))),
}


def _generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([k & (2**64 - 1) for k in key])))


#: Resamples whose draws are split at once.
CHUNK = 1024


def chunk_draws(n: int, block: int, size: int, seed: int, chunk: int) -> np.ndarray:
    """How many of the ``n`` draws of each resample of a chunk fall into a block of ``size`` rows: the draws are split between halves of the blocks by binomial numbers, from the whole down to this block. Every task finds the same splits from the seed alone."""
    lo, hi, draws = 0, -(-n // size), np.full(CHUNK, n, np.int64)
    node = 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rows, left = min(hi * size, n) - lo * size, min(mid * size, n) - lo * size
        k = _generator(seed, chunk, node).binomial(draws, left / rows)
        lo, hi, draws, node = (lo, mid, k, 2 * node) if block < mid else (mid, hi, draws - k, 2 * node + 1)
    return draws


def block_draws(n: int, block: int, size: int, seed: int, b: int) -> int:
    """:func:`chunk_draws` of one resample."""
    return int(chunk_draws(n, block, size, seed, b // CHUNK)[b % CHUNK])


def _weighted(part: pd.DataFrame, first: int, last: int, seed: int, block: int) -> np.ndarray:
    """b, draws, sum and sum of squares of the deviations from the group's mean, per resample, of one block of rows in their order."""
    d = part["v"].to_numpy() - part["c"].to_numpy()
    both = np.stack([d, d * d])
    n, at = int(part["n"].iloc[0]), int(part["block"].iloc[0])
    kind = np.uint16 if len(d) <= 1 << 16 else np.int64
    out = np.empty((last - first + 1, 4))
    for i, b in enumerate(range(first, last + 1)):
        if i == 0 or b % CHUNK == 0:
            draws = chunk_draws(n, at, block, seed, b // CHUNK)
        w = np.bincount(_generator(seed, b, at, 7).integers(0, len(d), draws[b % CHUNK], dtype=kind), minlength=len(d))
        out[i] = b, draws[b % CHUNK], *(both @ w.astype(float))
    return out


def multinomial_population(df: DataFrame, value: str, statistic: str, order: Sequence[str], samples: int, by: Sequence[str] = (), seed: int = 0, first: int = 2, block: int = BLOCK, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """by, b, statistic of ``samples`` resamples with replacement, without a row per draw.

    Rows are numbered in ``order`` and cut into blocks. How many draws a block
    gets follows from the seed (:func:`chunk_draws`); within a block each row gets
    a weight, and a weighted statistic is a few sums. Only these, samples times
    blocks of them, are shuffled. The result depends on seed, order and ``block``, not
    on the partitioning. Nulls are left out.
    """
    if statistic not in WEIGHTED:
        raise InvalidArgumentError(f"statistics of weighted rows are {', '.join(WEIGHTED)}")
    by = list(by)
    ranked = _ranked(df, value, order, by, piece_rows)
    mean = counted(ranked.groupBy(*by).agg(F.avg("v").alias("c")).select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "c"))
    rows = ranked.join(mean, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]) if by else ranked.crossJoin(mean)
    rows = rows.select(*by, "i", "v", "n", "c", F.floor(F.col("i") / block).alias("block"))
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("b", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("draws", "s1", "s2", "c")]])
    last = first + samples - 1

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i", kind="stable")
        got = _weighted(part, first, last, seed, block)
        out = part.iloc[np.zeros(len(got), int)][by].reset_index(drop=True)
        out["b"], out["draws"], out["s1"], out["s2"], out["c"] = got[:, 0].astype(np.int32), got[:, 1], got[:, 2], got[:, 3], float(part["c"].iloc[0])
        return out

    sums = importable(rows).groupBy(*by, "block").applyInPandas(one, schema)
    s = sums.groupBy(*by, "b").agg(F.sum("draws").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.first("c").alias("c"))
    return s.select(*by, "b", WEIGHTED[statistic](F.col("n"), F.col("s1"), F.col("s2"), F.col("c")).alias("statistic"))


STATISTICS: dict[str, Callable[[str], Column]] = {"mean": F.avg, "variance": F.var_samp, "standard_deviation": F.stddev_samp, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}


def bootstrap_population(df: DataFrame, value: str, statistic: str | Callable, order: Sequence[str] = (), samples: int = 10_000, method: str | Callable = "random", by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """by, b, statistic: b = 1 is the observed one, b = 2..samples are of resamples.

    ``statistic`` is the name of an aggregate or a function of a numpy array,
    which then runs per (group, b) in Arrow batches. ``method`` is random (normal
    draws), replacement (a row per draw), multinomial (weights per row, for large
    data; see :func:`multinomial_population`) or a function ``(values, rng)`` that
    returns a resample of a group's values, which then runs per (group, b).
    """
    if not callable(method) and method not in ("random", "replacement", "multinomial"):
        raise InvalidArgumentError("method is random, replacement, multinomial or a function of values and a generator")
    by = list(by)
    if callable(method):
        return _callback_population(df, value, statistic, order or [value], samples, method, by, seed)
    if method == "multinomial":
        v = F.col(value).cast("double")
        seen = df.groupBy(*by).agg(STATISTICS[statistic](v).cast("double").alias("statistic"), F.count(v).alias("__n")).filter("__n > 0").select(*by, F.lit(1).alias("b"), "statistic")
        return seen.unionByName(multinomial_population(df, value, statistic, order or [value], samples - 1, by, seed))
    seen = df.filter(F.col(value).isNotNull()).select(*by, F.lit(1).alias("b"), F.col(value).cast("double").alias("v"))
    more = (random_resample(df, value, samples - 1, by, seed, 2) if method == "random" else resample(df, value, order or [value], samples - 1, by, seed, 2)).select(*by, "b", "v")
    rows = seen.unionByName(more)
    if isinstance(statistic, str):
        return rows.groupBy(*by, "b").agg(STATISTICS[statistic]("v").cast("double").alias("statistic"))
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("b", T.IntegerType()), T.StructField("statistic", T.DoubleType())])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        out = part[[*by, "b"]].head(1).copy()
        out["statistic"] = float(statistic(part["v"].to_numpy()))
        return out

    return importable(rows).groupBy(*by, "b").applyInPandas(one, schema)


def _callback_population(df: DataFrame, value: str, statistic: str | Callable, order: Sequence[str], samples: int, method: Callable, by: list[str], seed: int) -> DataFrame:
    """Resamples by the caller's routine. A group's values, in order, are one array; its resamples are dealt out in blocks of CALLS, each seeded by its number."""
    of = {"mean": np.mean, "variance": lambda x: np.var(x, ddof=1), "standard_deviation": lambda x: np.std(x, ddof=1), "median": np.median, "min": np.min, "max": np.max, "sum": np.sum}
    run = statistic if callable(statistic) else of[statistic]
    ranked = _ranked(df, value, order, by)
    arrays = ranked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("x"))
    calls = arrays.select(*by, "x", F.explode(F.sequence(F.lit(1), F.lit(samples), F.lit(CALLS))).alias("from")).repartition(*by, "from")
    schema = T.StructType([*[arrays.schema[c] for c in by], T.StructField("b", T.IntegerType()), T.StructField("statistic", T.DoubleType())])

    def each(parts):
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                x = np.asarray(row["x"], float)
                for b in range(row["from"], min(row["from"] + CALLS, samples + 1)):
                    rows.append([*[row[c] for c in by], b, float(run(x if b == 1 else np.asarray(method(x.copy(), _generator(seed, b)), float)))])
            yield pd.DataFrame(rows, columns=[*by, "b", "statistic"])

    return importable(calls).mapInPandas(each, schema)


def bootstrap(df: DataFrame, value: str, statistic: str | Callable = "mean", order: Sequence[str] = (), samples: int = 10_000, method: str | Callable = "random", alpha: float = 0.05, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """by, statistic, bias, standard_error, lower, upper: the interval's ends are the elements floor(alpha n / 2) (at least 1) and n - floor(alpha n / 2) + 1 (at most n) of the sorted population."""
    pop = bootstrap_population(df, value, statistic, order, samples, method, by, seed)
    i = max(1, math.floor(alpha * samples / 2))
    j = min(samples, samples - math.floor(alpha * samples / 2) + 1)
    s = pop.groupBy(*by).agg(F.max(F.when(F.col("b") == 1, F.col("statistic"))).alias("statistic"), F.avg("statistic").alias("__m"), F.stddev_samp("statistic").alias("standard_error"), F.sort_array(F.collect_list("statistic")).alias("__p"))
    at = lambda k: F.element_at("__p", F.least(F.lit(k), F.size("__p")))
    return s.select(*by, "statistic", (F.col("__m") - F.col("statistic")).alias("bias"), "standard_error", at(i).alias("lower"), at(j).alias("upper"))
