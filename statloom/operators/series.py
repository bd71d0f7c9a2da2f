"""Ordered series: differences, Allan variance and LOWESS."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgumentError
from ..sources.shared import written
from ..workers import importable
from .scan import PIECE_ROWS, ordered_scan


#: Starts, and factors, in a tile of Allan variances.
TILE = 2048


def difference(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), piece_rows: int = PIECE_ROWS) -> DataFrame:
    """by, order, difference: the next value minus this one; the last row of a series is dropped. A long series is scanned in pieces."""
    rows = df.select(*[F.col(c) for c in dict.fromkeys([*by, *order])], F.col(value).alias("__v"))
    out = ordered_scan(rows, order, by, after={"__next": F.col("__v"), "__more": F.lit(1)}, piece_rows=piece_rows)
    return out.filter("__more = 1").select(*by, *order, (F.col("__next") - F.col("__v")).alias("difference"))


def allan_variance(df: DataFrame, value: str, order: Sequence[str], dt: float = 1.0, by: Sequence[str] = (), factors: Sequence[int] | None = None, piece_rows: int = PIECE_ROWS, block: int = TILE) -> DataFrame:
    """by, m, tau, allan_variance: fully overlapped, for m = 1..floor(n / 2) - 1, or for ``factors`` only.

    With prefix sums S the term of a start j is (S[j + 2m] - 2 S[j + m] + S[j]) / m.
    All m of a series are n^2 / 4 terms: they are dealt out in tiles of ``block``
    starts by ``block`` factors, each with the at most six blocks of prefix sums that it
    needs. With a few ``factors`` the prefix sums are rows, joined on their places.
    No series has to fit in a task either way.
    """
    if factors is not None and any(m < 1 for m in factors):
        raise InvalidArgumentError("averaging factors are at least 1")
    by = list(by)
    line = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    rows = df.filter(F.col(value).isNotNull()).select(*by, *line, F.col(value).cast("double").alias("__v"))
    rows = ordered_scan(rows, [f"__o{i}" for i in range(len(order))], by, rank="i", size="n", running={"s": F.col("__v")}, piece_rows=piece_rows).select(*by, "i", "s", "n")
    if factors is None:
        return _all_factors(rows, dt, by, block)
    zero = rows.select(*by, "n").distinct().select(*by, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s"), "n")
    every = rows.unionByName(zero)
    # each prefix sum is sent to the three terms in which it takes part
    m = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in factors])).alias("m")
    sent = every.select(*by, "i", "s", "n", m).select(*by, "m", "n", F.explode(F.array(*[F.struct((F.col("i") - k * F.col("m")).alias("j"), (F.col("s") * c).alias("part")) for k, c in ((0, 1.0), (1, -2.0), (2, 1.0))])).alias("t"))
    sent = sent.filter((F.col("t.j") >= 0) & (F.col("t.j") + 2 * F.col("m") <= F.col("n")))
    one = sent.groupBy(*by, "m", "n", F.col("t.j").alias("j")).agg(F.sum("t.part").alias("d"))
    return one.groupBy(*by, "m", "n").agg(F.sum(F.col("d") * F.col("d")).alias("q")).select(*by, F.col("m").cast("int").alias("m"), (F.col("m") * dt).alias("tau"), (F.col("q") / (2.0 * (F.col("n") - 2 * F.col("m") + 1) * F.col("m") * F.col("m"))).alias("allan_variance"))


def _tile(near: np.ndarray, mid: np.ndarray, far: np.ndarray, j0: int, m0: int, n: int, block: int) -> np.ndarray:
    """For the factors m0 + 1 .. m0 + block the sums of squared terms over the starts j0 .. j0 + block - 1. ``mid`` holds the prefix sums from j0 + m0 on, ``far`` those from j0 + 2 m0 on."""
    out = np.zeros(block)
    for k in range(1, block + 1):
        m = m0 + k
        count = min(block, n - 2 * m - j0 + 1)
        if m > n // 2 - 1 or count < 1:
            break
        d = far[2 * k : 2 * k + count] - 2 * mid[k : k + count] + near[:count]
        out[k - 1] = d @ d
    return out


def _all_factors(rows: DataFrame, dt: float, by: list[str], block: int) -> DataFrame:
    """Every factor of every series from ``rows`` of by, i, s (the sum of the first i values) and n."""
    keys = [f"__by{i}" for i in range(len(by))]
    rows = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], "i", "s", "n").filter("n >= 4")
    rows = rows.select(*keys, F.floor(F.col("i") / block).alias("block"), "i", "s", "n")
    # a series' first prefix sum is 0; a block is an array of at most ``block`` sums
    blocks = written(rows.groupBy(*keys, "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("a"), F.first("n").alias("n")))
    blocks = blocks.withColumn("a", F.when(F.col("block") == 0, F.concat(F.array(F.lit(0.0)), "a")).otherwise(F.col("a")))
    series = blocks.groupBy(*keys).agg(F.first("n").alias("n"))
    most = F.greatest(F.floor(F.col("n") / 2) - 1, F.lit(1))
    tiles = series.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((most - 1) / block))).alias("fm"))
    tiles = tiles.select(*keys, "n", "fm", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2 * (F.col("fm") * block + 1)) / block))).alias("fj"))
    need = F.array_distinct(F.array(*[F.col("fj") + a * F.col("fm") + b for a, b in ((0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2))]))
    asked = tiles.select(*[F.col(k).alias(f"{k}_") for k in keys], "fm", "fj", F.explode(need).alias("needed"))
    met = asked.join(blocks, [*[F.col(f"{k}_").eqNullSafe(F.col(k)) for k in keys], F.col("needed") == F.col("block")])
    tile = met.groupBy(*keys, "fm", "fj").agg(F.first("n").alias("n"), F.collect_list(F.struct("block", "a")).alias("blocks"))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("m", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("q", T.DoubleType())])

    def solve(parts):
        for part in parts:
            out = [pd.DataFrame({c: [] for c in [*keys, "m", "n", "q"]})]
            for row in part.to_dict("records"):
                at = {x["block"]: np.asarray(x["a"], float) for x in row["blocks"]}
                j, m, n = int(row["fj"]), int(row["fm"]), int(row["n"])
                held = lambda first, k: np.concatenate([at.get(first + i, np.empty(0)) for i in range(k)])  # noqa: E731, B023
                q = _tile(held(j, 1), held(j + m, 2), held(j + 2 * m, 3), j * block, m * block, n, block)
                last = min(block, n // 2 - 1 - m * block)
                out.append(pd.DataFrame({**{k: [row[k]] * last for k in keys}, "m": np.arange(m * block + 1, m * block + last + 1, dtype=np.int32), "n": n, "q": q[:last]}))
            yield pd.concat(out[1:] or out, ignore_index=True)

    sums = importable(tile).mapInPandas(solve, schema).groupBy(*keys, "m", "n").agg(F.sum("q").alias("q"))
    return sums.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "m", (F.col("m") * dt).alias("tau"), (F.col("q") / (2.0 * (F.col("n") - 2 * F.col("m") + 1) * F.col("m") * F.col("m"))).alias("allan_variance"))


#: Below the first share of a bandwidth a weight is 1, above the second 0; the first is also the least spread, as a share of the range, for which a line is fitted.
NEAR_SHARE, FAR_SHARE = 0.001, 0.999
#: Pairs of an anchor and a point that are weighted at once.
PAIRS = 1 << 20


def _anchors(x: np.ndarray, delta: float) -> np.ndarray:
    """Places among distinct values at which lines are fitted: all, or each the last within ``delta`` of the one before."""
    if delta <= 0:
        return np.arange(len(x))
    reach = np.maximum(np.searchsorted(x, x + delta, side="right") - 1, np.arange(len(x)) + 1)
    out = [0]
    while out[-1] < len(x) - 1:
        out.append(min(int(reach[out[-1]]), len(x) - 1))
    return np.array(out)


def _lines(x: np.ndarray, y: np.ndarray, at: np.ndarray, width: np.ndarray, robust: np.ndarray) -> np.ndarray:
    """Values at ``at`` of lines through the points within ``width``, weighted by tricube and ``robust``; nan where no weight is left."""
    low = np.searchsorted(x, at - FAR_SHARE * width, side="left")
    count = np.searchsorted(x, at + FAR_SHARE * width, side="right") - low
    out = np.empty(len(at))
    edges = np.searchsorted(np.cumsum(count), np.arange(PAIRS, count.sum() + PAIRS, PAIRS)) + 1
    for some in np.split(np.arange(len(at)), np.unique(edges[edges < len(at)])):
        c = count[some]
        who = np.repeat(np.arange(len(some)), c)
        point = np.arange(len(who)) + np.repeat(low[some] - (np.cumsum(c) - c), c)
        h = width[some][who]
        share = np.abs(x[point] - at[some][who]) / np.where(h > 0, h, 1)
        w = np.where(share <= NEAR_SHARE, 1.0, (1 - np.minimum(share, 1) ** 3) ** 3) * robust[point]
        add = lambda v: np.bincount(who, v, len(some))
        with np.errstate(invalid="ignore", divide="ignore"):
            total = add(w)
            mid = add(w * x[point]) / total
            off = x[point] - mid[who]
            spread = add(w * off * off) / total
            slope = np.where(np.sqrt(spread) > NEAR_SHARE * (x[-1] - x[0]), add(w * off * y[point]) / total / spread, 0.0)
            out[some] = add(w * y[point]) / total + slope * (at[some] - mid)
    return out


def lowess_arrays(x: np.ndarray, y: np.ndarray, fraction: float = 0.2, steps: int = 2, delta: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed values, robustness weights and residuals of one series with increasing x (Cleveland's locally weighted regression).

    Equal x have one value. The bandwidth of a point is the distance to the
    farthest of its nearest neighbours; as sums x[i] + x[i + near] grow with i, one
    sorted search finds the neighbours of all points.
    """
    n = len(x)
    weight = np.ones(n)
    if n < 2:
        return y.copy(), weight, np.zeros(n)
    near = max(min(int(fraction * n), n), 2)
    value, first, back = np.unique(x, return_index=True, return_inverse=True)
    anchors = _anchors(value, delta)
    at = value[anchors]
    left = np.searchsorted(x[: n - near] + x[near:], 2 * at)
    width = np.maximum(at - x[left], x[left + near - 1] - at)
    for step in range(steps + 1):
        got = _lines(x, y, at, width, weight)
        fit = np.interp(value, at, np.where(np.isnan(got), y[first[anchors]], got))[back]
        if step < steps:
            size = np.abs(y - fit)
            six = 6 * np.median(size)
            share = size / (six if six > 0 else 1)
            weight = np.where(share <= NEAR_SHARE, 1.0, np.where(share > FAR_SHARE, 0.0, (1 - np.minimum(share, 1) ** 2) ** 2))
            if six == 0:
                weight = np.where(size > 0, 0.0, 1.0)
    return fit, weight, y - fit


def lowess(df: DataFrame, x: str, y: str, fraction: float = 0.2, steps: int = 2, delta: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """by, x, y, smoothed, weight, residual (y - smoothed). A series runs as a whole in one task, in order of x; many series run side by side."""
    by = list(by)
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    names = [*by, "x", "y", "smoothed", "weight", "residual"]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["x", "y"], kind="stable")
        part["smoothed"], part["weight"], part["residual"] = lowess_arrays(part["x"].to_numpy(), part["y"].to_numpy(), fraction, steps, delta)
        return part[names]

    schema = T.StructType([*rows.schema, *[T.StructField(c, T.DoubleType()) for c in names[-3:]]])
    return importable(rows).groupBy(*by).applyInPandas(one, schema)
