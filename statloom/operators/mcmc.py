"""Markov-chain Monte Carlo regression by Metropolis-Hastings, chains side by side."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArraySizeError, InvalidArgumentError
from ..functions.distributions import Distribution, LogNormalDistribution
from ..workers import importable


def condense(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """by, x, y (mean), n, ss (squared deviations from the mean): all that a normal likelihood needs of the rows, one row per distinct x. Rows with a null are left out."""
    v = F.col(y).cast("double")
    rows = df.filter(F.col(x).isNotNull() & v.isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x"))
    return rows.agg(F.avg(v).alias("y"), F.count(v).alias("n"), (F.var_pop(v) * F.count(v)).alias("ss")).orderBy(*by, "x")


def squared_residuals(r: np.ndarray, n: np.ndarray | None = None, ss: np.ndarray | None = None) -> tuple[float, float]:
    """Sum of squares and number of the residuals that points with residuals ``r`` stand for."""
    if any(a is not None and len(a) != len(r) for a in (n, ss)):
        raise ArraySizeError("as many counts and sums of squares as points")
    n = np.ones(len(r)) if n is None else np.asarray(n, float)
    return float(n @ (r * r) + (0.0 if ss is None else np.sum(ss))), float(n.sum())


@dataclass
class Target:
    """The model, the priors of its parameters and the noise of the variance's log-normal prior."""

    model: Callable[[np.ndarray, np.ndarray], np.ndarray]
    priors: list[Distribution] = field(default_factory=list)
    data_noise: float = 1.0

    def add_parameter(self, prior: Distribution) -> None:
        self.priors.append(prior)

    def get_parameter(self, i: int) -> Distribution:
        return self.priors[i]

    def get_parameter_count(self) -> int:
        return len(self.priors)

    def log_likelihood(self, x: np.ndarray, y: np.ndarray, params: np.ndarray, variance: float, n: np.ndarray | None = None, ss: np.ndarray | None = None) -> float:
        """Sum of the logarithms of normal densities of the residuals; a variance of 0 counts as 1.

        With ``n`` and ``ss`` each point stands for n values with mean y whose squared
        deviations from it add up to ss (see :func:`condense`); the sum is over all of them.
        """
        if len(x) != len(y) or len(params) != len(self.priors):
            raise ArraySizeError("arrays of other sizes than expected")
        variance = variance or 1.0
        r = np.asarray(y, float) - self.model(np.asarray(x, float), np.asarray(params, float))
        squares, count = squared_residuals(r, n, ss)
        return float(-0.5 * (squares / variance + count * math.log(2 * math.pi * variance)))

    def likelihood(self, x, y, params, variance: float, n=None, ss=None) -> float:
        return math.exp(self.log_likelihood(x, y, params, variance, n, ss))

    def evaluate_variance_prior(self, variance: float) -> float:
        return LogNormalDistribution(self.data_noise, 0.0).pdf(variance)

    def evaluate_prior(self, params) -> float:
        return math.exp(self.log_prior(params))

    def log_prior(self, params) -> float:
        if len(params) != len(self.priors):
            raise ArraySizeError("as many parameters as priors")
        p = [d.pdf(float(v)) for d, v in zip(self.priors, params, strict=True)]
        return sum(map(math.log, p)) if all(v > 0 for v in p) else -math.inf

    def sample_variance_prior(self, variance: float, n: int, rng: np.random.Generator) -> np.ndarray:
        """Log-normal draws around a variance, of those inside [6e-6, 6] deviations only (a deviation of 0 counts as 1)."""
        d, mid = self.data_noise or 1.0, math.log(max(variance, 1e-300))
        normal = NormalDist(mid, d)
        low, high = math.log(6e-6 * d), math.log(6 * d)
        share = rng.uniform(normal.cdf(low), normal.cdf(high), n)
        return np.exp([min(max(normal.inv_cdf(u), low), high) if 0 < u < 1 else low if u <= 0 else high for u in share])


@dataclass(frozen=True)
class Proposal:
    """Normal steps of ``scale`` prior deviations around the current values, or draws around the prior's mean if ``recenter`` is off; both inside mean +- 6 deviations and the prior's range."""

    recenter: bool = True
    scale: float = 0.1

    def limits(self, d: Distribution) -> tuple[float, float, float, float]:
        m, s = float(d.mean()), math.sqrt(float(d.variance()))
        lo, hi = d.defined_range()
        return m, s, max(lo, m - 6 * s), min(hi, m + 6 * s)

    def draw(self, d: Distribution, now: float, rng: np.random.Generator) -> float | None:
        """A new value, or None if it falls outside (a symmetric step that is refused)."""
        m, s, lo, hi = self.limits(d)
        v = (now + self.scale * s * rng.standard_normal()) if self.recenter else (m + s * rng.standard_normal())
        return float(v) if lo <= v <= hi else None

    def log_density(self, d: Distribution, v: float) -> float:
        """Of an independent draw; steps are symmetric and need none."""
        if self.recenter:
            return 0.0
        m, s, _, _ = self.limits(d)
        return -0.5 * ((v - m) / s) ** 2


class ChainBuilder:
    """A growing chain of states."""

    def __init__(self, variables: int) -> None:
        self.variables, self.rows = variables, []

    def push_new_state(self, state) -> None:
        if len(state) != self.variables:
            raise ArraySizeError("a state of another size")
        self.rows.append(np.array(state, float))

    def get_chain_length(self) -> int:
        return len(self.rows)

    def get_state_variable_count(self) -> int:
        return self.variables

    def get_chain(self, burn: float = 0.0) -> np.ndarray:
        """The chain without its first floor(burn n) states."""
        if not 0 <= burn < 1:
            raise InvalidArgumentError("the share to drop is in [0, 1)")
        return np.array(self.rows[math.floor(burn * len(self.rows)) :]).reshape(-1, self.variables)

    def reset(self) -> None:
        self.rows.clear()


def run_chain(x: np.ndarray, y: np.ndarray, target: Target, proposal: Proposal, iterations: int, rng: np.random.Generator, on_acceptance: Callable | None = None, on_rejection: Callable | None = None, n: np.ndarray | None = None, ss: np.ndarray | None = None) -> tuple[ChainBuilder, np.ndarray]:
    """States (parameters, variance) of one chain, the start first, and which moves were accepted. ``n`` and ``ss`` as in :meth:`Target.log_likelihood`."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    p = np.array([float(d.mean()) for d in target.priors])
    r = y - target.model(x, p)
    squares, count = squared_residuals(r, n, ss)
    var = max(squares / max(1.0, count), 1e-12)
    noise = LogNormalDistribution(target.data_noise, math.log(var))

    def posterior(q: np.ndarray, v: float) -> float:
        return target.log_likelihood(x, y, q, v, n, ss) + target.log_prior(q) + math.log(max(noise.pdf(v), 1e-300))

    jump = min(0.2, 2.4 * math.sqrt(2 / max(1.0, count)))  # log(variance) has about sqrt(2 / count) of width
    chain, moves, now = ChainBuilder(len(p) + 1), np.zeros(iterations, bool), posterior(p, var)
    chain.push_new_state([*p, var])
    for i in range(1, iterations):
        q = [proposal.draw(d, float(v), rng) for d, v in zip(target.priors, p, strict=True)]
        v = var * math.exp(jump * rng.standard_normal())
        u = rng.random()
        if all(z is not None for z in q):
            q = np.array(q, float)
            new = posterior(q, v)
            back = sum(proposal.log_density(d, float(a)) - proposal.log_density(d, float(b)) for d, a, b in zip(target.priors, p, q, strict=True))
            # the step in log(variance) is symmetric: the change of variable is v / var
            moves[i] = math.log(max(u, 1e-300)) < new - now + back + math.log(v / var)
        if moves[i]:
            if on_acceptance is not None:
                on_acceptance(i, p, q)
            p, var, now = q, v, new
        elif on_rejection is not None:
            on_rejection(i, p)
        chain.push_new_state([*p, var])
    return chain, moves


def sample(spark: SparkSession, x, y, target: Target, chains: int = 4, iterations: int = 10_000, proposal: Proposal | None = None, seed: int = 0, n=None, ss=None, on_acceptance: Callable | None = None, on_rejection: Callable | None = None) -> DataFrame:
    """chain, iter (from 1), params, variance, accepted. Chains are the parallel axis, each seeded by (seed, chain).

    The data go to each task, so they are meant to be small: give the sums of :func:`condense`
    (``n``, ``ss``) for large tables. The hooks of :func:`run_chain` are called in the tasks.
    """
    x, y, proposal = np.asarray(x, float), np.asarray(y, float), proposal or Proposal()
    schema = T.StructType([T.StructField("chain", T.LongType()), T.StructField("iter", T.IntegerType()), T.StructField("params", T.ArrayType(T.DoubleType())), T.StructField("variance", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for c in part["id"]:
                chain, moves = run_chain(x, y, target, proposal, iterations, np.random.default_rng([seed, int(c)]), on_acceptance, on_rejection, n, ss)
                s = chain.get_chain()
                yield pd.DataFrame({"chain": int(c), "iter": np.arange(1, iterations + 1, dtype=np.int32), "params": list(s[:, :-1]), "variance": s[:, -1], "accepted": moves})

    return importable(spark).range(0, chains, 1, chains).mapInPandas(run, schema)


def burn_in(chains: DataFrame, share: float) -> DataFrame:
    """The chains without their first floor(share n) states."""
    if not 0 <= share < 1:
        raise InvalidArgumentError("the share to drop is in [0, 1)")
    n = chains.groupBy("chain").agg(F.max("iter").alias("__n"))
    return chains.join(n, "chain").filter(F.col("iter") > F.floor(F.col("__n") * share)).drop("__n")


def summary(chains: DataFrame) -> DataFrame:
    """chain, parameter, mean, standard_deviation, acceptance_rate."""
    each = chains.select("chain", "accepted", F.posexplode("params").alias("parameter", "v"))
    return each.groupBy("chain", "parameter").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("standard_deviation"), (F.sum(F.col("accepted").cast("int")) / (F.count(F.lit(1)) - 1)).alias("acceptance_rate"))
