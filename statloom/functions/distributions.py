"""Probability distributions. Parameters and arguments may be numbers or columns.

``pdf``, ``cdf``, ``sf`` (upper tail) and ``ppf`` take a number, an array or a column
and return the same kind; if a parameter is a column, so is the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArraySizeError, MatrixSizeError, UninitializedObjectError
from . import kernel as K
from .kernel import Number, of

HUGE = 1.7976931348623157e308


class Distribution:
    """What all one-dimensional distributions share."""

    def pdf(self, x: Number):
        raise NotImplementedError

    def cdf(self, x: Number):
        raise NotImplementedError

    def sf(self, x: Number):
        return 1 - self.cdf(x)

    def mean(self):
        raise NotImplementedError

    def median(self):
        raise NotImplementedError

    def mode(self):
        raise NotImplementedError

    def variance(self):
        raise NotImplementedError

    def recenter(self, x: Number) -> Distribution:
        """The distribution moved to ``x``, where it can be moved."""
        return self

    def defined_range(self) -> tuple[float, float]:
        return -HUGE, HUGE

    def ppf(self, p: Number):
        """Inverse of the cdf, by halving; the ends of the range at 0 and 1, nan outside. As given here for distributions of positive numbers."""
        k = of(p, *vars(self).values())
        if k is K.COL:
            return self._by_arrow("ppf", p)
        return self._ends(p, K.invert_positive(k, self.cdf, self.sf, p, self._most()))

    def _by_arrow(self, method: str, x: Number):
        """A method of columns, by this family's same method of arrays."""
        family = type(self)
        return K.by_arrow(lambda x, *params: getattr(family(*params), method)(x), x, *vars(self).values())

    def _most(self) -> Number | None:
        """A number that quantiles are known to be below, where the cdf costs more the larger its argument is."""
        return None

    def _ends(self, p: Number, inside: Number):
        """``inside``, but for p that are not between 0 and 1."""
        low = 0.0 if self.defined_range()[0] == 0 else -math.inf
        if of(p, inside) is K.NUM:
            return inside if 0 < p < 1 else low if p == 0 else math.inf if p == 1 else math.nan
        return np.where((p > 0) & (p < 1), inside, np.where(p == 0, low, np.where(p == 1, math.inf, math.nan)))

    def _two_sided(self, p: Number, tail, *params: Number):
        """Quantile of a distribution that is symmetric around 0, from its upper tail."""
        k = of(p, *params)
        x = K.invert_tail(k, tail, k.minimum(p, 1 - p))
        return self._ends(p, k.where(p > 0.5, x, k.where(p < 0.5, -x, 0.0)))

    standardized_variable = ppf


@dataclass(frozen=True)
class TDistribution(Distribution):
    dof: Number

    def pdf(self, x):
        k, v = of(self.dof, x), self.dof
        if k is K.COL:
            return self._by_arrow("pdf", x)
        return k.exp(k.lgamma((v + 1) / 2) - k.lgamma(v / 2) - 0.5 * k.log(v * math.pi) - (v + 1) / 2 * k.log(1 + x * x / v))

    def cdf(self, x):
        k = of(self.dof, x)
        tail = 0.5 * K.two_sided_t(x, self.dof)
        return k.where(x > 0, 1 - tail, tail)

    def sf(self, x):
        k = of(self.dof, x)
        tail = 0.5 * K.two_sided_t(x, self.dof)
        return k.where(x > 0, tail, 1 - tail)

    def ppf(self, p):
        if of(p, self.dof) is K.COL:
            return self._by_arrow("ppf", p)
        return self._two_sided(p, lambda x: 0.5 * K.two_sided_t(x, self.dof), self.dof)

    standardized_variable = ppf

    def mean(self):
        k = of(self.dof)
        return k.where(self.dof < 1, math.nan, 0.0)

    def median(self):
        return 0.0

    def mode(self):
        return 0.0

    def variance(self):
        k, v = of(self.dof), self.dof
        return k.where(v <= 1, math.nan, k.where(v <= 2, math.inf, v / k.where(v <= 2, 1.0, v - 2)))


@dataclass(frozen=True)
class NormalDistribution(Distribution):
    standard_deviation: Number = 1.0
    mean_value: Number = 0.0

    @staticmethod
    def standardize() -> NormalDistribution:
        return NormalDistribution(1.0, 0.0)

    def pdf(self, x):
        k = of(self.standard_deviation, self.mean_value, x)
        z = (x - self.mean_value) / self.standard_deviation
        return k.exp(-0.5 * z * z) / (self.standard_deviation * math.sqrt(2 * math.pi))

    def cdf(self, x):
        return K.normal_cdf((x - self.mean_value) / self.standard_deviation)

    def sf(self, x):
        return K.normal_cdf((self.mean_value - x) / self.standard_deviation)

    def mean(self):
        return self.mean_value

    def median(self):
        return self.mean_value

    def mode(self):
        return self.mean_value

    def variance(self):
        return self.standard_deviation * self.standard_deviation

    def recenter(self, x):
        return NormalDistribution(self.standard_deviation, x)

    def ppf(self, p):
        z = NormalDistribution()._by_arrow("ppf", p) if isinstance(p, Column) else NormalDistribution._standard(p)
        return self.mean_value + self.standard_deviation * z

    @staticmethod
    def _standard(p):
        return NormalDistribution()._two_sided(p, lambda x: 0.5 * K.gamma_q(0.5, x * x / 2))

    standardized_variable = ppf


@dataclass(frozen=True)
class FDistribution(Distribution):
    d1: Number
    d2: Number

    def pdf(self, x):
        k, a, b = of(self.d1, self.d2, x), self.d1, self.d2
        if k is K.COL:
            return self._by_arrow("pdf", x)
        z = k.maximum(x, 1e-300)
        logs = a / 2 * k.log(a) + b / 2 * k.log(b) + (a / 2 - 1) * k.log(z) - (a + b) / 2 * k.log(a * z + b) - k.lgamma(a / 2) - k.lgamma(b / 2) + k.lgamma((a + b) / 2)
        return k.where(x < 0, 0.0, k.exp(logs))

    def cdf(self, x):
        k = of(self.d1, self.d2, x)
        z = k.maximum(x, 0.0)
        return K.regularized_beta(self.d1 / 2, self.d2 / 2, self.d1 * z / (self.d1 * z + self.d2))

    def sf(self, x):
        k = of(self.d1, self.d2, x)
        return K.f_upper(k.maximum(x, 0.0), self.d1, self.d2)

    def mean(self):
        k = of(self.d2)
        return k.where(self.d2 <= 2, math.nan, self.d2 / k.where(self.d2 <= 2, 1.0, self.d2 - 2))

    def median(self):
        return math.nan

    def mode(self):
        k = of(self.d1, self.d2)
        return k.where(self.d1 <= 2, math.nan, (self.d1 - 2) / self.d1 * self.d2 / (self.d2 + 2))

    def variance(self):
        k, a, b = of(self.d1, self.d2), self.d1, self.d2
        return k.where(b <= 4, math.nan, 2 * b * b * (a + b - 2) / (a * k.where(b <= 4, 1.0, (b - 2) * (b - 2) * (b - 4))))

    def recenter(self, x):
        return FDistribution(self.d1, 2 * x / (x - 1))

    def defined_range(self):
        return 0.0, HUGE


@dataclass(frozen=True)
class ChiSquaredDistribution(Distribution):
    dof: Number

    def pdf(self, x):
        k, v = of(self.dof, x), self.dof
        if k is K.COL:
            return self._by_arrow("pdf", x)
        z = k.maximum(x, 1e-300)
        return k.where(x < 0, 0.0, k.exp((v / 2 - 1) * k.log(z) - z / 2 - v / 2 * math.log(2) - k.lgamma(v / 2)))

    def cdf(self, x):
        return K.gamma_p(self.dof / 2, x / 2)

    def sf(self, x):
        return K.gamma_q(self.dof / 2, x / 2)

    def mean(self):
        return self.dof

    def median(self):
        c = 1 - 2 / (9 * self.dof)
        return self.dof * c * c * c

    def mode(self):
        k = of(self.dof)
        return k.maximum(self.dof - 2.0, 0.0)

    def variance(self):
        return 2 * self.dof

    def recenter(self, x):
        return ChiSquaredDistribution(of(x).floor(x))

    def defined_range(self):
        return 0.0, HUGE


@dataclass(frozen=True)
class BinomialDistribution(Distribution):
    n: Number
    p: Number

    def pdf(self, x):
        k = of(self.n, self.p, x)
        if k is K.COL:
            return self._by_arrow("pdf", x)
        return k.exp(k.lgamma(self.n + 1) - k.lgamma(x + 1) - k.lgamma(self.n - x + 1) + x * k.log(self.p) + (self.n - x) * k.log(1 - self.p))

    def cdf(self, x):
        k = of(self.n, self.p, x)
        j = k.floor(x)
        got = K.regularized_beta(k.maximum(self.n - j, 1e-300), k.maximum(j + 1, 1e-300), 1 - self.p)
        return k.where(x < 0, 0.0, k.where(j >= self.n, 1.0, got))

    def sf(self, x):
        k = of(self.n, self.p, x)
        j = k.floor(x)
        got = K.regularized_beta(k.maximum(j + 1, 1e-300), k.maximum(self.n - j, 1e-300), self.p)
        return k.where(x < 0, 1.0, k.where(j >= self.n, 0.0, got))

    def _most(self):
        return self.n

    def mean(self):
        return self.n * self.p

    def median(self):
        return self.n * self.p

    def mode(self):
        return (self.n + 1) * self.p

    def variance(self):
        return self.n * self.p * (1 - self.p)

    def recenter(self, x):
        return BinomialDistribution(self.n, x / self.n)

    def defined_range(self):
        return 0.0, HUGE


@dataclass(frozen=True)
class LogNormalDistribution(Distribution):
    """``mean_value`` is the mean of the logarithm."""

    standard_deviation: Number = 1.0
    mean_value: Number = 0.0

    def pdf(self, x):
        k = of(self.standard_deviation, self.mean_value, x)
        y = k.maximum(x, 1e-300)
        z = (k.log(y) - self.mean_value) / self.standard_deviation
        return k.where(x <= 0, 0.0, k.exp(-0.5 * z * z) / (y * self.standard_deviation * math.sqrt(2 * math.pi)))

    def cdf(self, x):
        k = of(self.standard_deviation, self.mean_value, x)
        return k.where(x <= 0, 0.0, K.normal_cdf((k.log(k.maximum(x, 1e-300)) - self.mean_value) / self.standard_deviation))

    def mean(self):
        k = of(self.standard_deviation, self.mean_value)
        return k.exp(self.mean_value + self.standard_deviation * self.standard_deviation / 2)

    def median(self):
        return of(self.mean_value).exp(self.mean_value)

    def mode(self):
        k = of(self.standard_deviation, self.mean_value)
        return k.exp(self.mean_value - self.standard_deviation * self.standard_deviation)

    def variance(self):
        k, s2 = of(self.standard_deviation, self.mean_value), self.standard_deviation * self.standard_deviation
        return (k.exp(s2) - 1) * k.exp(2 * self.mean_value + s2)

    def recenter(self, x):
        return LogNormalDistribution(self.standard_deviation, x)

    def defined_range(self):
        return 0.0, HUGE

    def ppf(self, p):
        k = of(self.standard_deviation, self.mean_value, p)
        return k.exp(self.mean_value + self.standard_deviation * NormalDistribution().ppf(p))

    standardized_variable = ppf


@dataclass(frozen=True)
class PoissonDistribution(Distribution):
    occurrence_rate: Number

    def pdf(self, x):
        k = of(self.occurrence_rate, x)
        if k is K.COL:
            return self._by_arrow("pdf", x)
        return k.exp(x * k.log(self.occurrence_rate) - self.occurrence_rate - k.lgamma(x + 1))

    def cdf(self, x):
        k = of(self.occurrence_rate, x)
        return k.where(x < 0, 0.0, K.gamma_q(k.maximum(k.floor(x) + 1, 1e-300), self.occurrence_rate))

    def sf(self, x):
        k = of(self.occurrence_rate, x)
        return k.where(x < 0, 1.0, K.gamma_p(k.maximum(k.floor(x) + 1, 1e-300), self.occurrence_rate))

    def _most(self):
        """Beyond lies a probability of less than 1e-300."""
        return self.occurrence_rate + 60 * of(self.occurrence_rate).sqrt(self.occurrence_rate) + 1000

    def mean(self):
        return self.occurrence_rate

    def median(self):
        k = of(self.occurrence_rate)
        return k.floor(self.occurrence_rate + 1 / 3 - 0.02 / self.occurrence_rate)

    def mode(self):
        k = of(self.occurrence_rate)
        return k.floor(self.occurrence_rate)

    def variance(self):
        return self.occurrence_rate

    def recenter(self, x):
        return PoissonDistribution(x)

    def defined_range(self):
        return 0.0, HUGE


@dataclass
class MultivariateNormalDistribution:
    """Means and covariance are small matrices on the driver; the density is an expression over columns."""

    mu: np.ndarray | None = None
    sigma: np.ndarray | None = None
    _chol: np.ndarray | None = field(default=None, repr=False)

    def initialize(self, mu, sigma) -> MultivariateNormalDistribution:
        mu, sigma = np.asarray(mu, float), np.asarray(sigma, float)
        if sigma.shape != (len(mu), len(mu)):
            raise MatrixSizeError(f"the covariance must be {len(mu)} x {len(mu)}")
        self.mu, self.sigma, self._chol = mu, sigma, np.linalg.cholesky(sigma)
        return self

    def _ready(self) -> np.ndarray:
        if self._chol is None:
            raise UninitializedObjectError("initialize the distribution first")
        return self._chol

    def set_means(self, mu) -> None:
        if len(mu) != len(self._ready()):
            raise ArraySizeError("as many means as there are")
        self.mu = np.asarray(mu, float)

    def get_means(self) -> np.ndarray:
        self._ready()
        return self.mu.copy()

    def get_covariance(self) -> np.ndarray:
        self._ready()
        return self.sigma.copy()

    def get_cholesky_factored_matrix(self) -> np.ndarray:
        return self._ready().copy()

    def pdf(self, *xs):
        """The density at one vector of numbers or at a vector of columns: the whitened residuals are unrolled with literals."""
        low = self._ready()
        w = np.linalg.inv(low)
        scale = float(np.exp(-0.5 * len(low) * np.log(2 * np.pi) - np.log(np.diag(low)).sum()))
        if not any(isinstance(x, Column) for x in xs):
            z = w @ (np.asarray(xs, float) - self.mu)
            return scale * float(np.exp(-0.5 * z @ z))
        total = F.lit(0.0)
        for i in range(len(low)):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + F.lit(float(w[i, j])) * (xs[j] - F.lit(float(self.mu[j])))
            total = total + z * z
        return F.lit(scale) * F.exp(F.lit(-0.5) * total)
