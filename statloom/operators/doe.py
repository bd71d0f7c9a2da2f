"""Experimental design: full factorials and interaction models of up to three ways."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArraySizeError, InvalidArgumentError
from ..workers import importable
from .qr import r_factors, solved
from .regression import coefficient_statistics


def full_factorial_size(levels: Sequence[int]) -> tuple[int, int]:
    """Rows and columns of the full factorial design."""
    if not levels or any(v < 1 for v in levels):
        raise InvalidArgumentError("every factor has at least one level")
    return int(np.prod([int(v) for v in levels], dtype=object)), len(levels)


def full_factorial(spark: SparkSession, levels: Sequence[int]) -> DataFrame:
    """run, f1, f2, ...: levels 1..v, the last factor fastest; made by arithmetic on a distributed range."""
    rows, n = full_factorial_size(levels)
    out, stride = [F.col("id").alias("run")], rows
    for i, v in enumerate(levels, 1):
        stride //= v
        out.append((F.floor(F.col("id") / F.lit(stride)) % v + 1).cast("int").alias(f"f{i}"))
    return spark.range(rows).select(*out)


def terms(nway: int, factors: int) -> list[tuple[int, ...]]:
    """The terms of a model: (), (i), (i, j) for i != j in order, (i, j, k) but i = j = k."""
    if nway not in (1, 2, 3):
        raise InvalidArgumentError("models have one to three ways")
    r = range(factors)
    out: list[tuple[int, ...]] = [(), *[(i,) for i in r]]
    if nway > 1:
        out += [(i, j) for i in r for j in r if i != j]
    if nway > 2:
        out += [t for t in itertools.product(r, repeat=3) if len(set(t)) > 1]
    return out


def _column(term: tuple[int, ...], factors: Sequence[str]) -> Column:
    return reduce(lambda a, b: a * b, [F.col(factors[i]).cast("double") for i in term], F.lit(1.0))


@dataclass(frozen=True)
class DoeModel:
    """nway, the factors' columns, the coefficients (NaN for dropped terms) and the mask of kept terms."""

    nway: int
    factors: tuple[str, ...]
    coefficients: tuple[float, ...]
    kept: tuple[bool, ...]


def evaluate(df: DataFrame, model: DoeModel, name: str = "modelled") -> DataFrame:
    """``df`` with the model's value."""
    total = F.lit(0.0)
    for term, b, keep in zip(terms(model.nway, len(model.factors)), model.coefficients, model.kept, strict=True):
        if keep:
            total = total + F.lit(float(b)) * _column(term, model.factors)
    return df.withColumn(name, total)


def fit_rows(df: DataFrame, nway: int, factors: Sequence[str], y: str, kept: Sequence[bool] | None = None, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """by, term, coefficient, standard_error, t_statistic, probability, confidence_interval; dropped terms have NaN. Equal columns (i j and j i) share their coefficient."""
    every = terms(nway, len(factors))
    keep = [True] * len(every) if kept is None else list(kept)
    if len(keep) != len(every):
        raise ArraySizeError(f"the mask needs {len(every)} entries")
    used = [i for i, k in enumerate(keep) if k]
    p, by = len(used), list(by)
    g = r_factors(df, [*[_column(every[i], factors) for i in used], F.col(y)], by)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                b, inv, sse = solved(np.asarray(row.r, float).reshape(p + 1, p + 1))
                at = {i: k for k, i in enumerate(used)}
                out += [[*[getattr(row, c) for c in by], i, float(b[at[i]]) if i in at else np.nan, float(inv[at[i], at[i]]) if i in at else np.nan, sse, int(row.n), p] for i in range(len(every))]
            yield pd.DataFrame(out, columns=[*by, "term", "coefficient", "c", "sse", "n", "p"])

    schema = T.StructType([*[g.schema[b] for b in by], *[T.StructField(k, t) for k, t in (("term", T.IntegerType()), ("coefficient", T.DoubleType()), ("c", T.DoubleType()), ("sse", T.DoubleType()), ("n", T.LongType()), ("p", T.IntegerType()))]])
    return coefficient_statistics(importable(g).mapInPandas(solve, schema), by, alpha).select(*by, "term", F.coalesce("coefficient", F.lit(float("nan"))).alias("coefficient"), "standard_error", "t_statistic", "probability", "confidence_interval")


def fit_model(df: DataFrame, nway: int, factors: Sequence[str], y: str, kept: Sequence[bool] | None = None, alpha: float = 0.05) -> DoeModel:
    """The model of one data set; its few coefficients come to the driver."""
    rows = {r.term: r.coefficient for r in fit_rows(df, nway, factors, y, kept, alpha).select("term", "coefficient").collect()}
    n = len(terms(nway, len(factors)))
    return DoeModel(nway, tuple(factors), tuple(rows.get(i, float("nan")) for i in range(n)), tuple([True] * n if kept is None else kept))
