"""Least squares by triangular factors that merge: tall data become one small R per group.

Each task turns its rows, batch by batch, into the R of a QR factorization; factors
of the same group are stacked and factored again, in two rounds, so that no task
merges more than the factors of a share of the tasks. R holds all that least squares
needs of [X y], and neither squares the condition number of X nor takes the sum of
squared residuals as a difference of large sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import importable

#: Groups whose factors a task holds before it passes them on.
HELD = 4096
#: Shares of the tasks whose factors are merged first.
PIECES = 64
#: Singular values below this share of the largest count as 0.
RANK_TOLERANCE = 1e-12


def triangle(a: np.ndarray) -> np.ndarray:
    """R of a matrix, square even if the matrix has fewer rows than columns."""
    r = np.linalg.qr(a, mode="r")
    return np.vstack([r, np.zeros((max(a.shape[1] - len(r), 0), a.shape[1]))])


def _factor(batches: Iterator[pa.RecordBatch], by: list[str], p: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[int, np.ndarray]] = {}

    def out() -> pa.RecordBatch:
        keys = list(zip(*held, strict=True)) if by and held else [[] for _ in by]
        n, r = [v[0] for v in held.values()], [v[1].ravel().tolist() for v in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate([*keys, n, r])], schema=schema)

    for b in batches:
        x = np.column_stack([b.column(len(by) + i).to_numpy(zero_copy_only=False) for i in range(p)])
        if not by:
            parts = {(): np.arange(len(x))}
        else:
            code, names = pd.factorize(pd.Series(list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True)), dtype=object), use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            parts = dict(zip(names, np.split(order, np.flatnonzero(np.diff(code[order])) + 1), strict=True)) if len(code) else {}
        for key, at in parts.items():
            n, r = held.get(key, (0, np.empty((0, p))))
            held[key] = (n + len(at), triangle(np.vstack([r, x[at]])))
        if len(held) > HELD:
            yield out()
            held.clear()
    yield out()


def _merged(parts: pd.DataFrame, by: list[str], p: int) -> pd.DataFrame:
    first = parts.iloc[[0]].copy()
    first["n"] = int(parts["n"].sum())
    first["r"] = [triangle(np.vstack([np.asarray(r, float).reshape(p, p) for r in parts["r"]])).ravel().tolist()]
    return first[[*by, "n", "r"]]


def r_factors(df: DataFrame, columns: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """by, n, r: the number of rows and the factor of the columns (p x p, row by row) of every group. Rows with a null are left out."""
    by, p = list(by), len(columns)
    cols = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)]
    rows = df.select(*by, *cols).dropna(subset=[f"__x{i}" for i in range(p)])
    schema = T.StructType([*[rows.schema[b] for b in by], T.StructField("n", T.LongType()), T.StructField("r", T.ArrayType(T.DoubleType()))])
    arrow = rows.select(*by, F.lit(0).cast("long").alias("n"), F.array(F.lit(0.0)).alias("r")).limit(0).toArrow().schema
    part = importable(rows).mapInArrow(lambda it: _factor(it, by, p, arrow), schema).withColumn("__piece", F.pmod(F.spark_partition_id(), F.lit(PIECES)))
    some = part.groupBy(*by, "__piece").applyInPandas(lambda d: _merged(d, by, p), schema)
    return some.groupBy(*by).applyInPandas(lambda d: _merged(d, by, p), schema)


def solved(r: np.ndarray, scaled: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, (X'X)^+, sum of squared residuals) from the factor of [X y]; columns that depend on others share their coefficients."""
    p = len(r) - 1
    x, y = r[:p, :p], r[:p, p]
    scale = np.linalg.norm(x, axis=0) if scaled else np.ones(p)
    scale = np.where(scale > 0, scale, 1.0)
    u, s, vt = np.linalg.svd(x / scale)
    kept = s > RANK_TOLERANCE * s[0] if len(s) and s[0] > 0 else np.zeros(p, bool)
    v = vt[kept].T / s[kept]
    b = v @ (u[:, kept].T @ y) / scale
    rest = y - u[:, kept] @ (u[:, kept].T @ y)
    return b, v @ v.T / np.outer(scale, scale), float(rest @ rest + r[p, p] ** 2)
