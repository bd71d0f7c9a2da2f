"""Distributed ordered scan: what a window over a whole series gives, without a series in one task.

A long series is cut into pieces of consecutive rows by a range partitioning on
(group, order) that is written once, so that every later job sees the same
pieces. Each piece is scanned by itself; a carry brings along what the pieces
before it (or after it) hold of the same group: counts, sums, the last value, the
last value that is not null, the next value. Only the first and the last group of
a piece can go on in another one, so there are at most two carries per piece,
whatever the number of rows or groups. Series that are all short are plain windows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Rows of a series that may meet in one window; longer series are cut into pieces of about half as many.
PIECE_ROWS = 1 << 20

Columns = Mapping[str, Column]


def _struct(columns: Sequence[Column | str]) -> Column:
    """A struct that is never null, for comparing and for carrying rows of values."""
    return F.struct(F.lit(0).alias("_"), *[(F.col(c) if isinstance(c, str) else c).alias(f"_{i}") for i, c in enumerate(columns)])


def longest(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Rows of the longest series: one aggregate with map-side combining."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def ordered_scan(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), *, rank: str | None = None, size: str | None = None, running: Columns | None = None, latest: Columns | None = None, before: Columns | None = None, after: Columns | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with new columns over each series, in the order of ``order`` (nulls first).

    ``rank`` names the row's place from 1, ``size`` the rows of the series;
    ``running`` gives sums up to the row (null values skipped), ``latest`` the
    last value that is not null at or before the row, ``before`` and ``after`` the
    value of the row before and after (null at the ends). The longest series is
    counted first. Up to ``piece_rows`` rows it is a plain window; beyond, no window
    holds more than about ``piece_rows`` rows, unless more rows than that are equal in
    all columns. Rows that ``order`` leaves tied come in any order, but the same for all new columns.
    A null in ``by`` is a group of its own.
    """
    by, running, latest, before, after = list(by), running or {}, latest or {}, before or {}, after or {}
    if longest(df, by) <= piece_rows:
        return _windows(df, Window.partitionBy(*by), order, rank, size, running, latest, before, after)
    total = df.select(*by).count() if by else df.count()
    return _pieced(df, order, by, rank, size, running, latest, before, after, max(2, math.ceil(2 * total / piece_rows)))


def _windows(df: DataFrame, w, order: Sequence[str | Column], rank, size, running: Columns, latest: Columns, before: Columns, after: Columns) -> DataFrame:
    o = w.orderBy(*order)
    upto = o.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {k: F.sum(c).over(upto) for k, c in running.items()}
    new |= {k: F.last(c, ignorenulls=True).over(upto) for k, c in latest.items()}
    new |= {k: F.lag(c).over(o) for k, c in before.items()} | {k: F.lead(c).over(o) for k, c in after.items()}
    if rank:
        new[rank] = F.row_number().over(o).cast("long")
    if size:
        new[size] = F.count(F.lit(1)).over(w)
    return df.select("*", *[c.alias(k) for k, c in new.items()])


def _pieced(df: DataFrame, order: Sequence[str], by: list[str], rank, size, running: Columns, latest: Columns, before: Columns, after: Columns, pieces: int) -> DataFrame:
    tie = F.xxhash64(*df.columns)
    rows = written(df.withColumn("__tie", tie).repartitionByRange(pieces, *by, *order, "__tie").withColumn("__piece", F.spark_partition_id()))
    line = [*order, "__tie"]
    keys = [F.col(b).alias(f"__by{i}") for i, b in enumerate(by)]
    # what each piece holds of each group
    at = _struct(line)
    held = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{k}") for k, c in running.items()], *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"latest_{k}") for k, c in latest.items()]]
    held += [F.max_by(_struct(list(before.values())), at).alias("last"), F.min_by(_struct(list(after.values())), at).alias("first")]
    part = rows.groupBy(*keys, "__piece").agg(*held)
    if by:  # only the groups at both ends of a piece can be in other pieces too
        names = [f"__by{i}" for i in range(len(by))]
        inside, group = Window.partitionBy("__piece"), _struct(names)
        part = part.withColumn("lo", F.min(group).over(inside)).withColumn("hi", F.max(group).over(inside)).filter((group == F.col("lo")) | (group == F.col("hi"))).drop("lo", "hi")
    else:
        names = []
    g = Window.partitionBy(*names)
    o = g.orderBy("__piece")
    earlier = o.rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(
        *names,
        F.col("__piece").alias("__at"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"),
        F.sum("n").over(g).alias("__size"),
        *[F.sum(f"sum_{k}").over(earlier).alias(f"__sum_{k}") for k in running],
        *[F.last(f"latest_{k}", ignorenulls=True).over(earlier).alias(f"__latest_{k}") for k in latest],
        F.lag("last").over(o).alias("__last"),
        F.lead("first").over(o).alias("__first"),
    )
    same = [F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)]
    w = Window.partitionBy("__piece", *by)
    out = _windows(rows, w, line, "__rank", "__held", {f"__{k}": c for k, c in running.items()}, {f"__{k}": c for k, c in latest.items()}, {}, {})
    o = w.orderBy(*line)
    out = out.select("*", *[F.lag(_struct([c])).over(o).alias(f"__b_{k}") for k, c in before.items()], *[F.lead(_struct([c])).over(o).alias(f"__a_{k}") for k, c in after.items()])
    # at most two rows per piece
    out = out.join(F.broadcast(carry), [*same, F.col("__piece") == F.col("__at")], "left")
    plus = lambda a, b: F.coalesce(a + b, a, b)
    new = {k: plus(F.col(f"__{k}"), F.col(f"__sum_{k}")) for k in running} | {k: F.coalesce(f"__{k}", f"__latest_{k}") for k in latest}
    new |= {k: F.when(F.col(f"__b_{k}").isNotNull(), F.col(f"__b_{k}")["_0"]).otherwise(F.col("__last")[f"_{i}"]) for i, k in enumerate(before)}
    new |= {k: F.when(F.col(f"__a_{k}").isNotNull(), F.col(f"__a_{k}")["_0"]).otherwise(F.col("__first")[f"_{i}"]) for i, k in enumerate(after)}
    if rank:
        new[rank] = (F.col("__rank") + F.coalesce("__n", F.lit(0))).cast("long")
    if size:
        new[size] = F.coalesce("__size", "__held")
    return out.select(*df.columns, *[c.alias(k) for k, c in new.items()])
