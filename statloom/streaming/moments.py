"""Moments over event-time windows of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, value: str, time: str, window: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """by, start, end, n, mean, variance, standard_deviation per window; rows later than ``late`` are dropped. Works on batch frames, too."""
    v = F.col(value).cast("double")
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(*by, F.window(time, window).alias("__w")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("standard_deviation"))
    return out.select(*by, F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), "n", "mean", "variance", "standard_deviation")
