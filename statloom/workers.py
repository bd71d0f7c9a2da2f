"""Python workers must be able to import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(on: DataFrame | SparkSession):
    """``on``, after the package's folder has been put on the path of the workers that will run its Python functions (on a cluster, ship the package with --py-files)."""
    spark = on.sparkSession if isinstance(on, DataFrame) else on
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return on
