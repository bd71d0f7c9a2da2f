"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small side of a join that are sent to every task at most.
FEW_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only on one machine, as in tests, one is set here if it is unset; a cluster has to name its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = os.path.join(os.environ.get("TMPDIR", "/tmp"), "statloom-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: all that reads it sees the same rows, whatever executors come or go. It stays until the folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df`` for the small side of a join: computed and broadcast if it has at most ``most`` rows, so that the large side is not moved; else as it is."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df
