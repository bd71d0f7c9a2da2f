"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes in an Arrow batch sent to Python: a batch ends at whichever comes first, so a worker's memory is bounded by one text or this much.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: Rows of a key that may meet in one task of a join, hot keys that are broadcast, and pieces that the rows of a hot key are dealt into if there are more.
HOT_ROWS, BROADCAST_KEYS, SALTS = 512, 100_000, 64
#: Paths of the tables written in each open scope, the innermost last.
_scopes: list[list[str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Long texts must not meet by the ten thousand in a Python worker. The session keeps these bounds, as a plan reads them only when it runs."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", str(spark.conf.get(key)).lower()).groups()
        now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only on one machine, as in tests, one is set here; a cluster has to name its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = os.path.join(os.environ.get("TMPDIR", "/tmp"), "statloom-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables that :func:`written` makes inside are deleted at the end, but for those made with ``stay``; nothing lazy that reads them may leave."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()
        for p in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, stay: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there and survives lost executors. With ``stay`` it belongs to the scope around the innermost one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_scopes) > stay:
        _scopes[-1 - stay].append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number per row, written once: a number taken anew in each scan would follow the splits, and these the executors that are alive."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per key; ``size``: its rows in ``rows``, not kept) in which no task gets all rows of a hot key.

    Keys of more than HOT_ROWS rows are broadcast if there are at most
    BROADCAST_KEYS of them, else their rows are dealt into SALTS pieces each;
    the others are joined by key. ``facts`` should be a table.
    """
    hot, cold = facts.filter(F.col(size) > HOT_ROWS).drop(size), facts.filter(F.col(size) <= HOT_ROWS).drop(size)
    out = rows.join(cold, on)
    n = hot.count()
    if not n:
        return out
    if n <= BROADCAST_KEYS:
        other = rows.join(F.broadcast(hot), on)
    else:
        salt = fresh(rows, "__salt")
        dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        other = dealt.join(hot.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, salt]).drop(salt)
    return out.unionByName(other)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """At most ``bound`` labelled texts: (doc_id, text, y).

    The labels with the least hash of their id are taken, so the sample is the
    same on every run and has a proven size: only it is broadcast. Null ids and
    null labels are left out; of repeated labels of one id the largest counts.
    """
    of = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).dropna()
    if keep is not None:
        of = of.filter(keep(F.col("__id")))
    of = of.groupBy("__id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(of), F.col("doc_id") == F.col("__id"))
    return rows.orderBy(F.xxhash64("__id"), "__id", F.xxhash64("text")).limit(bound).select("doc_id", "text", "y")


def id_sample(docs: DataFrame, bound: int) -> DataFrame:
    """The rows of at most ``bound`` ids, those with the least hash; of rows that repeat an id, all. Only ids are sorted and sent."""
    ids = docs.select(F.col("doc_id").alias("__id")).dropna().distinct().orderBy(F.xxhash64("__id"), "__id").limit(bound)
    return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi")
