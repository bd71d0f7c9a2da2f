"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from statloom.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    def same(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(same(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    data = [tuple(r) for r in got.collect()]
    assert data
    if name in SQL:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.execute(SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, data) == rows(names, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from statloom.streaming.moments import windowed_moments

    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(f"{DATA}/ev*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    q = windowed_moments(stream, "value", "ts", "1 day", "1 hour", ["event_type"]).writeStream.format("memory").queryName("moments_stream").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    want = windowed_moments(events, "value", "ts", "1 day", "1 hour", ["event_type"])
    assert spark.table("moments_stream").count() == want.count()
