"""Words by splitting at what parts them, against the contract's own expression."""

import random
import re

from pyspark.sql import functions as F

from statloom.llm import decontaminate
from statloom.llm.common import UPPER, LOWER

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_words_are_those_of_the_contract(spark):
    rng = random.Random(4)
    signs = "aZ09 \t\n\v\f\r\0\x1f\x7f\x80\x85\xa0-_/:@[`{~.ÉİKΣ中 ﻿😀́"
    texts = ["", " ", "--", "a", "-a", "a-", " Ab  cD ", None, *("".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ws for r in rows.select("doc_id", decontaminate.tokens(F.col("text")).alias("ws")).collect()}
    lower = str.maketrans(UPPER, LOWER)
    assert got == {i: re.findall(WORDS, (t or "").translate(lower)) for i, t in enumerate(texts)}
    items = rows.filter("doc_id < 0").withColumnRenamed("doc_id", "item_id")
    counted = decontaminate.contamination(rows, items)
    assert {r.doc_id: r.n_words for r in counted.collect()} == {i: len(w) for i, w in got.items()}


def test_no_text_is_read_word_by_word_with_a_pattern(spark, monkeypatch):
    """Extracting words one match at a time took most of the operator's time: no plan has it."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = docs.withColumnRenamed("doc_id", "item_id")
    plans, plain = [], decontaminate.written

    def keep(df):
        plans.append(df)
        return plain(df)

    monkeypatch.setattr(decontaminate, "written", keep)
    plans.append(decontaminate.contamination(docs, items))
    assert len(plans) == 4
    for df in plans:
        assert "regexp_" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_rows_do_not_depend_on_the_splits(spark, tmp_path):
    """The number of splits of a scan follows the executors that are alive: it may change between two jobs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    docs.repartition(6).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    key, small = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"
    results = []
    for first, then in (("1", "1"), ("4", "1"), ("1", "6")):
        spark.conf.set(small, "1k")
        spark.conf.set(key, first)
        got, kept = decontaminate.contamination(docs, items), decontaminate.drop_contaminated(docs, items)
        spark.conf.set(key, then)
        results.append((sorted(map(repr, got.collect())), sorted(r.doc_id for r in kept.select("doc_id").collect())))
        spark.conf.unset(key)
        spark.conf.unset(small)
    assert results[0] == results[1] == results[2]
    assert len(results[0][0]) == docs.count() > len(results[0][1]) > 0


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, row long, ws string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(docs, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns
