"""Secret scans: dense and odd texts, held-out findings, and a plain search for what must be a candidate."""

import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

from statloom.llm import secrets


def key(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def test_dense_text_takes_linear_time(spark):
    seconds = {}
    for n in (1_000, 20_000):
        text = " ".join(f'token = "{key(i)}" word{i}' for i in range(n))
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.perf_counter()
        rows = secrets.scan(d).collect()
        seconds[n] = time.perf_counter() - t
        assert len(rows) == n and all(text[r.start : r.start + r.length] == r.value for r in rows)
        clean = secrets.redact(d).first().text
        assert clean.count("[SECRET]") == sum(r.is_secret for r in rows) and not any(r.value in clean for r in rows if r.is_secret)
    assert seconds[20_000] < 30 * seconds[1_000]


def test_forest_on_held_out_findings(spark):
    """Trained on two thirds of the labelled findings, judged on the rest."""
    table = secrets.findings_table(spark).withColumn("part", F.pmod(F.xxhash64("value", "before"), F.lit(3)))
    test = table.filter("part = 0").collect()
    docs = spark.createDataFrame([(i, f"{r.before}{r.value}{r.after}") for i, r in enumerate(test)], "doc_id long, text string")
    got = {}
    for r in secrets.scan(docs, table.filter("part <> 0")).collect():
        if r.value.strip("\"'") and r.value in test[r.doc_id].value or test[r.doc_id].value in r.value:
            got[r.doc_id] = max(got.get(r.doc_id, False), r.is_secret)
    y = np.array([test[i].label for i in got]) == 1
    p = np.array(list(got.values()))
    assert len(got) > 0.7 * len(test)
    assert (p & y).sum() > 0.95 * y.sum() and (p & y).sum() > 0.95 * p.sum()


def test_candidates_equal_a_plain_search(spark):
    """Runs of 12 and more key characters with a letter and a digit are all candidates, whole but for trailing marks."""
    rng = np.random.default_rng(8)
    chars = list("abcXYZ019_-+/=.@:% ,\n(é")
    texts = ["".join(rng.choice(chars, 120)) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start, r.value) for r in secrets.scan(d).collect()}
    for i, t in enumerate(texts):
        for m in re.finditer(r"(?<![A-Za-z0-9_\-+/=.@:%])[A-Za-z0-9_\-+/=.@:%]{12,}", t):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                assert (i, m.start(), re.sub(r"[.:,;)]+$", "", m[0])) in got
    assert all(texts[i][s : s + len(v)] == v for i, s, v in got)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "\x01\x02 token = \"11acdfb36bb72224148e6160f674b4be45601bff\"\x01"), (None, "none"), (4, "a1" * 300_000), (5, "é" * 5 + ' password = "hunter2x!" ' + "é" * 5), (5, "é" * 5 + ' password = "hunter2x!" ' + "é" * 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("start", "value", "score", "__pieces", "__places", "__found", "__f", "k0"):
        d = d.withColumn(c, F.lit(7))
    got = secrets.scan(d).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in got) == [(3, 12, 40), (4, 0, 600_000), (5, 18, 9), (5, 18, 9)]
    clean = secrets.redact(d)
    assert clean.columns == d.columns and clean.count() == len(rows) and clean.filter("`__pieces` = 7 and k0 = 7").count() == len(rows)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[1] is None and text[2] == "" and text[None] == "none" and text[5] == "ééééé password = \"[SECRET]\" ééééé" and text[3] == '\x01\x02 token = "[SECRET]"\x01'.replace("\x01", text[3][0]).replace("\x02", text[3][1])
    assert secrets.scan(d.limit(0)).count() == 0 and secrets.redact(d.limit(0)).count() == 0
