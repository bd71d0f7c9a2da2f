"""Fill-in-the-middle against a plain cut with regular expressions, and its way back."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.llm import queries
from statloom.llm.fill_middle import fill_in_middle, rebuild, restore, transform

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    return cut(text, h)


def cut(text, h):
    ts = TOKEN.findall(text)
    n = len(ts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(ts[:a]), "".join(ts[a:b]), "".join(ts[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet="ab Z<>PSM\né漢😀­.", max_size=40)), st.tuples(*[st.integers(0, 2**32 - 1)] * 4)), max_size=12))
def test_kernel(rows):
    h = np.array([x for _, x in rows], np.int64).reshape(len(rows), 4)
    got = transform(pa.array([t for t, _ in rows], pa.string()), h)
    want = [cut(t or "", x) for t, x in rows]
    assert list(zip(*[got[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output")], strict=True)) == want
    assert rebuild(got["output"], got["form"]).to_pylist() == [t or "" for t, _ in rows]


def test_sliced_batch():
    texts = pa.array(["skip", "one two", None, "drei vier"], pa.string()).slice(1)
    h = np.array([[1, 3, 0, 50]] * 3)
    assert transform(texts, h)["output"].to_pylist() == [cut(t or "", h[0])[-1] for t in ("one two", None, "drei vier")]


def test_odd_rows(spark):
    long = " ".join(f"w{i}é" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "<P> within"), (None, "no id here"), (4, long), (5, "same"), (5, "same"), (6, "<<S<M"), (7, " \n\t"), (8, "😀漢字 and words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("output", "form", "n", "restored", "__text", "__h0", "prefix_chars"):
        df = df.withColumn(c, df.doc_id * 0)
    got = restore(fill_in_middle(df))
    want = sorted(((i, *plainly(i, t), t or "") for i, t in rows), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert restore(fill_in_middle(df.limit(0))).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_query_against_plain_cut(spark, parts, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {r.doc_id: plainly(r.doc_id, r.text) for r in docs.collect()}
    got = queries.op12_fill_in_middle(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        n, form, p, m, out = want[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(texts[r.doc_id]))
