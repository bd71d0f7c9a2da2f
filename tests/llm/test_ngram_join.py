"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.llm import ngram_join as J
from statloom.llm import queries
from statloom.llm.near_dup import _mix

WORD = re.compile("[^\x20\x09-\x0d]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, k=4):
    w = WORD.findall((text or "").translate(UP))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def plainly(rows, t=(85, 100)):
    sets = [grams(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and t[1] * both >= t[0] * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(sets[i]), ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def found(df, **how):
    return sorted(map(tuple, J.jaccard_components(df, **how).collect()), key=repr)


def family(draw, size, words, changed, vocabulary=400):
    """Texts with some words changed at random places of one template."""
    base = [f"w{draw.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(draw.randrange(changed + 1)):
            t[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_ngram_join(spark, "/root/testdata/sf0.001").collect()), key=repr) == plainly(rows)


@pytest.mark.parametrize(("piece", "hot"), [(4, 0), (4, 20), (2048, 1 << 20)])
def test_families(spark, monkeypatch, piece, hot):
    """Groups whose texts lie on both sides of the threshold, a template that nearly all share, copies; all pairs between components are formed."""
    monkeypatch.setattr(J, "PIECE", piece)
    monkeypatch.setattr(J, "HOT_CELL", hot)  # from here on an n-gram's rows are dealt out
    draw = random.Random(5)
    texts = family(draw, 60, 120, 4) + family(draw, 40, 200, 12) + family(draw, 30, 60, 1) + family(draw, 25, 300, 30, 50)
    lead = texts[0].split()[:70]
    texts += [" ".join(lead + [f"y{draw.randrange(10**6)}" for _ in range(draw.randrange(1, 40))]) for _ in range(40)]
    texts += texts[:30]
    draw.shuffle(texts)
    rows = list(enumerate(texts, 100))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == plainly(rows)
    assert 1 < len({r[2] for r in got}) < len(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE\ttwo"), (6, "two one"), (None, "one two"), (None, "nobody else says this"), (7, long), (8, long + " more"), (8, long), (9, "x"), (9, "x"), (10, "É a b c d"), (11, "é a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("key", "h", "n", "c", "token", "s", "p", "cell", "count", "component_id"):
        df = df.withColumn(c, df.doc_id * 0)
    assert found(df) == plainly(rows)
    assert found(df.limit(0)) == []
    assert found(df.filter("doc_id = 2")) == [(2, 0, 2)]


@pytest.mark.parametrize("n", [1, 2, 6, 7, 19, 20, 100, 333])
def test_prefix_length(n):
    need = -(-85 * n // 100)
    assert J.prefix_length(n, (85, 100)) == n - need + 1


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1, max_size=60), st.sets(st.integers(0, 300), min_size=1, max_size=60))
def test_filters_let_links_pass(a, b):
    """A pair that reaches the threshold shares a prefix n-gram and passes the positional and the suffix filter at the first one."""
    t, common = (85, 100), np.zeros(J.CELLS, np.int64)
    b = b if len(a ^ b) < 9 else set(list(a)[:-1]) | {301}
    x, y = (np.sort(_mix(np.array(list(s), np.uint64))) for s in (a, b))
    u, v = J.ordered(x, common), J.ordered(y, common)
    both = len(np.intersect1d(x, y))
    if not J.enough(both, len(x), len(y), t):
        return
    pu, pv = u[: J.prefix_length(len(u), t)], v[: J.prefix_length(len(v), t)]
    common_first = next(z for z in pu if z in pv)
    i, j = list(pu).index(common_first), list(pv).index(common_first)
    assert min(len(u) - i, len(v) - j) * 185 >= (len(u) + len(v)) * 85
    su, sv = (J.suffix_classes(J.profile(s, common, t), k) for s, k in ((x, i), (y, j)))
    assert J.enough(1 + int(np.minimum(su, sv).sum()), len(x), len(y), t)
    assert su.sum() == len(u) - i - 1
    bits = np.bitwise_count(J.sketch(x).view(np.uint64) ^ J.sketch(y).view(np.uint64)).sum()
    assert bits <= len(x) + len(y) - 2 * both


def test_near_copies_of_a_template_make_few_pairs(spark, monkeypatch):
    """Links to the texts nearest to a template are found in rounds, so the join between components gets few rows; sets of other sizes only are no candidates."""
    draw, joined, rows = random.Random(3), J.joined_pairs, []
    monkeypatch.setattr(J, "joined_pairs", lambda *a: rows.append((out := joined(*a)).count()) or out)
    texts = family(draw, 250, 150, 3)
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == plainly(list(enumerate(texts)))
    assert sum(rows) < 4 * len(texts)
    key = [bytes([i]) * 12 for i in range(4)]
    tokens = spark.createDataFrame([(1, -1, 0, key[0], 100), (1, -1, 0, key[1], 200), (2, -1, 0, key[2], 100), (2, -1, 0, key[3], 110)], "token long, piece long, place long, key binary, n long")
    assert {bytes(r.h) for r in J.shared_prefixes(tokens, J.THRESHOLD).collect()} == set(key[2:])
