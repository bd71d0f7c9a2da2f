"""The prefix trie against a plain one, built turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from statloom.llm import prefix_trie as P
from statloom.llm import queries
from statloom.llm.prefix_trie import prefix_trie

WORD = re.compile("[^\x20\x09-\x0d]+")


def plainly(rows):
    key = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        t = own.get(c - int(c - 20 * int(c / 20)), [])[:h] + turns[h:]
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = defaultdict(list)
    for v in members:
        if v:
            children[v[:-1]].append(v)
    leaves, saved, out = {}, {}, []
    for v in sorted(members, key=len, reverse=True):
        leaves[v] = sum(leaves[u] for u in children[v]) or 1
        saved[v] = sum(saved[u] for u in children[v]) + ((len(members[v]) - 1) * len(WORD.findall(v[-1][1])) if v else 0)
        ids = ",".join(map(str, sorted(ends[v])))
        out.append((min(members[v]), len(v), min(members[v[:-1]]) if v else None, len(members[v]), len(children[v]), leaves[v], saved[v], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df):
    got = prefix_trie(df)
    assert sorted(map(tuple, got.collect()), key=repr) == plainly([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_prefix_trie(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(rows)


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, gaps in the numbers, bases that are absent or short, negative ids, one conversation far longer than the others."""
    draw = random.Random(3)
    rows = [(c, t, draw.choice("us"), draw.choice(["a b", "c", "", None, "a  b c\td"])) for c in [*range(0, 45), *range(60, 75), 187, 206, -7, -20] for t in range(draw.randrange(1, 6))]
    rows += [(21, None, None, None), (21, 3, "u", "x"), (21, 3, "u", "x"), (None, 1, "u", "x"), (5, None, "s", "early"), (5, None, "s", "early")]
    rows += [(300 + c, t, "u", "same words") for c in range(3) for t in range(41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("name", "conv", "d", "key", "j", "size", "convs", "place", "part"):
        df = df.withColumn(c, df.turn * 0)
    check(df)
    assert prefix_trie(df.limit(0)).count() == 0
    check(df.filter("conv_id in (187, 206)"))  # without their bases one may have no turn left


def test_many_equal_conversations(spark, monkeypatch):
    """Ids of one node in many pieces; hot first turns that are dealt out."""
    monkeypatch.setattr(P, "CHUNK", 7)
    df = spark.range(700).selectExpr("id as conv_id", "explode(sequence(0, cast(id % 3 as int))) as turn").selectExpr("conv_id", "cast(turn as long) as turn", "'u' as role", "concat('t ', turn) as text")
    check(df)


@pytest.mark.parametrize("rows", [7, 50])
def test_one_long_conversation_in_pieces(spark, monkeypatch, rows):
    scan = P.ordered_scan
    monkeypatch.setattr(P, "ordered_scan", lambda *a, **k: scan(*a, **k, piece_rows=rows))
    check(spark.range(160).selectExpr("if(id < 130, 40, 41) as conv_id", "id as turn", "'u' as role", "concat('w ', id % 9) as text"))
