"""The prefix trie of conversations by prefix doubling.

Turns get names: equal (role, text) have equal names, dense numbers given in one
round of counting and joining. Blocks of two, four, eight, ... turns get theirs
from the names of their halves, so that after a logarithmic number of rounds every
aligned block has a name. A prefix is the blocks of the binary digits of its
length, the largest first: going down the block sizes, the prefix that ends in a
block is named by the prefix before it and the block. Equal prefixes have equal
names, so nodes are groups of names and no two texts are ever compared.

What a node sums up over its subtree is found by doubling too: in round k each
node passes what it holds of the next 2^k levels to the node 2^k levels above.
A node of one conversation starts a chain, whose sums are known; only shared
nodes take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import ordered_scan
from .common import WORD, map_rows, scratch, spread_join, written

#: Conversations whose ids share a quotient by this number share the first turns of the first of them, up to one less than the second number.
FAMILY, HEADS = 20, 4
#: Ids in one piece of a node's list of ended conversations.
CHUNK = 4096


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), key, words: turns in order (null first; turns with equal numbers by their key). The key stands for role and text, so that no text is moved."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"), 256))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), key.alias("key"), F.regexp_count(text("text"), F.lit(WORD)).cast("long").alias("words"))
    return ordered_scan(rows, ["turn", "key"], ["conv"], rank="place").select("conv", (F.col("place") - 1).alias("pos"), "key", "words")


def heads_of(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each has got the first turns of its family: conv, total; conv, pos, key, words, ends (the turn is the last)."""
    base = F.col("conv") - F.col("conv") % FAMILY
    first = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv", "base")
    known = first.groupBy("base").agg(F.count(F.lit(1)).alias("known"))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).select("conv", "own", base.alias("base"), heads_of(F.col("conv")).alias("h"))
    convs = convs.join(known, "base", "left").withColumn("taken", F.least("h", F.coalesce("known", F.lit(0)))).withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv", "own", "base", "h", "taken", "total"))
    ends = (F.col("pos") == F.col("total") - 1).alias("ends")
    head = convs.join(first, "base").filter(F.col("pos") < F.col("h")).select("conv", "pos", "key", "words", ends)
    rest = spread_join(turns, convs.select("conv", "h", "taken", "total", "own"), ["conv"], "own").filter(F.col("pos") >= F.col("h"))
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select("conv", "pos", "key", "words", ends)
    return convs.select("conv", "total"), head.unionByName(rest)


def named(rows: DataFrame, key: list[str], start: int = 0) -> tuple[DataFrame, int]:
    """(``rows`` with name, convs, least; number of names): equal keys share a dense number from ``start`` on; convs is the key's number of rows, least its least conv."""
    spark = rows.sparkSession
    keys = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("convs"), F.min("conv").alias("least")).withColumn("id", F.monotonically_increasing_id())
    keys = written(keys)
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r.n) for r in keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per task that wrote keys
    offsets, total = [], start
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    offset = spark.createDataFrame(offsets, "part long, offset long")
    keys = keys.withColumn("part", part).join(F.broadcast(offset), "part").select(*key, (F.col("offset") + place).alias("name"), "convs", "least", F.col("convs").alias("size"))
    return spread_join(rows, keys, key, "size"), total - start


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """conv, d, name, convs, least, words, ends: for every d the name of the first d turns, with words and end of the last one. Names start at 1; 0 is the empty prefix."""
    level, _ = named(turns, ["key"])
    blocks = [written(level.select("conv", F.col("pos").alias("j"), F.col("name").alias("block"), "words", "ends"))]
    while 2 << (len(blocks) - 1) <= longest:
        right = F.col("j") % 2 == 1
        side = lambda c, r: F.max(F.when(right if r else ~right, F.col(c)))
        pair = blocks[-1].groupBy("conv", F.floor(F.col("j") / 2).alias("j")).agg(side("block", False).alias("l"), side("block", True).alias("r"), side("words", True).alias("words"), side("ends", True).alias("ends"))
        level, _ = named(written(pair.filter("l is not null and r is not null")), ["l", "r"])
        blocks.append(written(level.select("conv", "j", F.col("name").alias("block"), "words", "ends")))
    out, start = None, 1
    for k in range(len(blocks) - 1, -1, -1):
        # prefixes of an odd multiple of 2^k turns: a shorter one, known from the levels before, and a block
        last = blocks[k].filter("j % 2 = 0").select("conv", (F.col("j") * (1 << k)).alias("before"), ((F.col("j") + 1) * (1 << k)).alias("d"), "block", "words", "ends")
        if out is None:
            last = last.withColumn("prefix", F.lit(0).cast("long"))
        else:
            known = out.select(F.col("conv").alias("conv_"), F.col("d").alias("d_"), F.col("name").alias("prefix"))
            last = last.join(known, (F.col("conv") == F.col("conv_")) & (F.col("before") == F.col("d_")), "left").drop("conv_", "d_").fillna(0, ["prefix"])
        got, n = named(written(last), ["prefix", "block"], start)
        got, start = written(got.select("conv", "d", "name", "convs", "least", "words", "ends")), start + n
        out = got if out is None else out.unionByName(got)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each name; a name's pieces follow each other, in this task, in order."""
    name, digest = None, None
    for b in batches:
        names, out = [], []
        for n, piece in zip(b.column("name").to_pylist(), b.column("piece"), strict=True):
            if n != name:
                if digest is not None:
                    names.append(name)
                    out.append(digest.hexdigest())
                name, digest = n, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.string())], ["name", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([digest.hexdigest()])], ["name", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 of rows with name and conv. A long list is joined in pieces; its digest, which has an order, runs over the pieces one by one in constant memory."""
    placed = ordered_scan(ends, ["conv"], ["name"], rank="place", size="n").withColumn("chunk", F.floor((F.col("place") - 1) / CHUNK))
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = written(placed.groupBy("name", "chunk").agg(F.array_join(ids, ",").alias("piece"), F.first("n").alias("n")))
    one = pieces.filter(F.col("n") <= CHUNK).select("name", F.sha2(F.col("piece").cast("binary"), 256).alias("ends_sha256"))
    more = pieces.filter(F.col("n") > CHUNK).repartition("name").sortWithinPartitions("name", "chunk").select("name", "piece")
    return one.unionByName(map_rows(more, _digests, "name long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; null turn numbers come first; turns with equal
    numbers are ordered by the SHA-256 of role and text, equal rows are turns of
    their own. Rows without a conv_id belong to no conversation and are left out.
    Without any conversation there is no node, not even the root. Columns other
    than conv_id, turn, role and text are not looked at.
    """
    with scratch(conversations.sparkSession):
        return _trie(conversations)


def _trie(conversations: DataFrame) -> DataFrame:
    convs, turns = rebuilt(written(turn_rows(conversations)))
    longest = convs.agg(F.max("total")).first()[0] or 0
    turns = written(turns)
    p = written(prefixes(turns, longest))
    nodes = p.filter("conv = least")  # the row of its smallest member stands for a node
    up = p.select(F.col("conv").alias("conv_"), (F.col("d") + 1).alias("d_"), F.col("name").alias("parent"), F.col("least").alias("parent_conv"))
    nodes = nodes.join(up, (F.col("conv") == F.col("conv_")) & (F.col("d") == F.col("d_")), "left")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("convs")).filter("convs > 0").select("conv", "convs", F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("words"))
    least = root.select(F.col("conv").alias("root_conv"))
    nodes = nodes.crossJoin(F.broadcast(least))  # one row
    nodes = written(nodes.select("conv", "convs", "name", "d", "words", F.coalesce("parent", F.lit(0).cast("long")).alias("parent"), F.coalesce("parent_conv", "root_conv").alias("parent_conv")).unionByName(root, allowMissingColumns=True))
    below = nodes.filter("d > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.sum(F.when(F.col("convs") == 1, 1).otherwise(0)).alias("chains")).withColumnRenamed("parent", "name")
    nodes = written(nodes.join(below, "name", "left").fillna(0, ["children", "chains"]))
    # shared nodes: own leaf and the chains that start below, own savings
    shared = (F.col("convs") > 1) | (F.col("d") == 0)
    held = written(nodes.filter(shared).select("name", "conv", "d", (F.col("chains") + F.when(F.col("children") == 0, 1).otherwise(0)).alias("leaves"), ((F.col("convs") - 1) * F.col("words")).alias("saved")))
    deepest, step = held.agg(F.max("d")).first()[0] or 0, 1
    place = p.filter("convs > 1").select(F.col("conv").alias("conv_"), F.col("d").alias("d_"), F.col("name").alias("above"))
    while step <= deepest:
        sent = held.filter(F.col("d") >= step).join(place, (F.col("conv") == F.col("conv_")) & (F.col("d") - step == F.col("d_")), "left")
        sums = sent.groupBy(F.coalesce("above", F.lit(0).cast("long")).alias("name")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        held = written(held.join(sums, "name", "left").select("name", "conv", "d", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        step *= 2
    ended = p.filter("ends").select("name", "conv").unionByName(convs.filter("total = 0").select(F.lit(0).cast("long").alias("name"), "conv"))
    out = nodes.join(held.select("name", "leaves", "saved"), "name", "left").join(ends_digest(ended), "name", "left")
    return written(
        out.select(
            F.col("conv").alias("conv_id"),
            F.col("d").alias("depth"),
            F.col("parent_conv").alias("parent_conv_id"),
            F.col("convs").alias("n_convs"),
            F.col("children").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        ),
        stay=True,
    )


_BYTES = "list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)"
_BITS = "list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)"
SQL = rf"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS i, k, w
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, b: {_BITS}), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT h.c, 0 AS part, o.i, k, w FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.i < h.h UNION ALL SELECT h.c, 1, o.i, k, w FROM h JOIN o ON o.c = h.c AND o.i >= h.h),
s AS (SELECT h.c, coalesce(list(k ORDER BY part, i) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(w ORDER BY part, i) FILTER (k IS NOT NULL), []) AS ws FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
m AS (SELECT c, d, ks[1 : d] AS p, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ks) AS ends FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM s)),
n AS (SELECT d, p, min(c) AS c, count(*) AS n, max(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ids FROM m GROUP BY d, p),
k AS (SELECT n.*, u.c AS up, (SELECT count(*) FROM n AS v WHERE v.d = n.d + 1 AND v.p[1 : n.d] = n.p) AS kids FROM n LEFT JOIN n AS u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1 : n.d - 1]),
t AS (SELECT e, p[1 : e] AS p, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((n - 1) * w)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM k) GROUP BY ALL)
SELECT k.c AS conv_id, k.d AS depth, up AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(ids) AS ends_sha256 FROM k JOIN t ON t.e = k.d AND t.p = k.p
"""
