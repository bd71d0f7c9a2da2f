"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a random but fixed order, gone
through twice at most. The virtual finish time of a document is the source's
words up to its end divided by the source's target; all documents of all queues
are then taken in the order of their finish times until the total budget is used.

No queue is sorted in one task: the order is cut into pieces by the leading bits
of the shuffle key, the pieces' sums give each piece its offset, and only the
documents of a piece meet in a window. The global cut is found in the same way,
from sums over ranges of finish time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

WEIGHTS, SHARE, REPEATS = (5, 2, 1), (3, 2), 2
#: Documents that are to meet in one window task.
PIECE = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row: the words of the text (null: 0)."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, weight, source_size, target: ``share`` of all words, dealt by weight; a source takes ``repeats`` times its size at most.

    Sources fill up in the order of size by weight, so the level at which the
    rest share is found from running sums over the sources (one row each).
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", w.cast("long"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("w_all", F.sum("weight").over(all_rows))
    s = s.withColumn("filled", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * repeats).withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # (share * total - filled) / w_left is the level if all before this source are full; the source is full if its own limit is lower
    s = s.withColumn("num", F.lit(share[0]) * F.col("total") - F.lit(share[1]) * F.col("filled")).withColumn("den", F.lit(share[1]) * F.col("w_left"))
    s = s.withColumn("is_full", F.lit(repeats) * F.col("source_size") * F.col("den") <= F.col("weight") * F.col("num"))
    first = F.first(F.when(~F.col("is_full"), F.struct("num", "den")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", first)
    level = (F.col("weight") * F.col("level.num")).cast("double") / F.col("level.den").cast("double")
    return s.select("source", "weight", "source_size", F.when(F.col("is_full") | F.col("level").isNull(), (F.lit(repeats) * F.col("source_size")).cast("double")).otherwise(level).alias("target"))


def _key(epoch):
    """60 bits of md5 over the pass and the id."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken.

    Whole documents are taken, each up to ``repeats`` times. A null text has
    size 0 and is never taken; a null source is a source of its own, the last; a
    null doc_id is ordered as the word null. Documents with the same id go by
    size; equal rows are interchangeable. Empty tables give no rows.
    """
    sized = written(sizes(docs).withColumn("row", F.monotonically_increasing_id()))
    goal = written(targets(sized, weights, share, repeats))
    n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = 1 << max(0, (2 * n // PIECE)).bit_length()
    g = goal.select(F.col("source").alias("s_"), "source_size", "target")
    d = sized.join(g, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    # pass e of a document: its key, the piece of the order it falls in
    queue = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("e")).withColumn("key", _key(F.col("e"))).withColumn("piece", F.floor(F.col("key") / F.lit(float(1 << 60)) * pieces))
    queue = queue.filter("size > 0")
    sums = queue.groupBy("source", "e", "piece").agg(F.sum("size").alias("n"))
    line = Window.partitionBy("source").orderBy("e", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(F.col("source").alias("s_"), F.col("e").alias("e_"), F.col("piece").alias("p_"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("offset"))
    queue = queue.join(offset, F.col("source").eqNullSafe(F.col("s_")) & (F.col("e") == F.col("e_")) & (F.col("piece") == F.col("p_"))).drop("s_", "e_", "p_")
    inside = Window.partitionBy("source", "e", "piece").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = queue.withColumn("finish", (F.col("offset") + F.sum("size").over(inside)).cast("double") / F.col("target"))
    queue = written(queue.select("row", "e", "key", "size", "source", "doc_id", "finish", F.floor(F.col("finish") * pieces).alias("slot")))
    # the range of finish times in which the budget ends
    budget = share[0] * total // share[1]
    slots = queue.groupBy("slot").agg(F.sum("size").alias("n"))
    upto = slots.select("slot", F.sum("n").over(Window.orderBy("slot")).alias("upto"), "n")
    cut = upto.filter(F.col("upto") > budget).orderBy("slot").limit(1).select("slot", F.col("upto") - F.col("n")).first()
    if cut is None:
        taken = queue
    else:
        last = Window.orderBy("finish", F.col("source").asc_nulls_last(), "e", "key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        part = queue.filter(F.col("slot") == cut[0]).withColumn("upto", F.sum("size").over(last) + F.lit(cut[1])).filter(F.col("upto") <= budget).drop("upto")
        taken = queue.filter(F.col("slot") < cut[0]).unionByName(part)
    took = taken.groupBy("row").agg(F.sum("size").alias("took"))
    return d.join(took, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("took", F.lit(0)).cast("long").alias("taken"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM d GROUP BY source),
t AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
  coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 2 AS filled,
  (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS w_left, row_number() OVER f AS place
  FROM s WINDOW f AS (ORDER BY source_size / weight, source NULLS LAST)),
u AS (SELECT *, 3 * total - 2 * filled AS num, 2 * w_left AS den, 2 * source_size * 2 * w_left <= weight * (3 * total - 2 * filled) AS is_full FROM t),
l AS (SELECT num AS n, den AS m FROM u WHERE NOT is_full ORDER BY place LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE (weight * (SELECT n FROM l))::DOUBLE / (SELECT m FROM l)::DOUBLE END AS target FROM u),
q AS (SELECT d.*, source_size, target, e, ('0x' || substr(md5(e::VARCHAR || '|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, (SELECT unnest([0, 1]) AS e) WHERE size > 0),
f AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY e, key, doc_id, size, row ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS finish FROM q),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, e, key, doc_id, size, row ROWS UNBOUNDED PRECEDING) AS upto FROM f),
k AS (SELECT row, sum(size) AS took FROM c WHERE upto <= (SELECT 3 * sum(size) // 2 FROM d) GROUP BY row)
SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(took, 0)::BIGINT AS taken FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN k USING (row)
"""
