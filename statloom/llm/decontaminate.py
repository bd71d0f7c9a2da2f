"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

The shingles of an item are its windows of ten consecutive words. A document
contains a window only if it contains every word of it, so the rarest word of a
window (by the number of documents words of the whole corpus) is a sufficient
prefix: document words are joined to the windows on that word alone. The word's
place in the window fixes where the window would have to start, which bounds the
position and the length left in the document; the candidate is then verified
word by word at that place.

The documents' words, with a number per row, are written once and read by every
pass: a text is split once, and the numbers do not depend on how a scan is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_KEYS, HOT_ROWS, SALTS, ascii_lower, fresh, numbered, written

#: What parts the words of this operator, which are of digits, a-z and everything beyond ASCII. Splitting there takes a sixth of the time of extracting the words, with the lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Above this many different prefix words the documents' words are shuffled to the windows; up to it the windows (of at most WINDOW words each) are broadcast.
BROADCAST_WINDOWS = 50_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win: the different windows of every item; an item of fewer words, but not none, is one window."""
    words = items.select("item_id", tokens(F.col("text")).alias("ws")).filter("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("win")).distinct()


def window_hits(words: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, occurrences): ``wid, item_id, win`` and ``row, start, len, wid`` (start from 0). ``words`` has row and ws, the words, and has to be a table, as it is read several times."""
    shingles = written(item_windows(items, window).withColumn("wid", F.sha2(F.array_join("win", " "), 256)))
    wins = shingles.select("wid", "win").distinct()
    vocab = wins.select(F.explode("win").alias("w")).distinct()
    few = wins.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    # rarity over all documents, of the words that windows have
    every, n = words.select(F.explode("ws").alias("w")), F.count(F.lit(1)).alias("df")
    common = every.join(F.broadcast(vocab), "w", "left_semi").groupBy("w").agg(n) if few else every.groupBy("w").agg(n).join(vocab, "w", "left_semi")
    rarest = Window.partitionBy("wid").orderBy(F.coalesce("df", F.lit(0)), "w", "at")
    # a word that many windows have must not bring them all to one task: the counts of few words go to every task, those of many are dealt
    of = wins.select("wid", "win", F.posexplode("win").alias("at", "w"))
    if few:
        counted = of.join(F.broadcast(common), "w", "left")
    else:
        piece = F.pmod(F.xxhash64("wid"), F.lit(SALTS)).cast("int")
        counted = of.withColumn("piece", piece).join(common.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["w", "piece"], "left")
    prefix = counted.withColumn("r", F.row_number().over(rarest)).filter("r = 1 and df > 0").select("wid", "win", "at", "w", "df")
    prefix = written(prefix)
    if few:
        at = words.select("row", "ws", F.posexplode("ws").alias("pos", "w"))
        fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.size("win") <= F.size("ws"))
        same = F.slice("ws", F.col("pos") - F.col("at") + 1, F.size("win")) == F.col("win")
        hits = at.join(F.broadcast(prefix), (at["w"] == prefix["w"]) & fits & same)
    else:
        # the words around each position travel with it, so that no text is repeated
        near = F.slice("ws", F.greatest(F.col("pos") - window + 2, F.lit(1)), 2 * window - 1)
        at = words.select("row", "ws", F.posexplode("ws").alias("pos", "w")).select("row", "w", "pos", near.alias("near"), F.least("pos", F.lit(window - 1)).alias("before"))
        same = F.slice("near", F.col("before") - F.col("at") + 1, F.size("win")) == F.col("win")
        # words with more than a share of all positions, of which there are fewer than BROADCAST_KEYS, are dealt into pieces
        asked = prefix.groupBy("w").agg(F.max("df").alias("df"))
        most = max(HOT_ROWS, (asked.agg(F.sum("df")).first()[0] or 0) // BROADCAST_KEYS)
        pieces = F.least(F.ceil(F.col("df") / most), F.lit(SALTS)).cast("int")
        hot = asked.filter(F.col("df") > most).select(F.col("w").alias("hot_w"), pieces.alias("pieces"))
        at = at.join(F.broadcast(hot), F.col("w") == F.col("hot_w"), "left").withColumn("piece", F.pmod(F.xxhash64("row", "pos"), F.coalesce("pieces", F.lit(1))).cast("int"))
        prefix = prefix.select("wid", "win", F.col("at"), F.col("w").alias("asked_w"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("asked_piece"))
        hits = at.join(prefix, (F.col("w") == F.col("asked_w")) & (F.col("piece") == F.col("asked_piece")) & (F.col("before") >= F.col("at")) & same)
    return shingles, hits.select("row", (F.col("pos") - F.col("at")).alias("start"), F.size("win").alias("len"), "wid")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words; an item without words has no window. Items with
    equal texts all count. A null doc_id is kept; repeated rows are each their
    own row; a null item_id is left out of items_sha256 and n_items, but its
    windows hit. With no hit, items_sha256 is that of the empty text.
    """
    base = numbered(docs.select("doc_id", tokens(F.col("text")).alias("ws")), "row")
    shingles, hits = window_hits(base.select("row", "ws"), items, window)
    hits = written(hits.distinct())
    spans = hits.select("row", "start", (F.col("start") + F.col("len")).alias("stop")).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    # union of the spans of one text, in order: (words so far, end so far)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))
    n_hit = spans.select("row", F.aggregate("spans", zero, step)["n"].cast("long").alias("n_hit"))
    which = hits.select("row", "wid").distinct().join(shingles.select("wid", F.col("item_id").cast("string").alias("item")), "wid").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = n_hit.join(which, "row", "left")
    out = base.select("row", "doc_id", F.size("ws").cast("long").alias("n_words")).join(found, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    row, ws = fresh(docs, "__row"), fresh(docs, "__ws")
    rows = numbered(docs.withColumn(ws, tokens(F.col("text"))), row)
    _, hits = window_hits(rows.select(F.col(row).alias("row"), F.col(ws).alias("ws")), items, window)
    bad = written(hits.select(F.col("row").alias(row)).distinct())
    return rows.join(bad, row, "left_anti").select(*docs.columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, ws[s : s + 9] AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT row, s, n, ws[s : s + n - 1] AS win FROM (SELECT row, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT row, s, n, item_id FROM dw JOIN iw USING (win)),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS p FROM hit) GROUP BY row),
items AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
"""
