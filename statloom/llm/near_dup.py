"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Every distinct text becomes a set of five-word shingles, all of weight 1: links are
judged on sets, and only equal weights make the probability Jaccard similarity the
Jaccard similarity of the sets. Each shingle is a Poisson process with its weight as rate whose
arrivals fall on random registers; a register keeps the shingle that arrives
first, and a shingle is given up once its next arrival is later than every
register's (ProbMinHash). Two texts agree in a register with the Jaccard similarity
of their shingles. Registers are hashed in bands; texts that
share a band are candidates, and a candidate pair becomes a link only if the
Jaccard similarity of the two whole shingle sets is at least the threshold.

Buckets are first thinned out by rounds that are linear in their members: each
member meets the bucket's least text; then, in buckets of several classes, its
neighbours in the order of each of the three following bands; then a text of
another class, drawn anew in each round, as long as a round halves what is mixed.
What is still mixed is finished exactly: the texts of all mixed buckets are joined on the
rarest shingles of each (prefix filter), in salted pieces and between different
classes only, and every pair that can reach the threshold is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, map_rows, scratch, spread_join, written

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 4
#: Members of a bucket that one window task orders; larger buckets are cut by the next band's hash. Of a shingle's texts in the exact join, the size of a salted piece.
PIECE = 2048
#: Cells that shingles are counted in to order them by rarity. Any order is exact; a good one makes fewer pairs.
CELLS = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Words in a task's table of hashes before it is emptied: bounds a worker's memory.
TABLE = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, known: dict[bytes, int] | None = None, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the lower-cased words (as 64-bit hashes, sorted) and their counts. A text of fewer than ``k`` words, but not none, is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    known = {} if known is None else known
    if len(known) > TABLE:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    x = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(x))
    h = np.zeros(len(x) - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + x[j : j + len(h)]
    return np.unique(_mix(h + np.uint64(k)), return_counts=True)


def prob_min_hash(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Registers of each weighted set: the hash of the shingle that arrives first; 0 for an empty set. All sets advance together, arrival by arrival."""
    sizes = [len(s) for s, _ in sets]
    ids = np.zeros(len(sets) * m, np.uint64)
    if not sum(sizes):
        return ids.reshape(len(sets), m)
    elem = np.concatenate([s for s, _ in sets])
    rate = 1.0 + np.log(np.concatenate([c for _, c in sets]))
    doc = np.repeat(np.arange(len(sets)), sizes)
    first = np.full(len(sets) * m, np.inf)
    t, step = np.zeros(len(elem)), 0
    while len(elem):
        step += 1
        r = _mix(elem + np.uint64(step * int(_GOLD) % 2**64))
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        cell = doc * m + (_mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, cell, t)
        won = first[cell] == t
        ids[cell[won]] = elem[won]
        latest = first.reshape(len(sets), m).max(axis=1)
        go = t < latest[doc]
        elem, rate, doc, t = elem[go], rate[go], doc[go], t[go]
    return ids.reshape(len(sets), m)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for b in batches:
        sets = [shingle_hashes(t.as_py(), known) for t in b.column("text")]
        ids = prob_min_hash([(s, np.ones_like(c)) for s, c in sets], bands * rows).reshape(len(sets), bands, rows)
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), ids.shape[:2]) * _GOLD
        for j in range(rows):
            h = _mix(h + ids[:, :, j])
        n = np.array([len(s) for s, _ in sets], np.int64)
        flat = pa.array(h.view(np.int64).ravel(), pa.int64())
        offsets = pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(n), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "h", "n", "bands"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([shingle_hashes(t.as_py(), known)[0].tobytes() for t in b.column("text")], pa.binary())], ["h", "s"])


def _overlap(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for i, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep, pa.int64())), b.column("b").take(pa.array(keep, pa.int64()))], ["a", "b"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles per cell, summed within the task."""
    n = np.zeros(CELLS, np.int64)
    for b in batches:
        for s in b.column("s"):
            n += np.bincount((np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(n)
    for i in range(0, len(at), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 65_536]), pa.array(n[at[i : i + 65_536]])], ["cell", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], threshold: float, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each text with their places in the order by rarity: two texts that reach the threshold share one of them."""
    for b in batches:
        size, token, place = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for s in b.column("s"):
            x = np.frombuffer(s.as_buffer(), np.uint64)
            k = min(len(x), len(x) - math.ceil(threshold * len(x) - 1e-9) + 1)
            token.append(x[np.lexsort((x, common[(x % np.uint64(CELLS)).astype(np.int64)]))[:k]])
            place.append(np.arange(k))
            size.append(k)
        row = pa.array(np.repeat(np.arange(len(size)), size), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(place), pa.int64()), *[b.column(c).take(row) for c in ("h", "n", "c")]], ["token", "place", "h", "n", "c"])


def prefix_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, na, b, nb) of different classes that can reach the threshold, none left out. ``texts`` has h, n, c and s (shingles)."""
    common = np.zeros(CELLS, np.int64)
    for r in map_rows(texts.select("s"), _cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        common[r.cell] = r.n
    of = written(map_rows(texts.select("h", "n", "c", "s"), lambda it: _prefixes(it, threshold, common), "token long, place long, h binary, n long, c binary"))
    token = of.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("least_c"), F.max("c").alias("most_c")).filter("least_c <> most_c")
    of = of.join(token.select("token", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces")), "token")
    one = of.select("token", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("h").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("place").alias("pa"))
    two = of.select(F.col("token").alias("t"), F.pmod(F.xxhash64("h"), F.col("pieces")).cast("int").alias("p"), F.col("h").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("place").alias("pb"))
    # at the first shingle that two texts share, no more can be shared than what follows it in both
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    can = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9) & (most >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6)
    return one.join(two, (F.col("token") == F.col("t")) & (F.col("piece") == F.col("p")) & (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & can).select("a", "na", "b", "nb")


def text_key(col: str = "text"):
    """16 bytes that stand for a text; null stands for itself."""
    return F.unhex(F.md5(F.col(col)))


def components(links: DataFrame, label: DataFrame) -> DataFrame:
    """``label`` (h, c) after merging the classes that ``links`` (a, b) join; c is the least h of a class.

    Each step hooks every class to its least linked class and follows the hooks
    to their ends; classes only ever get smaller labels, so it stops after about
    the logarithm of the longest chain of classes.
    """
    la, lb = label.select(F.col("h").alias("a"), F.col("c").alias("ca")), label.select(F.col("h").alias("b"), F.col("c").alias("cb"))
    edges = written(links.join(la, "a").join(lb, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).distinct())
    if edges.isEmpty():
        return label
    root = None  # (y, x): class y is now part of class x < y
    while True:
        hook = written(edges.groupBy("y").agg(F.min("x").alias("x")))
        while True:  # follow hooks
            up = hook.select(F.col("y").alias("x"), F.col("x").alias("xx"))
            jumped = written(hook.join(up, "x", "left").select("y", F.coalesce("xx", "x").alias("x"), F.col("xx").isNotNull().alias("moved")))
            hook = jumped.select("y", "x")
            if jumped.filter("moved").isEmpty():
                break
        if root is None:
            root = hook
        else:
            up = hook.select(F.col("y").alias("x"), F.col("x").alias("xx"))
            root = written(root.join(up, "x", "left").select("y", F.coalesce("xx", "x").alias("x")).unionByName(hook))
        to_x, to_y = hook.select(F.col("y").alias("x"), F.col("x").alias("nx")), hook.select("y", F.col("x").alias("ny"))
        e = edges.join(to_x, "x", "left").join(to_y, "y", "left").select(F.coalesce("nx", "x").alias("p"), F.coalesce("ny", "y").alias("q")).filter("p <> q")
        edges = written(e.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
        if edges.isEmpty():
            break
    to = root.select(F.col("y").alias("c"), F.col("x").alias("nc"))
    return written(label.join(to, "c", "left").select("h", F.coalesce("nc", "c").alias("c")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(h, n) and (h_, n_) as (a, na) and (b, nb), a being the less."""
    low = F.col("h") < F.col("h_")
    return pairs.select(F.least("h", "h_").alias("a"), F.greatest("h", "h_").alias("b"), F.when(low, F.col("n")).otherwise(F.col("n_")).alias("na"), F.when(low, F.col("n_")).otherwise(F.col("n")).alias("nb"))


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document row: doc_id, class_id, class_size, n (distinct shingles), h (16 bytes of the text), class_key (the least h of the class).

    class_id is the least doc_id of the class, class_size its number of rows.
    Rows with an equal text are one class. Texts without words (null or only
    white space) are equal to no other text: each row has its own doc_id as
    class and size 1. Rows with a null doc_id take part; a class of nulls only
    has a null class_id. doc_id may have any type that has an order; an empty
    table gives no rows. Columns other than doc_id and text are not looked at.
    """
    with scratch(docs.sparkSession):
        return _classes(docs, threshold, bands, rows)


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", text_key())
    signed = written(map_rows(base, lambda it: _sign(it, bands, rows), f"doc_id {dict(docs.dtypes)['doc_id']}, h binary, n long, bands array<long>"), stay=True)
    own = signed.filter("n > 0")
    texts = own.groupBy("h").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("doc_id").alias("one"))
    member = texts.select("h", "n", "one", "bands", F.posexplode("bands").alias("band", "key"))
    member = member.select("h", "n", "one", "band", "key", *[F.element_at("bands", ((F.col("band") + j) % bands + 1).cast("int")).alias(f"next{j}") for j in (1, 2, 3)])
    member = written(member)
    bucket = written(member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("h").alias("first_h")).filter("size > 1").withColumn("rows", F.col("size")))
    member = written(spread_join(member, bucket, ["band", "key"], "rows"))
    active = written(member.select("h", "one").distinct())
    # of the copies of a text one is enough: that with the least doc_id
    reps = active.select(F.col("h").alias("h_"), F.col("one"))
    once = base.filter("h is not null").join(reps.hint("shuffle_hash"), (F.col("h") == F.col("h_")) & F.col("doc_id").eqNullSafe(F.col("one")), "left_semi")
    sets = map_rows(once.select("h", "text"), _shingles, "h binary, s binary").groupBy("h").agg(F.first("s").alias("s"))
    sets = written(sets)

    def verified(pairs: DataFrame) -> DataFrame:
        near = pairs.filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9).select("a", "b").distinct()
        a, b = sets.select(F.col("h").alias("a"), F.col("s").alias("sa")), sets.select(F.col("h").alias("b"), F.col("s").alias("sb"))
        return written(map_rows(near.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), lambda it: _overlap(it, threshold), "a binary, b binary"))

    count = member.select("h", "n").distinct()
    first = member.filter("h <> first_h").select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("first_h").alias("b")).distinct()
    label = active.select("h", F.col("h").alias("c"))
    label = components(verified(first.join(count.select(F.col("h").alias("b"), F.col("n").alias("nb")), "b")), label)
    turn, rows_before = 0, 0
    while True:
        now = written(member.join(label, "h"))
        mixed = now.groupBy("band", "key").agg(F.min("c").alias("least_c"), F.max("c").alias("most_c"), F.count(F.lit(1)).alias("rows")).filter("least_c <> most_c")
        now = written(spread_join(now, written(mixed.select("band", "key", "rows")), ["band", "key"], "rows"))
        left = now.count()
        if not left:
            break
        if turn > 1 and 2 * left > rows_before:  # what is left needs all pairs
            links = verified(prefix_pairs(written(now.select("h", "n", "c").distinct().join(sets, "h")), threshold))
            label = components(links, label)
            break
        if turn:  # a text of the first class in an order that is new in each round; its own class meets one of the last class
            x = F.struct(F.xxhash64("c", F.lit(turn)).alias("x"), F.xxhash64("h", F.lit(turn)).alias("y"), "h", "n", "c")
            ends = written(now.groupBy("band", "key").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("rows")))
            other = F.when(F.col("c") == F.col("lo.c"), F.col("hi")).otherwise(F.col("lo"))
            pairs = _ordered(spread_join(now, ends, ["band", "key"], "rows").select("h", "n", "c", other["h"].alias("h_"), other["n"].alias("n_"), other["c"].alias("c_")).filter("c <> c_"))
        else:
            pairs = None
            for j in (1, 2, 3):
                piece = F.pmod(F.xxhash64(f"next{j}"), F.ceil(F.col("size") / PIECE))
                order = Window.partitionBy("band", "key", piece).orderBy(f"next{j}", f"next{j % 3 + 1}", "n", "h")
                p = _ordered(now.select("h", "n", "c", *[F.lag(x).over(order).alias(f"{x}_") for x in ("h", "n", "c")]).filter("h_ is not null and c <> c_"))
                pairs = p if pairs is None else pairs.unionByName(p)
        label = components(verified(pairs), label)
        turn, rows_before = turn + 1, left
    # rows are added up per text, texts per class, and the sums are joined back the same way
    text = own.groupBy("h").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    text = written(text.join(label, "h", "left").select("h", F.coalesce("c", "h").alias("c"), "id", "rows"))
    classes = written(text.groupBy("c").agg(F.min("id").alias("class_id"), F.sum("rows").alias("class_size"), F.count(F.lit(1)).alias("texts")))
    text = written(spread_join(text, classes, ["c"], "texts"), stay=True)
    alone = signed.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "n", "h", F.lit(None).cast("binary").alias("class_key"))
    worded = spread_join(own.select("doc_id", "h", "n"), text.select("h", "class_id", "class_size", F.col("c").alias("class_key"), "rows"), ["h"], "rows")
    return worded.select("doc_id", "class_id", "class_size", "n", "h", "class_key").unionByName(alone)


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: that with the least doc_id (nulls first; of equal ids, that with the least text key; of equal rows, one). Texts without words all stay."""
    of = near_duplicate_classes(docs, threshold)
    i, k, h = (fresh(docs, x) for x in ("__i", "__k", "__h"))
    stay = of.filter("n > 0").groupBy("class_key").agg(F.min(F.struct("doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias(i), F.col("k.h").alias(k))
    rows = docs.withColumn(h, text_key())
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    one = rows.filter(worded).join(stay, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(k)), "left_semi")
    return one.dropDuplicates(["doc_id", h]).unionByName(rows.filter(~worded)).select(*docs.columns)
