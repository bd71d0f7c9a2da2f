"""N-gram Jaccard self-join by rare-first prefix filtering, as connected components.

A text is the set of its word n-grams. All sets are put in one order, n-grams of
rare cells first; two sets that reach the threshold share an n-gram among the
first few of each (prefix filter). Sets are joined on these prefix n-grams only,
and a pair goes on if

* their sizes are close enough (length filter),
* what follows the first n-gram they share is long enough in both (positional filter),
* what follows has classes of n-grams in common to a large enough extent (suffix filter; a sketch
  of one bit per class is compared while pairs are joined, the exact counts behind the shared
  n-gram afterwards);

then the two whole sets are compared, once per pair.

Equal sets are one set from the start. Where many sets share an n-gram, texts that
hang together are found first by rounds that are linear in the prefix n-grams: every
set of such an n-gram meets the most alike of a few of them. All pairs are formed, none left out,
of the sets that share an n-gram with few others, and of those of different components that
still share a frequent one, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, scratch, spread_join, written
from .near_dup import components, shingle_hashes, text_key

WORDS, THRESHOLD = 4, (85, 100)
#: Cells that n-grams are counted in to order them by rarity. Any order is exact; a good one makes fewer pairs.
CELLS = 1 << 18
#: Classes of n-grams that the suffix filter counts.
CLASSES = 64
#: Sets that share an n-gram, in one piece of the join between components.
PIECE = 2048
#: N-grams of a cell from which on the rows of one n-gram are dealt into pieces, and how many.
HOT_CELL, PIECES = 1 << 20, 64
#: Sets that are looked up by a broadcast of their texts' keys at most, and pairs that are sent to their sets instead of sets to pairs.
BROADCAST_SETS, BROADCAST_PAIRS = 250_000, 1 << 19
#: Bits of a set's sketch, in words of 64, and sets of an n-gram that the others choose from in a round.
SKETCH, HUBS = 8, 4
#: Rows of an n-gram up to which all its pairs are formed at once; rounds are for the others.
FEW = 16
#: Rounds go on as long as they leave at most this share of the components.
PROGRESS = 0.9
#: Rows of an Arrow batch that Python returns.
OUT_ROWS = 1 << 16

Threshold = tuple[int, int]


def prefix_length(n: int, t: Threshold) -> int:
    """How many n-grams of a set of ``n`` are its prefix."""
    return n + t[0] * n // -t[1] + 1


def set_key(s: np.ndarray) -> bytes:
    """12 bytes that stand for a set."""
    return xxhash.xxh3_128_digest(s.tobytes())[:12]


def sketch(s: np.ndarray) -> np.ndarray:
    """Per class of n-grams one bit, whether the set has an odd number of them. Two sets differ in at least as many n-grams as their sketches in bits."""
    odd = np.bincount(((s >> np.uint64(20)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _row_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Per text: key (null without words) and n; at the end of the task its n-grams per cell."""
    known: dict[bytes, int] = {}
    cells = np.zeros(CELLS, np.int64)
    ids = None
    for b in batches:
        keys, sizes, sketches = [], [], []
        for text in b.column("text"):
            s, _ = shingle_hashes(text.as_py(), known, words)
            keys.append(set_key(s) if len(s) else None)
            sizes.append(len(s))
            sketches.append(sketch(s))
            np.add.at(cells, (s % np.uint64(CELLS)).astype(np.int64), 1)
        ids = b.column("doc_id").type
        none = pa.nulls(len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), none, none], ["doc_id", "h", "key", "n", "g", "cell", "count"])
    at = np.flatnonzero(cells)
    for i in range(0, len(at), OUT_ROWS):
        some = at[i : i + OUT_ROWS]
        none = [pa.nulls(len(some), t) for t in (ids, pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(some), pa.array(cells[some])], ["doc_id", "h", "key", "n", "g", "cell", "count"])


def ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set in the one order: rare cells first."""
    return s[np.lexsort((s, common[(s % np.uint64(CELLS)).astype(np.int64)]))]


def _prefix_rows(batches: Iterator[pa.RecordBatch], words: int, t: Threshold, common: np.ndarray, hot: int) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for b in batches:
        tokens, places, keys, sizes, counts = [], [], [], [], []
        for text in b.column("text"):
            s, _ = shingle_hashes(text.as_py(), known, words)
            if len(s):
                k = prefix_length(len(s), t)
                tokens.append(ordered(s, common)[:k])
                places.append(np.arange(k))
                keys.append(set_key(s))
                sizes.append(len(s))
                counts.append(k)
        if not keys:
            continue
        row = np.repeat(np.arange(len(keys)), counts)
        token, place, key, size = np.concatenate(tokens), np.concatenate(places), pa.array(keys, pa.binary()), np.array(sizes, np.int64)
        # the rows of an n-gram that may be frequent are dealt by their set
        dealt = np.array([k[0] % PIECES for k in keys])
        piece = np.where(common[(token % np.uint64(CELLS)).astype(np.int64)] > hot, dealt[row], -1)
        token = token.view(np.int64)
        for i in range(0, len(row), OUT_ROWS):
            cut = slice(i, i + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(token[cut]), pa.array(piece[cut]), pa.array(place[cut]), key.take(pa.array(row[cut])), pa.array(size[row[cut]])], ["token", "piece", "place", "key", "n"])


def profile(s: np.ndarray, common: np.ndarray, t: Threshold) -> np.ndarray:
    """Bytes for the suffix filter: n-grams per class, then the classes of the prefix in order."""
    kind = ((s >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.int64)
    first = ordered(s, common)[: prefix_length(len(s), t)]
    lead = ((first >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.uint8)
    return np.concatenate([np.bincount(kind, minlength=CLASSES).astype(np.uint32).view(np.uint8), lead])


def _whole_sets(batches: Iterator[pa.RecordBatch], words: int, t: Threshold, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """key, s (the set), p (its profile)."""
    known: dict[bytes, int] = {}
    done: set[bytes] = set()  # equal rows with equal ids
    for b in batches:
        key, sets, profiles = [], [], []
        for text in b.column("text"):
            s, _ = shingle_hashes(text.as_py(), known, words)
            if (k := set_key(s)) in done:
                continue
            done.add(k)
            key.append(k)
            sets.append(s.tobytes())
            profiles.append(profile(s, common, t).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(sets, pa.binary()), pa.array(profiles, pa.binary())], ["key", "s", "p"])


def suffix_classes(profile: np.ndarray, place: int) -> np.ndarray:
    """N-grams per class behind the prefix n-gram at ``place``."""
    return profile[: 4 * CLASSES].view(np.uint32).astype(np.int64) - np.bincount(profile[4 * CLASSES : 4 * CLASSES + place + 1], minlength=CLASSES)


def enough(both: int, na: int, nb: int, t: Threshold) -> bool:
    return t[1] * both >= t[0] * (na + nb - both)


def _suffix_filter(batches: Iterator[pa.RecordBatch], t: Threshold) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for i, (x, y, px, py, na, nb) in enumerate(zip(b.column("p_a"), b.column("p_b"), *(b.column(c).to_pylist() for c in ("pa", "pb", "na", "nb")), strict=True)):
            u, v = (suffix_classes(np.frombuffer(z.as_buffer(), np.uint8), p) for z, p in ((x, px), (y, py)))
            if enough(1 + int(np.minimum(u, v).sum()), na, nb, t):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], t: Threshold) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for i, (x, y) in enumerate(zip(b.column("s_a"), b.column("s_b"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), t):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def close_sizes(na: str, nb: str, t: Threshold) -> Column:
    """The length filter."""
    return F.least(na, nb) * t[1] >= F.greatest(na, nb) * t[0]


def long_behind(na: str, pa: str, nb: str, pb: str, t: Threshold) -> Column:
    """The positional filter: if the n-gram at these places is the first that both share, what is behind it has to be long enough."""
    return F.least(F.col(na) - F.col(pa), F.col(nb) - F.col(pb)) * (t[0] + t[1]) >= (F.col(na) + F.col(nb)) * t[0]


def apart(g: Column, g_: Column) -> Column:
    """Bits in which two sketches differ."""
    bits = [F.bit_count(F.get(g, F.lit(i)).bitwiseXOR(F.get(g_, F.lit(i)))) for i in range(SKETCH)]
    return sum(bits[1:], bits[0])


def close_sketches(g: str, n: str, g_: str, n_: str, t: Threshold) -> Column:
    """Sets that reach the threshold differ in so few n-grams, so in no more bits."""
    return apart(F.col(g), F.col(g_)) * (t[0] + t[1]) <= (F.col(n) + F.col(n_)) * (t[1] - t[0])


def shared_prefixes(tokens: DataFrame, t: Threshold) -> DataFrame:
    """token, h, place, n, few of the sets that share a prefix n-gram with another that may be like them, once each; few: the n-gram has at most FEW rows. Rows in pieces are not judged: they are frequent."""
    w = Window.partitionBy("token", "piece")
    o = w.orderBy("n", "key")
    # at the first n-gram that two sets share, the smaller one is in the early part of its prefix
    early = (F.col("n") - F.col("place")) * (t[0] + t[1]) >= F.col("n") * (2 * t[0])
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = {"was": F.lag("key").over(o), "below": F.lag("n").over(o), "above": F.lead("n").over(o), "lo": F.first("key").over(whole), "hi": F.last("key").over(whole), "early": F.max(early).over(whole), "rows": F.count(F.lit(1)).over(whole)}
    seen = tokens.select("token", F.col("key").alias("h"), "place", "n", "piece", *[c.alias(k) for k, c in over.items()])
    # if any set passes the filters with this one, then the next one by size does
    like = (F.col("below").isNotNull() & close_sizes("n", "below", t)) | (F.col("above").isNotNull() & close_sizes("n", "above", t) & ((F.col("n") - F.col("place")) * (t[0] + t[1]) >= (F.col("n") + F.col("above")) * t[0]))
    pairs = (F.col("lo") != F.col("hi")) & F.col("early") & like
    return seen.filter(~F.col("h").eqNullSafe(F.col("was")) & ((F.col("piece") >= 0) | pairs)).select("token", "h", "place", "n", ((F.col("piece") < 0) & (F.col("rows") <= FEW)).alias("few"))


def _side(df: DataFrame, x: str) -> list[Column]:
    return [F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"), F.col("g").alias(f"g{x}")]


def _can_link(t: Threshold) -> Column:
    return (F.col("a") < F.col("b")) & close_sizes("na", "nb", t) & long_behind("na", "pa", "nb", "pb", t) & close_sketches("ga", "na", "gb", "nb", t)


def few_pairs(members: DataFrame, t: Threshold) -> DataFrame:
    """(a, na, pa, b, nb, pb) of the sets that share an n-gram, once for each one. ``members`` has token, place, h, n and g, few rows of a token."""
    together = members.groupBy("token").agg(F.collect_list(F.struct("h", "n", "place", "g")).alias("sets"))  # FEW at most
    one = together.filter(F.size("sets") > 1).select("sets", F.explode("sets").alias("x")).select("sets", F.col("x.h").alias("a"), F.col("x.n").alias("na"), F.col("x.place").alias("pa"), F.col("x.g").alias("ga"))
    two = one.select("a", "na", "pa", "ga", F.explode(F.filter("sets", lambda y: y["h"] > F.col("a"))).alias("y"))
    return two.select("a", "na", "pa", "ga", F.col("y.h").alias("b"), F.col("y.n").alias("nb"), F.col("y.place").alias("pb"), F.col("y.g").alias("gb")).filter(_can_link(t)).select("a", "na", "pa", "b", "nb", "pb")


def joined_pairs(members: DataFrame, t: Threshold) -> DataFrame:
    """The same of sets of different components. ``members`` has c, too, and any number of rows of a token."""
    sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    of = members.join(sizes.select("token", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces")), "token")
    one = of.select("token", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("c").alias("ca"), *_side(of, "a"))
    two = of.select(F.col("token").alias("t"), F.pmod(F.xxhash64("h"), F.col("pieces")).cast("int").alias("p"), F.col("c").alias("cb"), *_side(of, "b"))
    on = (F.col("token") == F.col("t")) & (F.col("piece") == F.col("p")) & (F.col("ca") != F.col("cb")) & _can_link(t)
    return one.join(two, on).select("a", "na", "pa", "b", "nb", "pb")


def met(pairs: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """``pairs`` (with a and b) with the columns of ``facts`` (by key) of both, named by _a and _b. ``few``: pairs are sent to the facts, so that these are shuffled only once."""
    a, b = ([F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in facts.columns if c != "key"]] for x in "ab")
    if not few:
        return pairs.join(facts.select(*a), "a").join(facts.select(*b), "b")
    asked = pairs.select(F.col("b").alias("key")).distinct()
    return facts.select(*a).join(F.broadcast(pairs), "a").join(facts.join(F.broadcast(asked), "key", "left_semi").select(*b), "b")


def jaccard_components(docs: DataFrame, words: int = WORDS, threshold: Threshold = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their sets is at least
    ``threshold`` (a fraction of integers, compared exactly); component_id is the
    least doc_id that can be reached by links. Words are lower-cased in A-Z. A
    document of fewer than ``words`` words has one n-gram, all its words; one
    without words, or with a null text, has none and links with nothing, not even
    with another of its kind. Rows with equal sets link, whatever their ids; null
    ids take part, but are the least of a component only if it has no other.
    An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    with scratch(docs.sparkSession):
        return _components(docs, words, threshold)


def _components(docs: DataFrame, words: int, t: Threshold) -> DataFrame:
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", text_key())
    seen = written(map_rows(base, lambda it: _row_sets(it, words), f"doc_id {kind}, h binary, key binary, n long, g array<long>, cell long, count long"), stay=True)
    rows = seen.filter("cell is null").select("doc_id", "h", "key", "n", "g")
    common = np.zeros(CELLS, np.int64)
    counted = seen.filter("cell is not null").groupBy("cell").agg(F.sum("count").alias("n")).toArrow()  # at most CELLS rows
    common[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    # sets by their key: the least id, and one text that has the set
    own = rows.filter("n > 0")
    sets = written(own.groupBy("key").agg(F.min("doc_id").alias("id"), F.min(F.struct("h", "doc_id")).alias("text"), F.first("n").alias("n"), F.first("g").alias("g"), F.count(F.lit(1)).alias("rows")))
    hot = HOT_CELL
    tokens = map_rows(base.select("text"), lambda it: _prefix_rows(it, words, t, common, hot), "token long, piece long, place long, key binary, n long")
    info = sets.select(F.col("key").alias("h"), "g")
    every = written(shared_prefixes(tokens, t).join(info, "h"))
    whole, tried = None, None

    def sets_of(pairs: DataFrame) -> DataFrame:
        """key, s, p of the sets in ``pairs`` and of earlier ones, each made from one text the first time that it is asked for."""
        nonlocal whole
        asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        if whole is not None:
            asked = asked.join(whole.select("key"), "key", "left_anti")
        wanted = written(asked.join(sets, "key").select(F.col("text.h").alias("h_"), F.col("text.doc_id").alias("id_")))
        few = wanted.count() <= BROADCAST_SETS
        one = base.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), (F.col("h") == F.col("h_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi")
        new = written(map_rows(one.select("text"), lambda it: _whole_sets(it, words, t, common), "key binary, s binary, p binary"))
        whole = new if whole is None else whole.unionByName(new)
        return whole

    def verified(pairs: DataFrame) -> DataFrame:
        both = met(pairs.select("a", "b"), sets_of(pairs).select("key", "s"), pairs.count() <= BROADCAST_PAIRS)
        return written(map_rows(both.select("a", "b", "s_a", "s_b"), lambda it: _verify(it, t), "a binary, b binary"))

    label = written(every.select("h").distinct().withColumn("c", F.col("h")))
    now = every.filter("not few").drop("few")
    turn, before = 0, 0
    while True:
        # components only merge: an n-gram whose sets are in one of them is done
        now = now.drop("c").join(label, "h")
        if turn:
            mixed = written(now.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi").select("token", "rows"))
            now = spread_join(now, mixed, ["token"], "rows")
        now = written(now)
        left = now.agg(F.count_distinct("c")).first()[0]
        if not left or (turn > 1 and left > PROGRESS * before):
            break
        # some sets of an n-gram and a range of sizes, mostly the same ones for many n-grams, others in each round: every other set meets the one most like it by the sketches
        size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(t[1] / t[0])) + 0.5 * (turn % 2)).alias("size")
        banded = now.select("token", "place", "h", "n", "c", "g", size)
        # the sets in which the n-gram comes first have the least of their own, so they are like many others
        rank = [F.col("place") if i < HUBS // 2 else F.lit(0).cast("long") for i in range(HUBS)]
        hubs = [F.min(F.struct(rank[i].alias("rank"), F.xxhash64("h", F.lit(turn), F.lit(i)).alias("x"), "h", "n", "place", "c", "g")).alias(f"hub{i}") for i in range(HUBS)]
        some = banded.groupBy("token", "size").agg(*hubs, F.count(F.lit(1)).alias("rows"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").drop("lo", "hi")
        choice = spread_join(banded, written(some), ["token", "size"], "rows")
        best = []
        for i in range(HUBS):
            hub = {c: f"hub{i}.{c}" for c in ("h", "n", "place", "c", "g")}
            fits = (F.col("c") != F.col(hub["c"])) & close_sizes("n", hub["n"], t) & long_behind("n", "place", hub["n"], hub["place"], t) & close_sketches("g", "n", hub["g"], hub["n"], t)
            best.append(F.when(fits, F.struct(apart(F.col("g"), F.col(hub["g"])).alias("apart"), F.col(hub["h"]).alias("h"))))
        near = choice.select("h", F.least(*best).alias("hub")).filter("hub is not null").groupBy("h").agg(F.min("hub").alias("hub"))
        pairs = near.select(F.least("h", "hub.h").alias("a"), F.greatest("h", "hub.h").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        label = components(verified(pairs), label)
        turn, before = turn + 1, left
    met_at = few_pairs(every.filter("few"), t)
    if left:
        met_at = met_at.unionByName(joined_pairs(now, t))
    pairs = met_at.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.min(F.struct("pa", "pb")).alias("at")).select("a", "na", "at.pa", "b", "nb", "at.pb")
    pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))

    def between(pairs: DataFrame) -> DataFrame:
        of_a, of_b = label.select(F.col("h").alias("a"), F.col("c").alias("ca")), label.select(F.col("h").alias("b"), F.col("c").alias("cb"))
        return written(pairs.join(of_a, "a").join(of_b, "b").filter("ca <> cb").drop("ca", "cb"))

    pairs = between(pairs) if turn else pairs
    both = met(pairs, sets_of(pairs).select("key", "p"), pairs.count() <= BROADCAST_PAIRS)
    close = written(map_rows(both, lambda it: _suffix_filter(it, t), "a binary, b binary"))
    # a set meets one other first; most of the pairs that are left are within a component then
    first = written(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    label = components(verified(first), label)
    rest = between(close.join(first, ["a", "b"], "left_anti"))
    label = components(verified(rest), label)
    # the least id of a component goes back to its sets, then to the rows of each set
    of = written(sets.select("key", "id", "rows").join(label.withColumnRenamed("h", "key"), "key", "left").select("key", "id", "rows", F.coalesce("c", "key").alias("c")))
    least = written(of.groupBy("c").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("sets")))
    of = written(spread_join(of, least, ["c"], "sets").select("key", "component_id", "rows"), stay=True)
    worded = spread_join(own, of, ["key"], "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return worded.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, doc_id, list_sort(list_distinct(list_transform(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 3, 1) + 1 END), lambda i: array_to_string(ws[i : i + 3], ' ')))) AS s FROM d),
u AS (SELECT s, min(doc_id) AS id, row_number() OVER () AS k, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY s),
w AS (SELECT k, n, unnest(s) AS w FROM u),
e AS (SELECT a.k AS x, b.k AS y FROM w a JOIN w b ON a.w = b.w AND a.k < b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT k, k AS z FROM u),
reach AS (WITH RECURSIVE t AS (SELECT k, k AS z FROM u UNION SELECT t.k, b.y FROM t JOIN b ON b.x = t.z) SELECT k, z FROM t),
m AS (SELECT reach.k, min(o.id) AS component_id FROM reach JOIN u o ON o.k = reach.z GROUP BY reach.k)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, coalesce(m.component_id, g.doc_id) AS component_id FROM g LEFT JOIN u ON u.s = g.s AND len(g.s) > 0 LEFT JOIN m ON m.k = u.k
"""
