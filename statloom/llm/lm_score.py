"""Language-model scoring with a causal self-attention model trained in numpy.

A text is a sequence of words. Each word belongs to the class of its leading
subword: the longest of ``CLASSES - 3`` subwords, taken from a public tokenizer's
vocabulary file, with which the word begins (the ids 0 to 2 are the start, the
end and "other"). A small causal self-attention network gives the probability of
the next word's class from the classes before it; corpus counts over *all*
training documents give the probability of the word within its class, with one
unseen word per class. The product is a proper distribution over words:

    log10 P(text) = sum log10 P(class | window) + log10 (c + 1) / (N_k + V_k + 1)

Windows of ``WINDOW`` positions overlap: each window after the first repeats the
last ``WINDOW - STRIDE`` positions as context only, so every word and the end are
scored exactly once, and all windows of a batch run through masked attention
together.

What is gathered grows with the corpus: words, classes and their counts come from
all training documents. The network starts from ``MODEL_DOCS`` of them and is then
fitted further by every task on all windows of all its training documents; Spark
averages the tasks' weights.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_sample, map_rows, written

CLASSES, DIM, WINDOW, STRIDE = 128, 16, 32, 24
#: The network starts from this many training documents (least hash of the id) and is fitted further on one in SHARE of all, which is every one; the counts cover all of them.
MODEL_DOCS, SHARE = 600, 1
#: Every task holds the counts of the words that make up at least one in HEAD of all tokens, so of HEAD words at most: only the others of a text are shuffled.
HEAD = 1 << 19
#: Windows that a task fits at once, and words that it counts at once.
BLOCK, BLOCK_WORDS = 8192, 1_000_000
#: Words (or beginnings of words) in a worker's table before it is emptied, windows run at once, and windows that wait for it: all bound its memory.
TABLE, CHUNK, PENDING = 100_000, 128, 4096
START, END, OTHER = 0, 1, 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def subwords(path: str) -> set[bytes]:
    """The vocabulary's pieces of 1 to 6 bytes without white space, in lower case."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]).strip().lower() for line in f if line.strip()}
    return {p for p in pieces if 1 <= len(p) <= 6 and not p.split()[1:]}


def leading(word: bytes, pieces: set[bytes] | dict[bytes, int]) -> bytes | None:
    for n in range(min(6, len(word)), 0, -1):
        if word[:n] in pieces:
            return word[:n]
    return None


def _lead(batches: Iterator[pa.RecordBatch], pieces: set[bytes]) -> Iterator[pa.RecordBatch]:
    """Leading subwords of counted words, added up within the task (there are no more than subwords)."""
    seen: Counter[bytes] = Counter()
    for b in batches:
        for w, c in zip(b.column("w").to_pylist(), b.column("c").to_pylist(), strict=True):
            if w and (p := leading(w, pieces)) is not None:
                seen[p] += c
    yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["p", "c"])


def choose_classes(counts: DataFrame, pieces: set[bytes]) -> dict[bytes, int]:
    """The most frequent leading subwords of the counted words (w, c) get the ids from 3. A piece that is not chosen falls back to its longest chosen prefix."""
    best = map_rows(counts, lambda it: _lead(it, pieces), "p binary, c long").groupBy("p").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "p").limit(CLASSES - 3).collect()
    return {bytes(r.p): i + 3 for i, r in enumerate(best)}


def class_of(word: bytes, pieces: dict[bytes, int]) -> int:
    """The class of a counted word; the empty word is the end of a text."""
    p = leading(word, pieces)
    return END if not word else OTHER if p is None else pieces[p]


def _sizes(batches: Iterator[pa.RecordBatch], pieces: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for b in batches:
        k = np.array([class_of(w, pieces) for w in b.column("w").to_pylist()], np.int64)
        n += np.bincount(k, b.column("c").to_numpy(), CLASSES).astype(np.int64)
        v += np.bincount(k, minlength=CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], ["k", "n", "v"])


class _Table(dict):
    """The class of each beginning of a word that was met."""

    def __init__(self, pieces: dict[bytes, int]) -> None:
        self.pieces = pieces

    def __missing__(self, start: bytes) -> int:
        p = leading(start, self.pieces)
        self[start] = k = OTHER if p is None else self.pieces[p]
        return k


class Classifier:
    """Words to class ids, through a table that is emptied when it is full. A class depends on no more of a word than the longest piece has."""

    def __init__(self, pieces: dict[bytes, int]) -> None:
        self.table, self.longest = _Table(pieces), max(map(len, pieces), default=0)
        self.start = itemgetter(slice(self.longest))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.table) > TABLE:
            self.table.clear()
        return np.fromiter(map(self.table.__getitem__, map(self.start, words)), np.int64, len(words))

    def of_array(self, words: pa.Array) -> np.ndarray:
        coded = pc.binary_slice(words, 0, self.longest).dictionary_encode()
        return self(coded.dictionary.to_pylist())[coded.indices.to_numpy()]


def windows(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and which positions count, one row per window. ``seq`` has the start, the words and the end; it has n targets, each counted in one window."""
    n = len(seq) - 1
    k = 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)
    at = (np.arange(k) * STRIDE)[:, None] + np.arange(WINDOW)[None, :]
    inside = at < n
    fresh = inside & ((np.arange(WINDOW) >= WINDOW - STRIDE)[None, :] | (np.arange(k) == 0)[:, None])
    at = np.minimum(at, n - 1)
    return seq[at], seq[at + 1], fresh


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return {"E": g(CLASSES, DIM) * 3, "P": g(WINDOW, DIM), "Q": g(DIM, DIM), "K": g(DIM, DIM), "V": g(DIM, DIM), "W": g(DIM, 2 * DIM), "c": np.zeros(2 * DIM, np.float32), "U": g(2 * DIM, DIM), "O": g(DIM, CLASSES), "b": np.zeros(CLASSES, np.float32)}


#: What a position sees of its window, ones for sums of rows by one product, and the place of each weight of E.
_FUTURE, _ONE, _CELL = np.tril(np.ones((WINDOW, WINDOW), np.float32)), np.ones(CLASSES, np.float32), np.arange(CLASSES * DIM).reshape(CLASSES, DIM)
_MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)


def hidden(m: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Causal attention of each position to itself and those before it in the window, then a layer, both with a residual."""
    h = m["E"][x] + m["P"]
    q, k, v = h @ (m["Q"] / np.float32(np.sqrt(DIM))), h @ m["K"], h @ m["V"]
    a = q @ k.transpose(0, 2, 1) + _MASK
    a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=2, keepdims=True)
    r = h + a @ v
    z = np.maximum(r @ m["W"] + m["c"], 0)
    return h, q, k, v, a, r, z, r + z @ m["U"]


def log_probability(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, on: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each counted target, in the order of the windows. The same as :func:`hidden`, laid out for speed."""
    out = [np.empty(0)]
    qkv = np.concatenate([m["Q"] / np.float32(np.sqrt(DIM)), m["K"], m["V"]], axis=1)
    for i in range(0, len(x), CHUNK):
        xs, ys, os = x[i : i + CHUNK], y[i : i + CHUNK], on[i : i + CHUNK]
        h = (m["E"][xs] + m["P"]).reshape(-1, DIM)
        q, k, v = (z.reshape(len(xs), WINDOW, DIM) for z in np.split(h @ qkv, 3, axis=1))
        a = q @ k.transpose(0, 2, 1)
        np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a *= _FUTURE
        r = h + (a @ v).reshape(-1, DIM) / (a.reshape(-1, WINDOW) @ _ONE[:WINDOW])[:, None]
        r = r[os.ravel()]
        z = r @ m["W"]
        z += m["c"]
        np.maximum(z, 0, out=z)
        s = (r + z @ m["U"]) @ m["O"]
        s += m["b"]
        if max(s.max(), -s.min()) > 60:  # only then an exponential could overflow or vanish
            s -= s.max(axis=1, keepdims=True)
        got = s[np.arange(len(s)), ys[os]]
        out.append((got - np.log(np.exp(s, out=s) @ _ONE)).astype(np.float64) / np.log(10))
    return np.concatenate(out)


def gradient(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, on: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of the counted targets, by hand. The layers are those of :func:`hidden`, laid out for speed."""
    at, scale = np.flatnonzero(on), np.float32(1 / np.sqrt(DIM))
    wins = lambda w: w.reshape(len(x), WINDOW, -1)
    qkv = np.concatenate([m["Q"] * scale, m["K"], m["V"]], axis=1)
    h = (m["E"][x] + m["P"]).reshape(-1, DIM)
    q, k, v = (wins(z) for z in np.split(h @ qkv, 3, axis=1))
    a = q @ k.transpose(0, 2, 1)
    np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    a *= _FUTURE
    a /= wins(a.reshape(-1, WINDOW) @ _ONE[:WINDOW])
    seen = (a @ v).reshape(-1, DIM)
    r = (h + seen)[at]
    z = r @ m["W"]
    z += m["c"]
    np.maximum(z, 0, out=z)
    f = r + z @ m["U"]
    p = f @ m["O"]
    p += m["b"]
    if max(p.max(), -p.min()) > 60:
        p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    each = np.float32(1 / max(1, len(at)))
    p *= (each / (p @ _ONE))[:, None]
    p[np.arange(len(p)), y.ravel()[at]] -= each
    g = {"O": f.T @ p, "b": p.sum(axis=0)}
    df = p @ m["O"].T
    g["U"] = z.T @ df
    dz = (df @ m["U"].T) * (z > 0)
    g["W"], g["c"] = r.T @ dz, dz.sum(axis=0)
    df += dz @ m["W"].T
    dr = np.zeros_like(h)
    dr[at] = df
    ds = wins(dr) @ v.transpose(0, 2, 1)
    ds -= wins(np.einsum("ij,ij->i", dr, seen))
    ds *= a
    d = np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ wins(dr)], axis=2).reshape(-1, 3 * DIM)
    g["Q"], g["K"], g["V"] = np.split(h.T @ d, 3, axis=1)
    g["Q"] = g["Q"] * scale
    dr += d @ qkv.T
    g["P"], g["E"] = wins(dr).sum(axis=0), np.bincount(_CELL[x].ravel(), dr.ravel(), CLASSES * DIM)
    return g


def train(seqs: list[np.ndarray], seed: int = 1, epochs: int = 3, batch: int = 64, start: dict[str, np.ndarray] | None = None, top: float = 0.01) -> dict[str, np.ndarray]:
    """The network fitted on all windows of the sequences."""
    return train_windows([windows(s) for s in seqs if len(s) > 1], seed, epochs, batch, start, top)


def train_windows(parts: list[tuple[np.ndarray, ...]], seed: int = 1, epochs: int = 3, batch: int = 64, start: dict[str, np.ndarray] | None = None, top: float = 0.01) -> dict[str, np.ndarray]:
    """Adam on the mean cross-entropy of the counted targets of all windows; from ``start``, if given. ``top`` is the highest rate."""
    rng = np.random.default_rng(seed)
    m = init(rng) if start is None else start
    if not parts:
        return m
    x, y, on = (np.concatenate([p[i] for p in parts]) for i in range(3))
    if start is None:
        freq = np.bincount(y[on], minlength=CLASSES) + 0.5
        m["b"] = np.log(freq / freq.sum()).astype(np.float32)
        m["O"] *= np.float32(0.1)
    w = flat(m).astype(np.float32)
    m = unflat(w)  # views of w, which the steps change in place
    one, two = np.zeros_like(w), np.zeros_like(w)
    steps, t = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            t += 1
            some = order[i : i + batch]
            g = flat(gradient(m, x[some], y[some], on[some])).astype(np.float32)
            rate = top * min(1, t / 30) * (1 - 0.9 * t / steps)
            one += np.float32(0.1) * (g - one)
            two += np.float32(0.01) * (g * g - two)
            w -= np.float32(rate / (1 - 0.9**t)) * one / (np.sqrt(two / np.float32(1 - 0.99**t)) + np.float32(1e-8))
    return m


def framed(k: np.ndarray) -> np.ndarray:
    return np.concatenate([[START], k, [END]]).astype(np.int64)


def sequence(of: Classifier, words: list[bytes]) -> np.ndarray:
    return framed(of(words))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def flat_words(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The words of many texts, those that :func:`_words` gives of each, and the text of each word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty word
    return words.filter(some).cast(pa.binary()), pc.list_parent_indices(lists).filter(some)


def split_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word of many texts: its text and its number among the different words; and these."""
    words, text = flat_words(texts)
    coded = words.dictionary_encode()
    return text.to_numpy(), coded.indices.to_numpy(), coded.dictionary


def sequences(k: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The sequence of each text: ``k`` has the classes of the words of all, ``sizes`` how many each has."""
    for stop, n in zip(np.cumsum(sizes), sizes, strict=True):
        yield framed(k[stop - n : stop])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts, summed over BLOCK_WORDS words or a batch. The end of a text is the empty word."""
    parts, held, ends = [], 0, 0

    def out() -> pa.RecordBatch:
        nonlocal held
        seen, held = pa.chunked_array(parts, pa.binary()).value_counts(), 0
        parts.clear()
        return pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["w", "c"])

    for b in batches:
        parts.append(flat_words(b.column("text"))[0])
        held, ends = held + len(parts[-1]), ends + b.num_rows
        if held >= BLOCK_WORDS:
            yield out()
    if held:
        yield out()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], ["w", "c"])


_SHAPES = {k: v.shape for k, v in init(np.random.default_rng(0)).items()}


def flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in _SHAPES])


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in _SHAPES.values()])[:-1]
    return {k: x.reshape(s).astype(np.float32, copy=False) for (k, s), x in zip(_SHAPES.items(), np.split(v, cuts), strict=True)}


def _fit(batches: Iterator[pa.RecordBatch], pieces: dict[bytes, int], start: dict[str, np.ndarray] | None, block: int) -> Iterator[pa.RecordBatch]:
    """Fits the task's texts, block by block, and gives its weights times its windows: (i, v, n) per weight."""
    of, m, n, held, parts = Classifier(pieces), start, 0, 0, []

    def run() -> None:
        nonlocal m, n, held
        m = train_windows(parts, seed=1 + n % 997, start=m) if m is None else train_windows(parts, seed=1 + n % 997, epochs=1, start=m, top=0.002)
        n, held = n + held, 0
        parts.clear()

    for b in batches:
        text, at, words = split_texts(b.column("text"))
        for seq in sequences(of.of_array(words)[at], np.bincount(text, minlength=b.num_rows)):
            wins = windows(seq)
            for i in range(0, len(wins[0]), block):  # a very long text is fitted in stretches
                parts.append(tuple(w[i : i + block] for w in wins))
                held += len(parts[-1][0])
                if held >= block:
                    run()
    if parts:
        run()
    if n:
        v = flat(m).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v * n), pa.array(np.full(len(v), float(n)))], ["i", "v", "n"])


def fit_model(learn: DataFrame, pieces: dict[bytes, int], docs: int = MODEL_DOCS, share: int = SHARE) -> dict[str, np.ndarray]:
    """The network: fitted on ``docs`` documents in one task, then on one in ``share`` of all (by default all) by every task, whose weights are averaged by their windows."""

    def fitted(rows: DataFrame, start: dict[str, np.ndarray] | None, block: int) -> dict[str, np.ndarray] | None:
        sums = map_rows(rows.select("text"), lambda it: _fit(it, pieces, start, block), "i long, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("i").collect()
        return unflat(np.array([r.v for r in sums])) if sums else start

    first = fitted(id_sample(learn, docs).coalesce(1), None, 3 * BLOCK)
    if first is None:
        return init(np.random.default_rng(1))
    return fitted(learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), first, BLOCK)


def _score(batches: Iterator[pa.RecordBatch], pieces: dict[bytes, int], m: dict[str, np.ndarray], head: dict[bytes, int], base: float, room: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row (row, w, n, k) for each different word of a text whose count the task does not hold, and one for the whole text with what is known of it; its w is the row's number behind a space, which is no word."""
    of = Classifier(pieces)
    log_room = np.log10(room)
    end = head.get(b"", 0)
    for b in batches:
        rows = b.column("row").to_pylist()
        pending, held = [], 0
        text, at, words = split_texts(b.column("text"))
        each = words.to_numpy(zero_copy_only=False)
        kinds, have = of.of_array(words), np.fromiter(map(head.get, each, repeat(0)), np.int64, len(each))
        on, log = have[at] > 0, np.log10(have + 1)
        sums = lambda w: np.bincount(text[on], w[at[on]], len(rows))
        sizes = np.bincount(text, minlength=len(rows))
        tokens, seen = sizes + 1, np.bincount(text[on], minlength=len(rows)) + int(end > 0)
        known, part = sums(log - base) + np.log10(end + 1) - base, sums(log - log_room[kinds]) + np.log10(end + 1) - log_room[END]

        def run() -> None:
            nonlocal held
            x, y, on = (np.concatenate([p[1][i] for p in pending]) for i in range(3))
            who = np.repeat([p[0] for p in pending], [int(p[1][2].sum()) for p in pending])
            part[:] += np.bincount(who, log_probability(m, x, y, on), len(rows))
            pending.clear()
            held = 0

        for i, seq in enumerate(sequences(kinds[at], sizes)):
            pending.append((i, w := windows(seq)))
            held += len(w[0])
            if held >= PENDING:
                run()
        if pending:
            run()
        # the words that the task does not hold, once for each text
        pairs, n_out = np.unique(text[~on].astype(np.int64) * max(1, len(each)) + at[~on], return_counts=True)
        who, which = np.divmod(pairs, max(1, len(each)))
        none, whole = len(pairs), len(rows)
        pad = lambda v, t: pa.concat_arrays([pa.nulls(none, t), v])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.array(rows, np.int64)[who], np.array(rows, np.int64)])), pa.concat_arrays([words.take(pa.array(which)), pa.array([b" %d" % r for r in rows], pa.binary())]),
                pa.concat_arrays([pa.array(n_out), pa.nulls(whole, pa.int64())]), pa.concat_arrays([pa.array(kinds[which]), pa.nulls(whole, pa.int64())]),
                pad(pa.array(tokens), pa.int64()), pad(pa.array(seen), pa.int64()), pad(pa.array(known), pa.float64()), pad(pa.array(part), pa.float64()),
                pad(b.column("doc_id"), b.schema.field("doc_id").type), pad(b.column("held_out"), pa.bool_()),
            ],
            ["row", "w", "n", "k", "tokens", "seen", "known", "part", "doc_id", "held_out"],
        )


def lm_scores(docs: DataFrame, held_out=None, vocabulary: str | None = None, model_docs: int = MODEL_DOCS, head_words: int = HEAD) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a function from the doc_id column to a boolean column; by
    default crc32 of the id modulo 7 is 2. Counts and the model come from the
    other rows. A null or empty text has one token, its end. A null doc_id is
    hashed as the empty text; equal rows are scored alike, each on its own.
    With no training rows every word is unseen and the network is the untrained
    one. Other columns of ``docs`` are not looked at.
    """
    out = (held_out or (lambda c: crc_mod(c, 7) == 2))(F.col("doc_id"))
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), out.alias("held_out"))
    learn = base.filter(~F.col("held_out"))
    counts = written(map_rows(learn.select("text"), _count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")))
    pieces = choose_classes(counts, subwords(vocabulary or default_vocabulary()))
    # of each class: a fixed number of rows
    totals = map_rows(counts, lambda it: _sizes(it, pieces), "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = sum(r.n for r in totals), sum(r.v for r in totals)
    room = np.ones(CLASSES)
    for r in totals:
        room[r.k] = r.n + r.v + 1
    head = {bytes(r.w): r.c for r in counts.filter((F.col("w") == b"") | (F.col("c") * F.lit(head_words) >= F.lit(n))).collect()}
    model = fit_model(learn, pieces, model_docs)
    whole = float(np.log10(n + v + 1))
    words = map_rows(base.withColumn("row", F.monotonically_increasing_id()), lambda it: _score(it, pieces, model, head, whole, room), "row long, w binary, n long, k long, tokens long, seen long, known double, part double, doc_id " + dict(docs.dtypes)["doc_id"] + ", held_out boolean")
    rest = words.join(counts.hint("shuffle_hash"), "w", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(1).cast("double"))
    log_room = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(room)]), (F.col("k") + 1).cast("int"))
    seen = F.coalesce("seen", F.when(F.col("c").isNotNull(), F.col("n")), F.lit(0))
    b, s = F.coalesce("known", F.col("n") * (log_c - F.lit(whole))), F.coalesce("part", F.col("n") * (log_c - log_room))
    each = rest.select("row", "doc_id", "held_out", "tokens", seen.alias("seen"), b.alias("b"), s.alias("s"))
    return each.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("tokens").alias("n_tokens"), F.sum("seen").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.sum("b").alias("base_score"), F.sum("s").alias("score")
    ).drop("row")
