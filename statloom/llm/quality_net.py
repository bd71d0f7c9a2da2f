"""Quality classifier: random-indexing vectors pooled per text, a two-layer network, calibrated probabilities.

Units are words and runs of marks, hashed to ``BUCKETS`` rows. Every row has a
fixed sparse random index vector; a row's context vector is the sum of the index
vectors of its neighbours over the *whole corpus* (tasks sum their part, Spark
sums the parts; the table has a fixed size whatever the corpus). A text is the
mean and the spread of its units' context vectors. A network with one hidden
layer is fitted in numpy on a bounded labelled sample, and a temperature fitted
on rows that did not train it turns its output into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, map_rows
from .labels import TRAIN_ROWS, adam, sigmoid

BUCKETS, DIM, REACH, HIDDEN = 8192, 32, 2, 16
PREDICT_AT = 0.3
#: Units in a worker's table before it is emptied.
TABLE = 100_000
_unit = re.compile(r"\w+|[^\w\s]+")


def units(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Rows of the units of a text, in order; ``known`` is the task's table."""
    found = _unit.findall(text or "")
    if len(known) > TABLE:
        known.clear()
    for u in set(found).difference(known):
        known[u] = zlib.crc32(u.encode("utf-8", "surrogatepass")) % BUCKETS
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the place of its +1 and of its -1."""
    rng = np.random.default_rng(11)
    plus = rng.integers(0, DIM, BUCKETS)
    return plus, (plus + rng.integers(1, DIM, BUCKETS)) % DIM


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plus, minus = index_vectors()
    table, known = np.zeros(BUCKETS * DIM), {}
    for b in batches:
        ids = []
        for t in b.column("text"):
            ids += [units(t.as_py(), known), np.full(REACH, -1)]
        x = np.concatenate(ids) if ids else np.empty(0, np.int64)
        for gap in range(1, REACH + 1):
            here, there = x[:-gap], x[gap:]
            both = (here >= 0) & (there >= 0)
            here, there = here[both], there[both]
            for a, c in ((here, there), (there, here)):
                table += np.bincount(a * DIM + plus[c], minlength=len(table))
                table -= np.bincount(a * DIM + minus[c], minlength=len(table))
    table = table.reshape(BUCKETS, DIM)
    some = np.flatnonzero(np.abs(table).sum(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(table[some, j]) for j in range(DIM)]], ["u", *[f"v{j}" for j in range(DIM)]])


def context_table(docs: DataFrame) -> np.ndarray:
    """Unit-length context vectors, BUCKETS x DIM, from all texts."""
    names = [f"v{j}" for j in range(DIM)]
    parts = map_rows(docs.select(F.col("text").cast("string").alias("text")), _contexts, "u long, " + ", ".join(f"{n} double" for n in names))
    rows = parts.groupBy("u").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    table = np.zeros((BUCKETS, DIM), np.float32)
    table[rows["u"].to_numpy(int)] = rows[names].to_numpy(np.float32)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(table: np.ndarray, texts: list[str | None], known: dict[str, int]) -> np.ndarray:
    """Mean and standard deviation of the context vectors of each text, and the logarithm of its length; zeros for a text without units."""
    out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
    for i, t in enumerate(texts):
        x = units(t, known)
        if len(x):
            seen, n = np.unique(x, return_counts=True)
            v, w = table[seen], (n / len(x)).astype(np.float32)
            m = w @ v
            out[i, :DIM], out[i, DIM:-1], out[i, -1] = m, np.sqrt(np.maximum(w @ (v * v) - m * m, 0)), np.log1p(len(x)) / 10
    return out


def _forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh((x - p["mean"]) / p["sd"] @ p["W"] + p["a"])
    return h, h @ p["w"] + p["b"]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """The network's weights and its temperature. A fifth of the rows only calibrates."""
    rng = np.random.default_rng(seed)
    p = {"mean": x.mean(axis=0) if len(x) else np.zeros(2 * DIM + 1), "sd": x.std(axis=0) + 1e-3 if len(x) else np.ones(2 * DIM + 1)}
    w = {"W": rng.standard_normal((2 * DIM + 1, HIDDEN)) / np.sqrt(2 * DIM + 1), "a": np.zeros(HIDDEN), "w": rng.standard_normal(HIDDEN) / 4, "b": np.zeros(())}
    t = np.ones(())
    if len(y):
        held = rng.random(len(y)) < 0.2
        xt, yt = x[~held], y[~held]
        z = (xt - p["mean"]) / p["sd"]

        def grad(q: dict[str, np.ndarray], step: int) -> dict[str, np.ndarray]:
            some = rng.integers(0, len(z), min(256, len(z)))
            h = np.tanh(z[some] @ q["W"] + q["a"])
            d = (sigmoid(h @ q["w"] + q["b"]) - yt[some]) / len(some)
            dh = d[:, None] * q["w"] * (1 - h * h)
            return {"w": h.T @ d + 1e-4 * q["w"], "b": d.sum(), "W": z[some].T @ dh + 1e-4 * q["W"], "a": dh.sum(axis=0)}

        if len(yt):
            w = adam(w, grad, 1500, 0.01)
        s = _forward(p | w, x[held])[1]
        if len(s):
            loss = lambda k: -np.mean(np.log(np.where(y[held] > 0, sigmoid(s / k), sigmoid(-s / k)) + 1e-12))
            t = np.array(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))
    return p | w | {"t": t}


def probability(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return sigmoid(_forward(p, x)[1] / p["t"])


def _predict(batches: Iterator[pa.RecordBatch], table: np.ndarray, p: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        s = probability(p, pooled(table, b.column("text").to_pylist(), known))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s.astype(float))], ["doc_id", "held_out", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    held_out: crc32 of the id modulo 5 is 0 (a null id is hashed as the empty
    text); labels of such rows are never used. A null or empty text has the
    score of a text without units. Repeated rows are each scored; without
    labels the network is untrained. Other columns are not looked at.
    """
    held = crc_mod(F.col("doc_id"), 5) == 0
    table = context_table(docs)
    rows = labelled_sample(docs, labels, "quality", bound, lambda c: crc_mod(c, 5) != 0)
    train = map_rows(rows.select("y", "text"), lambda it: _pool(it, table), "y int, x array<float>").toPandas()
    x = np.array(train["x"].tolist(), float).reshape(len(train), 2 * DIM + 1)
    p = fit(x, (train["y"].to_numpy() > 0).astype(float))
    kind = dict(docs.dtypes)["doc_id"]
    out = map_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held_out")), lambda it: _predict(it, table, p), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def _pool(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(pooled(table, b.column("text").to_pylist(), known)), pa.list_(pa.float32()))], ["y", "x"])
