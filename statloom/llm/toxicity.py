"""Toxicity by a cumulative-link ordinal regression on sparse text features.

Features are the different words of a text and their leading 3 to 7 characters
(which catch the inflected forms of a stem). Grades are ordered: 0 is harmless,
1 to 3 are rising severities. One weight vector is shared by all thresholds,

    P(grade > k) = sigmoid(w.x - theta_k),    theta_0 < theta_1 < theta_2,

and the expected severity is the sum of these probabilities over k. Labels may
carry grades in a column of their own; from two-valued labels the grades of toxic
texts are the thirds of their number of different words that mark toxic texts.

Tasks count the features of the labelled texts and Spark adds them up; only the
chosen features and, per labelled text, the numbers of those it has reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_rows, scratch, written
from .labels import TRAIN_ROWS, adam, sigmoid

GRADES, FEATURES, LEAST_TEXTS, LEAST_LIFT = 3, 4096, 5, 10
#: Words in a worker's table before it is emptied.
TABLE = 100_000
_word = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    """The features of a word: itself and its leading characters."""
    return [word, *(f"{word[:n]}-" for n in (3, 4, 5, 6, 7) if len(word) > n)]


def words_of(text: str | None) -> Counter[str]:
    return Counter(_word.findall((text or "").lower()))


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic texts, harmless texts) with the feature, added up within the task as far as memory allows."""
    seen: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}

    def out() -> pa.RecordBatch:
        names = list(seen[True].keys() | seen[False].keys())
        r = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([seen[t][f] for f in names], pa.int64()) for t in (True, False)]], ["f", "a", "b"])
        for c in seen.values():
            c.clear()
        return r

    for b in batches:
        for t, y in zip(b.column("text"), b.column("y").to_pylist(), strict=True):
            seen[y > 0].update({p for w in words_of(t.as_py()) for p in parts(w)})
            if len(seen[True]) + len(seen[False]) > 10 * TABLE:
                yield out()
    if seen[True] or seen[False]:
        yield out()


def select_features(rows: DataFrame, n1: int, n0: int, most: int = FEATURES) -> list[str]:
    """The features that split toxic from harmless texts (of which there are n1 and n0) best, by the likelihood ratio of their presence; only those beyond chance that are LEAST_LIFT times as frequent in toxic texts. ``rows`` has text and y."""
    n1, n0 = max(1, n1), max(1, n0)
    f = map_rows(rows, _count_parts, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    f = f.filter((a + b >= LEAST_TEXTS) & (a / n1 > LEAST_LIFT * (b + 0.5) / n0))
    part = lambda x, n: F.when(x > 0, x * F.log(x * (n1 + n0) / ((a + b) * n))).otherwise(0.0)
    f = f.withColumn("g", F.round(2 * (part(a, n1) + part(b, n0)), 9)).filter("g > 20")
    return [r.f for r in f.orderBy(F.desc("g"), "f").limit(most).select("f").collect()]


def _present(batches: Iterator[pa.RecordBatch], place: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Of each labelled text: its label, the numbers of its features, and how many of its different words have one."""
    for b in batches:
        words = [words_of(t.as_py()) for t in b.column("text")]
        at = [sorted({place[p] for w in c for p in parts(w) if p in place}) for c in words]
        marked = [sum(any(p in place for p in parts(w)) for w in c) for c in words]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(at, pa.list_(pa.int32())), pa.array(marked, pa.int64())], ["y", "at", "marked"])


def grades_of(marked: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades from two-valued labels: 0, or 1 to GRADES by thirds of the number of different marked words."""
    cuts = np.quantile(marked[toxic], np.arange(1, GRADES) / GRADES) if toxic.any() else np.zeros(GRADES - 1)
    return np.where(toxic, 1 + np.searchsorted(cuts, marked, side="right"), 0)


def fit(r: np.ndarray, j: np.ndarray, grade: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from the present features (text ``r`` has feature ``j``) and the grades, 0 to GRADES."""
    texts = len(grade)
    above = np.stack([grade > k for k in range(GRADES)], axis=1).astype(float)

    def thresholds(t: np.ndarray) -> np.ndarray:
        return t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])

    def grad(p: dict[str, np.ndarray], step: int) -> dict[str, np.ndarray]:
        s = np.bincount(r, p["w"][j], texts)
        d = (sigmoid(s[:, None] - thresholds(p["t"])) - above) / texts
        tail = np.cumsum(-d.sum(axis=0)[::-1])[::-1]
        return {"w": np.bincount(j, d.sum(axis=1)[r], features) + 2e-5 * p["w"], "t": np.concatenate([[tail[0]], tail[1:] * np.exp(p["t"][1:])])}

    p = {"w": np.full(features, 0.5), "t": np.concatenate([[2.0], np.zeros(GRADES - 1)])}
    if texts:
        for rate in (0.3, 0.3, 0.3, 0.1, 0.1, 0.03):  # features were chosen because they mark toxic texts: no weight may excuse one
            p = adam(p, grad, 100, rate)
            p["w"] = np.maximum(p["w"], 0)
    return p["w"], thresholds(p["t"])


def raw_score(text: str | None, weights: dict[str, float], cache: dict[str, tuple[str, ...]]) -> float:
    """The sum of the weights of the features that are present."""
    found = set(_word.findall((text or "").lower()))
    if len(cache) > TABLE:
        cache.clear()
    for w in found.difference(cache):
        cache[w] = tuple(p for p in parts(w) if p in weights)
    return sum(weights[f] for f in sorted({f for w in found for f in cache[w]}))


def _judge(batches: Iterator[pa.RecordBatch], weights: dict[str, float], theta: np.ndarray, keep: list[str]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, tuple[str, ...]] = {}
    for b in batches:
        s = np.array([raw_score(t.as_py(), weights, cache) for t in b.column("text")])
        p = sigmoid(s[:, None] - theta)
        yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)], [*keep, "severity", "p_toxic", "toxic"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Weights by feature and the thresholds, from at most ``bound`` labelled texts. Labels over 1 are grades."""
    with scratch(docs.sparkSession):
        rows = written(labelled_sample(docs, labels, label, bound).select("text", "y").repartition(8))
        n1, n = rows.agg(F.count(F.when(F.col("y") > 0, 1)), F.count(F.lit(1))).first()
        names = select_features(rows, n1, n - n1)
        place = {f: i for i, f in enumerate(names)}
        got = sorted(map_rows(rows, lambda it: _present(it, place), "y int, at array<int>, marked long").collect())
    grade = np.clip(np.array([r.y for r in got], np.int64), 0, GRADES)
    if len(grade) and grade.max() <= 1:
        grade = grades_of(np.array([r.marked for r in got]), grade > 0)
    r = np.repeat(np.arange(len(got)), [len(x["at"]) for x in got])
    j = np.array([i for x in got for i in x["at"]], np.int64)
    weights, theta = fit(r, j, grade, len(names))
    return dict(zip(names, weights.tolist(), strict=True)), theta


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """One row per document row: doc_id (or ``keep``), severity (expected grade, 0 to 3), p_toxic, toxic (p_toxic of a half or more).

    A null or empty text has no features and the least severity. Repeated rows
    are each judged; a null doc_id is kept. Without labels nothing is toxic.
    Columns of ``docs`` other than ``keep`` and text are not looked at.
    """
    weights, theta = train(docs, labels, label, bound)
    keep = keep or ["doc_id"]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", severity double, p_toxic double, toxic boolean"
    return map_rows(docs.select(*keep, F.col("text").cast("string").alias("text")), lambda it: _judge(it, weights, theta, keep), schema)


def _clean(batches: Iterator[pa.RecordBatch], weights: dict[str, float], theta: np.ndarray) -> Iterator[pa.RecordBatch]:
    cache: dict[str, tuple[str, ...]] = {}
    for b in batches:
        s = np.array([raw_score(t.as_py(), weights, cache) for t in b.column("text")])
        yield b.filter(pa.array(sigmoid(s - theta[0]) < 0.5))


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the rows that :func:`toxicity` calls toxic, in one pass and without a shuffle; ``text`` must be a string column."""
    weights, theta = train(docs, labels, "toxic", bound)
    from .common import small_batches

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: _clean(it, weights, theta), docs.schema)
