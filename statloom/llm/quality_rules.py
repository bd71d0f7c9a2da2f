"""Quality rules: an ordered decision list learned by sequential covering.

Statistics of every text are counted in Arrow batches. From a bounded labelled
sample the learner grows a conjunction of thresholds that covers bad texts (by
FOIL's gain on two thirds of the rows), prunes it on the last third, removes
what it covers and goes on; the list is emitted as one ``CASE WHEN`` of Spark
conditions, so its application needs no Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_rows
from .labels import TRAIN_ROWS

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_distinct", "n_lines", "n_same_next", "n_single")
_UPPER, _DIGITS, _MARKS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?|_~^", b"#*$%&|<>"
SPAN = 8


def repeat_words(ids: np.ndarray, span: int = SPAN) -> int:
    """Words inside windows of ``span`` words that occur twice or more, the first occurrence included. Windows are found by hash and confirmed word by word."""
    n = len(ids) - span + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    for j in range(span):
        h = h * np.uint64(0xD6E8FEB86659FD93) + x[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    wins = np.lib.stride_tricks.sliding_window_view(ids, span)[at]
    _, back, seen = np.unique(wins, axis=0, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    at = at[seen[back.ravel()] > 1]
    edge += np.bincount(at, minlength=len(edge))
    edge -= np.bincount(at + span, minlength=len(edge))
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or ""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    if not words:
        return (0,) * len(COUNTS)
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
    lines = [x for x in b.split(b"\n") if not x.isspace() and x]
    less = lambda chars: len(b) - len(b.translate(None, chars))
    return (
        len(words), len(text) - less(b" \t\n\r\x0b\x0c"), less(_SYMBOLS), len(lines) - len(set(lines)), repeat_words(ids), less(_UPPER), less(_DIGITS), less(_MARKS),
        len(table), len(lines), int((ids[1:] == ids[:-1]).sum()), int((np.bincount(ids) == 1).sum()),
    )


def _count(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = list(zip(*[text_counts(t.as_py()) for t in b.column("text")], strict=True)) or [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *[pa.array(v, pa.int64()) for v in got]], [*keep, *COUNTS])


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and COUNTS of each row's whole text (null: no words)."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], *[f"{c} long" for c in COUNTS]])
    return map_rows(docs.select(*keep, F.col("text").cast("string").alias("text")), lambda it: _count(it, keep), schema)


def rates() -> dict[str, Column]:
    """The statistics that rules test: shares, so that they do not depend on length."""
    w, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / c, "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeat_rate": F.col("n_repeat_words") / w, "upper_rate": F.col("n_upper") / c, "digit_rate": F.col("n_digits") / c,
        "mark_rate": F.col("n_marks") / w, "distinct_rate": F.col("n_distinct") / F.sqrt(w), "word_length": F.col("word_chars") / w, "same_next_rate": F.col("n_same_next") / w, "single_rate": F.col("n_single") / w, "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold

    def column(self) -> Column:
        c = rates()[self.name]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(lambda a, c: a & c.holds(x), rule, np.ones(len(next(iter(x.values()))), bool))


def best_condition(name: str, v: np.ndarray, bad: np.ndarray) -> tuple[float, Condition]:
    """The threshold of one statistic with the largest gain, and its gain, over the rows given."""
    p, n = int(bad.sum()), int((~bad).sum())
    cuts = np.unique(np.quantile(v, np.linspace(0, 1, 33)))
    cuts = np.unique(np.concatenate([(cuts[:-1] + cuts[1:]) / 2, np.quantile(v[bad], np.linspace(0, 1, 17)), [v[~bad].min(), v[~bad].max()] if n else []]))
    best = (-1.0, Condition(name, True, float(cuts[0])))
    for above in (True, False):
        hold = (v[None, :] > cuts[:, None]) if above else (v[None, :] <= cuts[:, None])
        p1, n1 = (hold & bad).sum(axis=1), (hold & ~bad).sum(axis=1)
        gain = np.where(p1 > 0, p1 * (np.log2(np.maximum(p1, 1e-9) / np.maximum(p1 + n1, 1)) - np.log2(p / (p + n))), -1)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), Condition(name, above, float(cuts[i])))
    return best


def grow_rule(x: dict[str, np.ndarray], bad: np.ndarray, first: str, most: int = 4) -> Rule:
    """Conditions are added one by one, each with the largest gain, until no good text is covered; the first is on the statistic ``first``."""
    rule: Rule = ()
    on = np.ones(len(bad), bool)
    while len(rule) < most and (on & bad).any() and (on & ~bad).any():
        gain, c = max((best_condition(k, v[on], bad[on]) for k, v in x.items() if rule or k == first), key=lambda g: g[0])
        if gain <= 1e-9:
            break
        rule = (*rule, c)
        on &= c.holds(x)
    return rule


def prune_rule(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The leading conditions with the best (p - n) / (p + n) on rows that did not grow the rule."""

    def worth(r: Rule) -> float:
        on = covers(r, x)
        p, n = int((on & bad).sum()), int((on & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 5, most: int = 16, seed: int = 3) -> list[Rule]:
    """Rules for bad texts, in the order in which they were learned; a rule is accepted if it is right for ``precision`` of at least ``least`` rows."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most and (left & bad).sum() >= least:
        pick = rng.random(len(bad)) < 2 / 3
        part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        found = [grow_rule(*part(left & pick), k) for k in x] if (left & pick & bad).any() else []
        found = [prune_rule(r, *part(left & ~pick)) if (left & ~pick).any() else r for r in found if r]

        def worth(r: Rule) -> tuple[float, float]:
            on = covers(r, x) & left
            p, n = int((on & bad).sum()), int((on & ~bad).sum())
            return (p - 5 * n, -len(r)) if p + n >= least and p >= precision * (p + n) else (-1.0, 0.0)

        rule = max(found, key=worth, default=())
        if not rule or worth(rule)[0] <= 0:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for texts that no rule covers: the decision list as one conditional expression."""
    out = None
    for r in rules:
        hit = reduce(lambda a, b: a & b, [c.column() for c in r])
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from at most ``bound`` labelled rows, of which those that fail the base are left out; none if there are no labels."""
    rows = statistics(labelled_sample(docs, labels, "quality", bound), ["y"]).filter(~base_failed()).select("y", *[c.alias(k) for k, c in rates().items()]).toPandas()
    return learn({k: rows[k].to_numpy(float) for k in rates()}, rows["y"].to_numpy() == 0) if len(rows) else []


def quality_rules(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """One row per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails the base. Repeated rows are each judged;
    a null doc_id is kept. Without labels only the base decides. Other columns
    of ``docs`` are not looked at.
    """
    rules = learn_rules(docs, labels, bound)
    failed = base_failed()
    return statistics(docs, ["doc_id"]).select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
