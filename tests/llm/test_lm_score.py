"""The model's scores, recomputed word by word in one process from the same model."""

import numpy as np
import pytest

from statloom.llm import lm_score
from statloom.llm.common import read


def test_scores_equal_a_plain_recomputation(spark, monkeypatch):
    docs = read(spark, "/root/testdata/sf0.001", "documents").limit(80).cache()
    kept = {}
    plain = lm_score.fit_model

    def keep(learn, pieces, n):
        kept["model"], kept["pieces"] = plain(learn, pieces, n), pieces
        return kept["model"]

    monkeypatch.setattr(lm_score, "fit_model", keep)
    for head in (0, 50, 10**6):
        got = {r.doc_id: r for r in lm_score.lm_scores(docs, model_docs=30, head_words=head).collect()}
        m, pieces = kept["model"], kept["pieces"]
        texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
        c = {}
        for i in texts:
            if not got[i].held_out:
                for w in [*texts[i], b""]:
                    c[w] = c.get(w, 0) + 1
        k = {w: lm_score.class_of(w, pieces) for w in {w for ws in texts.values() for w in ws} | {b""}}
        room = np.ones(lm_score.CLASSES)
        for w, n in c.items():
            room[k[w]] += n + 1
        for i in list(texts)[:25]:
            seq = np.array([lm_score.START, *(k[w] for w in texts[i]), lm_score.END])
            total = 0.0
            for t in range(1, len(seq)):  # each target once, in the first window that counts it
                start = 0 if t <= lm_score.WINDOW else -(-(t - lm_score.WINDOW) // lm_score.STRIDE) * lm_score.STRIDE
                x = np.zeros((1, lm_score.WINDOW), np.int64)
                x[0, : t - start] = seq[start:t]
                f = (lm_score.hidden(m, x)[-1] @ m["O"] + m["b"])[0, t - start - 1].astype(float)
                w = texts[i][t - 1] if t <= len(texts[i]) else b""
                total += (f[seq[t]] - f.max() - np.log(np.exp(f - f.max()).sum())) / np.log(10) + np.log10((c.get(w, 0) + 1) / room[k[w]])
            assert got[i].score == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_all_tasks_teach_the_model(spark):
    """The network has seen more than its first documents: averaged weights predict held-out texts better."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    learn, test = docs.filter("doc_id % 5 > 0"), docs.filter("doc_id % 5 = 0")
    counts = lm_score.map_rows(learn.select("text"), lm_score._count, "w binary, c long")
    pieces = lm_score.choose_classes(counts, lm_score.subwords(lm_score.default_vocabulary()))
    assert len(pieces) == lm_score.CLASSES - 3
    few, more = lm_score.fit_model(learn, pieces, 60, 10**9), lm_score.fit_model(learn, pieces, 60, 2)
    of = lm_score.Classifier(pieces)
    win = [np.concatenate(a) for a in zip(*[lm_score.windows(lm_score.sequence(of, lm_score._words(r.text))) for r in test.limit(60).collect()], strict=True)]
    assert lm_score.log_probability(more, *win).mean() > lm_score.log_probability(few, *win).mean()


def test_every_training_document_teaches_the_model(spark):
    """By default the network depends on each training document, also on those it does not start from."""
    rows = [(i, " ".join(f"{'abcdefgh'[(i * 7 + j * j) % 8]}{j % 5}" for j in range(40))) for i in range(60)]
    pieces = {bytes([97 + i]): i + 3 for i in range(8)}

    def fit(rows):
        return lm_score.flat(lm_score.fit_model(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), pieces, 5))

    plain = fit(rows)
    assert (fit(rows) == plain).all()
    first = {r.doc_id for r in lm_score.id_sample(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    for i in [i for i, _ in rows if i not in first][:3]:
        assert (fit([(d, "a a a b b b" if d == i else t) for d, t in rows]) != plain).any()


def test_no_window_is_left_out_of_training(monkeypatch):
    """All targets of a task's texts are fitted once an epoch, however many they are; texts longer than a block have no other end than their own."""
    n = 24 * 25_000
    pieces, seen = {b"a": 3}, np.zeros(lm_score.CLASSES, np.int64)

    def step(m, x, y, on):
        seen[:] += np.bincount(y[on], minlength=lm_score.CLASSES)
        return {k: np.zeros_like(w) for k, w in m.items()}

    monkeypatch.setattr(lm_score, "gradient", step)
    batch = lm_score.pa.RecordBatch.from_pydict({"text": ["a " * n, None, "a b"]})
    start = lm_score.init(np.random.default_rng(0))
    (got,) = lm_score._fit(iter([batch]), pieces, start, 1000)
    assert seen[[lm_score.END, lm_score.OTHER, 3]].tolist() == [3, 1, n + 1] and seen.sum() == n + 5
    assert got.column("n")[0].as_py() == 25_000 + 2
    seen[:] = 0
    lm_score.train([lm_score.sequence(lm_score.Classifier(pieces), [b"a"] * n)], epochs=1)
    assert seen.sum() == n + 1


def test_gradient_equals_differences():
    """The gradient by hand against differences of the loss that the scores have."""
    rng = np.random.default_rng(3)
    m = lm_score.init(rng)
    x, y, on = lm_score.windows(rng.integers(0, lm_score.CLASSES, 90))
    g = lm_score.flat(lm_score.gradient(m, x, y, on))
    w, log = lm_score.flat(m), np.log(10)
    for _ in range(10):
        d = (rng.standard_normal(len(w)) * 3e-4).astype(np.float32)
        up, down = (-lm_score.log_probability(lm_score.unflat(w + s * d), x, y, on).mean() * log for s in (1, -1))
        assert (up - down) / 2 == pytest.approx(float(g @ d), rel=0.03, abs=2e-5)


def test_words_of_a_batch_are_those_of_its_texts():
    rng = np.random.default_rng(7)
    signs = list("aZ0- \t\n\v\f\r\0\x1c\x1f\x85\xa0É中 ﻿😀")
    texts = ["", None, " ", " Ab cD\n", "a", *("".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(300)), "end "]
    for some in (texts, [], [None], ["", " "]):
        text, at, words = lm_score.split_texts(lm_score.pa.array(some, lm_score.pa.string()))
        got = [[] for _ in some]
        for i, j in zip(text, at, strict=True):
            got[i].append(words[int(j)].as_py())
        assert got == [lm_score._words(t) for t in some]
        assert len(set(words.to_pylist())) == len(words)
        seqs = list(lm_score.sequences(np.arange(len(at)) + 3, np.bincount(text, minlength=len(some))))
        assert [len(s) - 2 for s in seqs] == [len(w) for w in got]
