"""The training-data operators against brute force, round trips and held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from statloom.llm import decontaminate, mix, near_dup, queries, secrets, toxicity, warc
from statloom.llm.common import read
from statloom.llm.html_text import blocks, main_text, parse
from statloom.llm.lm_score import Classifier, hidden, init, lm_scores, log_probability, sequence, train, windows
from statloom.llm.quality_net import quality_scores
from statloom.llm.quality_rules import learn, quality_rules, repeat_words, text_counts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, DATA, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, "only words here", None), (5, long, "b"), (6, long, "b"), (6, long, "b"), (7, "x", None), (8, "token = \"11acdfb36bb72224148e6160f674b4be45601bff\" é", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("row", "h", "n", "score", "y", "held_out", "__row", "key", "size", "c"):
        df = df.withColumn(name, df.doc_id * 0 + 1)
    return df


def sql(name, statement, got):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(statement)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    sql(name, queries.oracle_sql()[name], queries.queries()[name](spark, DATA))


# --- 1 ---
def test_scores_count_every_token_once(docs):
    got = lm_scores(docs, model_docs=40).collect()
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in docs.collect()}
    c = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        ws = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_windows_and_attention():
    for n in (1, 2, 31, 32, 33, 57, 400):
        seq = np.arange(n + 1)
        x, y, on = windows(seq)
        assert sorted(y[on].tolist()) == list(range(1, n + 1))
        assert (x[on] + 1 == y[on]).all()
    m = init(np.random.default_rng(0))
    seq = np.random.default_rng(1).integers(0, 128, 200)
    x, y, on = windows(seq)
    s = hidden(m, x)[-1] @ m["O"] + m["b"]
    p = np.exp(s - s.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    want = np.log10(np.take_along_axis(p, y[..., None], 2)[..., 0][on])
    assert log_probability(m, x, y, on) == pytest.approx(want, abs=1e-4)
    z = x.copy()
    z[:, -1] = 5  # a later word changes nothing before it
    assert hidden(m, z)[-1][:, :-1] == pytest.approx(hidden(m, x)[-1][:, :-1], abs=1e-6)


def test_training_learns_a_pattern():
    of = Classifier({bytes([97 + i]): i + 3 for i in range(4)})
    seqs = [sequence(of, [b"a", b"b", b"c", b"d"] * 10) for _ in range(60)]
    m = train(seqs, epochs=150)
    x, y, on = windows(seqs[0])
    assert log_probability(m, x, y, on)[4:-1].mean() > -0.2


def test_scores_of_odd_rows(odd):
    got = lm_scores(odd, model_docs=10).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert lm_scores(odd.limit(0)).count() == 0


# --- 2 ---
def test_repeats_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        ids = rng.integers(0, 3, rng.integers(0, 120))
        ids = np.concatenate([ids, ids[:20]])
        wins = [tuple(ids[i : i + 8]) for i in range(len(ids) - 7)]
        c = Counter(wins)
        assert repeat_words(ids) == len({j for i, w in enumerate(wins) if c[w] > 1 for j in range(i, i + 8)})
    got = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines"), text_counts("é#a b\nb\n \n \nb\n")))
    assert got == {"n_words": 4, "word_chars": 6, "n_symbols": 1, "n_dup_lines": 1}


def test_rules_find_a_planted_condition():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] > 0.3))
    rules = learn(x, bad)
    on = np.zeros(900, bool)
    for r in rules:
        on |= np.logical_and.reduce([c.holds(x) for c in r])
    assert (on & bad).sum() > 0.9 * bad.sum() and (on & ~bad).sum() < 0.05 * bad.sum()


def test_quality_rules(spark, odd):
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    d = read(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in quality_rules(d, labels).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    good = [got[i].kept for i in y if y[i] == 1 and i in got and not got[i].base_failed]
    bad = [got[i].kept for i in y if y[i] == 0 and i in got]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.35
    out = quality_rules(odd, labels).collect()
    assert len(out) == odd.count() and not any(r.kept for r in out if r.n_words < 20)
    assert all(r.kept == (not r.base_failed) for r in quality_rules(odd, labels.limit(0)).collect())


# --- 3 ---
def test_secrets(spark, odd):
    d = read(spark, "/root/testdata/sf0.01", "documents")
    text = {r.doc_id: r.text for r in d.collect()}
    planted = {(i, m[1]) for i, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    rows = secrets.scan(d).collect()
    assert planted <= {(r.doc_id, r.value) for r in rows if r.is_secret}
    for r in rows:
        assert text[r.doc_id][r.start : r.start + r.length] == r.value
        assert not (r.is_secret and "@" in r.value)
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count() == clean.filter("`__row` = 1 or `__row` is null").count()
    assert clean.filter("doc_id = 8").first().text == 'token = "[SECRET]" é'
    other = {(r.doc_id, r.text) for r in clean.filter("doc_id <> 8 or doc_id is null").collect()}
    assert other == {(r.doc_id, r.text) for r in odd.filter("doc_id <> 8 or doc_id is null").collect()}


def test_assigned_values_and_long_runs_are_whole(spark):
    long = hashlib.sha512(b"k").hexdigest() * 7
    values = ["hunter2!", "Tr0ub4dor", "correcthorsebattery", "P@ss!w0rd#2024xyz", long]
    names = ['password = "', 'password = "', 'secret: "', 'pwd="', 'token = "']
    rows = [(i, f'see {n}{v}" end') for i, (n, v) in enumerate(zip(names, values, strict=True))] + [(10, "password=hunter2! end"), (11, "the password is required: see the manual"), (12, "k = " + "0000" * 50_000 + "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(d).collect()}
    assert [got[i].value for i in range(5)] == values and got[10].value == "password=hunter2!" and 11 not in got and got[12].length == 200_001
    clean = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    assert [clean[i] for i in range(5)] == [f'see {n}[SECRET]" end' for n in names]


def test_forest_generalises():
    from statloom.llm.secrets import fit_forest

    rng = np.random.default_rng(2)
    x = rng.random((600, len(secrets.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] > 0.4)).astype(float)

    def vote(tree, row):
        while not isinstance(tree, float):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    trees = fit_forest(x[:400], y[:400])
    hit = [(np.mean([vote(t, r) for t in trees]) > 0.5) == (b > 0.5) for r, b in zip(x[400:], y[400:])]
    assert np.mean(hit) > 0.85


# --- 4 ---
def test_html():
    page = '<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p>one <b>two</b>&nbsp;\n three<p>four<br>five<div class="comments"><p>hi</div></article><footer>f</footer>'
    assert blocks(parse(page), {}) == ["A & B", "one two three", "four five"]
    assert blocks(parse("<div>a<div>b</div>c</div><!-- x --><script>if (a<b) d</script>"), {}) == ["a", "b", "c"]
    assert blocks(parse(None), {}) == [] and blocks(parse("<" * 50 + "a" * 3000), {}) != []
    deep = "<div>" * 5000 + "x"
    assert blocks(parse(deep), {}) == ["x"]


def test_site_tree_drops_what_a_site_repeats(spark):
    page = lambda i: f"<body><div class='x1'>same line on every page</div><div class='x2'><p>story {i} {i * 7}</p></div></body>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(12)] + [(50, "http://b.org/", page(50)), (51, None, None), (52, "http://a.org/0", page(0))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 21" and got[50] == "same line on every page\nstory 50 350" and got[51] == "" and got[52] == "story 0 0"


def test_site_tree_keeps_what_groups_of_copies_share(spark):
    """Stories that some pages of a large site share are not what the site repeats; equal pages count once."""
    page = lambda i, j: f"<body><div class='x1'>same line</div><div class='x2'><p>story {i} {i * 7}</p></div><!-- {j} --></body>"
    rows = [(5 * i + j, f"http://a.org/{i}/{j}", page(i, j)) for i in range(40) for j in range(5)]
    rows += [(1000 + 10 * i + j, f"http://b.org/{i}/{j}", page(i, 0)) for i in range(3) for j in range(10)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[5 * i + j] == f"story {i} {i * 7}" for i in range(40) for j in range(5))
    assert all(got[1000 + 10 * i + j] == f"same line\nstory {i} {i * 7}" for i in range(3) for j in range(10))


# --- 5 ---
def test_quality_scores(spark, odd):
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in quality_scores(read(spark, "/root/testdata/sf0.01", "documents"), labels).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9
    out = quality_scores(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)


# --- 6 ---
def test_archive(spark, tmp_path):
    rows = [(1, "http://a b", "x" * 200_001), (2, None, "x" * 200_001), (3, "u", "é" * 10), (4, "u", None), (None, "u", "z"), (None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {(r.page_id, r.record_type): r for r in warc.warc_round_trip(pages).collect()}
    assert out[1, "revisit"].refers_to == 2 and out[2, "response"].payload_bytes == 200_001 and out[2, "response"].url is None
    assert out[3, "response"].payload_digest == hashlib.sha1(("é" * 10).encode()).hexdigest()
    assert warc.warc_round_trip(pages).count() == 6
    path = str(tmp_path / "a")
    warc.write_archive(warc.records(pages), path, 1000)
    table = spark.read.parquet(path)
    assert table.filter("length(bytes) > 2000").count() == 0
    assert warc.read_archive(spark, path).count() == 6
    with open(tmp_path / "out.warc", "wb") as f:
        warc.export_warc(((r.bytes,) for r in table.orderBy("record", "chunk").collect()), f)
    data = (tmp_path / "out.warc").read_bytes()
    assert data.count(b"WARC/1.1\r\n") == 6 and b"x" * 200_001 in data
    broken = str(tmp_path / "b")
    table.filter("chunk <> 3").write.parquet(broken)
    with pytest.raises(Exception, match="not where it should be"):
        warc.read_archive(spark, broken).collect()


# --- 7 ---
def test_toxicity(spark, odd):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, y = [], []
    for i in range(400):
        ws = [word() for _ in range(60)]
        if i % 5 == 0:
            for _ in range(rng.integers(2, 8)):
                ws[rng.integers(0, 60)] = rng.choice(["zorg", "kwixed", "kwixing"])
        texts.append(" ".join(ws))
        y.append(int(i % 5 == 0))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, toxic int").filter("doc_id < 250")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert [int(got[i].toxic) for i in range(250, 400)] == y[250:]
    assert all(0 <= r.severity <= 3 for r in got.values())
    assert toxicity.drop_toxic(d, lab).count() == 320
    out = toxicity.drop_toxic(odd, lab)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert toxicity.toxicity(odd, lab.limit(0)).filter("toxic").count() == 0


# --- 8 ---
def classes(rows):
    sets = {i: set(near_dup.shingle_hashes(t)[0].tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in sets}


def test_near_duplicates(docs):
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs).collect()}
    assert got == classes([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_of_copies(spark):
    """Each text is near its neighbours only: the class is the whole chain."""
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(base[k * 8 : k * 8 + 150])) for k in range(18)] + [(100 + k, " ".join(f"z{k}q{i}" for i in range(100))) for k in range(5)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and got[17] == 0


def test_mixed_buckets_are_finished(spark):
    """With one band all texts of a template meet in few buckets, and copies are neighbours in no order."""
    template = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(60):
        own = [f"u{k}x{i}" for i in range(60)]
        rows += [(k, " ".join(template + own)), (100 + k, " ".join(template + own[: 59 - k % 7]))]
    want, sets = classes(rows), [near_dup.shingle_hashes(t) for _, t in rows]
    assert len(set(want.values())) == 60
    register = dict(zip([i for i, _ in rows], near_dup.prob_min_hash(sets, 1)[:, 0].tolist(), strict=True))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1).collect()}
    assert all(want[got[i]] == want[i] for i in got)
    assert [k for k in range(60) if register[k] == register[100 + k] and got[k] != got[100 + k]] == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(1, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:300], rng.integers(1, 2**63, 100).astype(np.uint64)])
    one = np.ones(400, np.int64)
    s = near_dup.prob_min_hash([(a, one[: len(a)]), (b, one), (a[:0], one[:0])], 2000)
    assert (s[0] == s[1]).mean() == pytest.approx(300 / 500, abs=0.05) and not s[2].any()
    w = near_dup.prob_min_hash([(a[:2], np.array([1, 1])), (a[:2], np.array([1, 20]))], 4000)
    heavy, light = 1 + math.log(20), 1.0
    pairs = ((light, light), (light, heavy))
    want = sum(1 / sum(max(p / x, q / z) for p, q in pairs) for x, z in pairs)
    assert (w[0] == w[1]).mean() == pytest.approx(want, abs=0.05)


def test_repeats_within_a_text_do_not_hide_its_copy():
    """Equal shingle sets share every band, whatever the counts."""
    import pyarrow as pa

    a, b = [f"a{i}" for i in range(70)], [f"b{i}" for i in range(30)]
    texts = [" ".join(a + b * 2), " ".join(a + b * 50)]
    one, two = (near_dup.shingle_hashes(t) for t in texts)
    assert (one[0] == two[0]).all() and one[1].max() < two[1].max()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"1", b"2"]), pa.array(texts)], ["doc_id", "h", "text"])
    bands = next(near_dup._sign(iter([batch]), 20, 4)).column("bands").to_pylist()
    assert bands[0] == bands[1]


def test_ids_of_any_type_and_hot_keys(spark, docs, monkeypatch):
    """String ids; and every join of a key with its rows by the way for hot keys, broadcast or dealt."""
    from statloom.llm import common

    want = {str(i): c for i, c in classes([(r.doc_id, r.text) for r in docs.collect()]).items()}
    for rows, keys in ((512, 100_000), (1, 100_000), (1, 0)):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
        got = near_dup.near_duplicate_classes(docs.selectExpr("concat('d', doc_id) as doc_id", "text")).collect()
        by = {}
        for r in got:
            by.setdefault(r.class_id, set()).add(r.doc_id[1:])
        assert len(got) == len(want) and {frozenset(v) for v in by.values()} == {frozenset(i for i in want if want[i] == c) for c in set(want.values())}
        assert all(r.class_size == len(by[r.class_id]) for r in got)


def test_drop_near_duplicates_of_odd_rows(odd):
    got = near_dup.drop_near_duplicates(odd)
    assert got.columns == odd.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "5", "7", "8", "None"]
    assert near_dup.near_duplicate_classes(odd).count() == odd.count()
    assert near_dup.drop_near_duplicates(odd.limit(0)).count() == 0


# --- 9 ---
def test_both_joins_find_the_same(spark, docs, odd, monkeypatch):
    items = read(spark, DATA, "benchmark")
    extra = spark.createDataFrame([(1000, "only words"), (1001, "!!"), (1002, None), (1003, "X")], "item_id long, text string")
    items = items.select("item_id", "text").unionByName(extra)
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    one = sorted(map(repr, decontaminate.contamination(both, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert one == sorted(map(repr, decontaminate.contamination(both, items).collect()))
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 1)  # words are dealt into pieces
    assert one == sorted(map(repr, decontaminate.contamination(both, items).collect()))
    hit = {r.doc_id: r for r in decontaminate.contamination(odd, items).collect()}
    assert (hit[None].n_hit, hit[7].n_hit, hit[1].n_words) == (2, 1, 0)
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 6, 8}
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated").count() == 0


# --- 10 ---
def test_mix(spark, odd):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 30)), "abc"[min(2, int(rng.exponential(0.7)))]) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix.mix(d).collect()
    source = {i: s for i, _, s in rows}
    total = sum(r["size"] for r in got)
    by = {s: (sum(r.taken for r in got if source[r.doc_id] == s), next(r.target for r in got if source[r.doc_id] == s)) for s in "abc"}
    assert sum(t for _, t in by.values()) == pytest.approx(1.5 * total)
    for taken, target in by.values():
        assert taken == pytest.approx(target, rel=0.02, abs=60)
    assert all(r.taken <= 2 * r["size"] and r.taken % r["size"] == 0 for r in got)
    assert sorted(got) == sorted(mix.mix(d.repartition(9)).collect())
    assert mix.mix(odd).count() == odd.count() and mix.mix(odd.limit(0)).count() == 0


# --- the pipeline ---
def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA).collect()
    d = read(spark, DATA, "documents")
    lab, items = read(spark, DATA, "labels"), read(spark, DATA, "benchmark")
    toxic = {r.doc_id for r in toxicity.toxicity(d, lab).filter("toxic").collect()}
    rest = [(r.doc_id, r.text) for r in d.collect() if r.doc_id not in toxic]
    keep = set(classes(rest).values())
    dirty = {r.doc_id for r in decontaminate.contamination(d, items).filter("contaminated").collect()}
    assert {r.doc_id for r in got} == keep - dirty
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
