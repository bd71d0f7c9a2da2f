"""The site style tree against a plain merge in one process, and pages that are hard to parse."""

import math
import re
import time
from collections import defaultdict

import pytest

from statloom.llm import html_text
from statloom.llm.common import read
from statloom.llm.html_text import FEW_PAGES, JUDGED_BELOW, _signed, blocks, host_key, judged_nodes, main_text, observe, parse

COLUMNS = "page_id long, url string, html string"


def host(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def merged(rows):
    """Importance of the branches of every host, as the module's docstring has it, with dictionaries."""
    pages = {(host(u), h) for u, h in rows}
    around, site, every = {}, defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for at, h in pages:
        chains, found = observe(parse(h))
        around |= chains
        for node, kind, value in found:
            site[at, node][kind, value].add(h)
            every[node][kind, value].add(at)

    def importance(seen, node):
        m = len(seen[node][0, 0])
        in_it = [(n, k) for n in seen if n in around and node in around[n] for k in seen[n] if k[0] == 1]
        if not in_it:
            return None
        h = sum(math.log(len(seen[n][k])) for n, k in in_it) / len(in_it)
        layouts = [len(v) for k, v in seen[node].items() if k[0] == 2]
        s = sum(layouts)
        spread = -sum(x / s * math.log(x / s) for x in layouts) / math.log(s) if s > 1 else 1.0
        g = 0.9 ** (len(layouts) - 1)
        return (m * ((1 - g) * spread + g * math.exp(-h)) + FEW_PAGES) / (m + FEW_PAGES)

    out = {}
    for at in {a for a, _ in pages}:
        nodes = {n: v for (a, n), v in site.items() if a == at}
        imp = {n: (importance(nodes, n), importance(every, n)) for n in nodes}
        imp = {n: x for n, x in imp.items() if x[0] is not None}
        peak = {u: tuple(max(x[i] for n, x in imp.items() if u in around[n]) for i in (0, 1)) for u in {u for n in imp for u in around[n]}}
        top = [max((x[i] for x in peak.values()), default=1) for i in (0, 1)]
        out[at] = {n: min(x[0] / top[0], x[1] / top[1]) for n, x in peak.items()}
    return out


def test_tree_equals_a_plain_merge(spark):
    pages = read(spark, "/root/testdata/sf0.001", "pages")
    page = lambda i, x: f"<body><div class='x1'>same line. on every page</div><div class='x2 c{i}'><p>story {i} {x}. And</div><ul>{'<li>a</li>' * (i % 3)}</ul></body>"
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()] + [(1000 + i, f"http://a.org/{i}", page(i, i * 7)) for i in range(12)] + [(1012, "http://a.org/0", page(0, 0)), (1013, None, None), (1014, "HTTP://B.org:80/x", page(3, 1))]
    df = spark.createDataFrame(rows, COLUMNS)
    keyed = df.select(host_key(df.url).alias("host"), "html", "url")
    name = {r.host: host(r.url) for r in keyed.select("host", "url").collect()}
    got = {(name[r.host], r.node): r.peak for r in judged_nodes(keyed.select("host", "html")).collect()}
    want = {(a, _signed(n)): p for a, nodes in merged([(u, h or "" if h is None else h) for _, u, h in rows]).items() for n, p in nodes.items() if p < JUDGED_BELOW - 1e-6}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_the_tree_decides(spark):
    """On the test pages the tree without any names gives the article alone; without the tree, texts of all hosts change."""
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    rows = pages.collect()
    named = {r.page_id: r.text for r in main_text(pages).collect()}
    alone = {r.page_id: r.text for r in main_text(pages, names=False).collect()}
    off = {r.page_id: "\n".join(blocks(parse(r.html), None, names=False)) for r in rows}
    assert alone == named
    assert {host(r.url) for r in rows} == {host(r.url) for r in rows if off[r.page_id] != alone[r.page_id]}
    for r in rows:
        a = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert "".join(named[r.page_id].split()) == "".join(blocks(parse(a), {}, names=False)).replace(" ", "").replace(" ", "")


def test_boxes_without_names(spark):
    """Inside an article too, what a site repeats goes and what it tells stays."""
    page = lambda i: f"<article><h1>Title {i}</h1><div class=q{i % 2}>Sign up for our letter!</div><p>Story number {i} of {i * 13}.</p><div class=z><p>More on {i}x</p></div></article>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(40)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {i: f"Title {i}\nStory number {i} of {i * 13}.\nMore on {i}x" for i in range(40)}


def test_names_where_a_site_is_unknown(spark):
    page = """<html><body class="has-sidebar"><header>Site</header><nav>Menu</nav><div class="cookie-notice">We use cookies</div><main><article class="post social-life"><header><h1>Head</h1></header>
    <p>Text &amp; more&nbsp;here</p><div class="advert">Buy</div><div class="tags">kept once</div><article class="comment"><p>reader says hi</p></article><form>Mail <input></form></article></main>
    <section id="comments"><p>first!</p></section><aside>Side</aside><footer>Foot</footer></body></html>"""
    got = main_text(spark.createDataFrame([(1, "http://only.org/", page)], COLUMNS)).first()
    assert got.text == "Head\nText & more here\nkept once" and got.n_chars == len(got.text)


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<a 'x" * 200_000, "<div>" * 100_000 + "</x>" * 100_000, "<" * 500_000, "<!--" * 200_000, "<script>" * 100_000, "<![" * 200_000, "<div " + "class " * 100_000, "&#" + "1" * 500_000 + ";" + "&" * 300_000], ids=range(10))
def test_malformed_pages_take_linear_time(page):
    cut = page[: len(page) // 8]
    t = time.perf_counter()
    blocks(parse(cut), {})
    one = time.perf_counter()
    blocks(parse(page), {})
    assert time.perf_counter() - one < 25 * (one - t) + 1


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://a/", "<p>x"), (None, "http://a/", "<p>x"), (3, "http://a/", "plain " * 200_000), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "a < b &lt; c &#99999999999; d")]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("host", "node", "text", "n_chars", "w", "page", "nodes", "salt"):
        df = df.withColumn(name, df.page_id * 0)
    got = main_text(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[1].url is None and by[None].text == "x" and by[4].text == "deep" and by[5].text == "a < b < c � d"
    assert by[3].n_chars == 6 * 200_000 - 1
    assert main_text(df.limit(0)).count() == 0


def test_many_judged_nodes_are_joined_in_pieces(spark, monkeypatch):
    pages = read(spark, "/root/testdata/sf0.001", "pages")
    one = sorted(map(repr, main_text(pages).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_NODES", 0)
    assert one == sorted(map(repr, main_text(pages).collect()))
