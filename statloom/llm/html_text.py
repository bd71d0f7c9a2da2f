"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree. A style node is a path of block tags
and class names; it holds the layouts (sequences of child blocks) and the contents
(clauses of its own text) that its m pages show there. The entropy of a clause that
n pages share is log(n), so

    content  = exp(- mean entropy of the clauses in its subtree)
    layout   = entropy of its layouts / log(layouts shown)
    importance = (1 - g) * layout + g * content,   g = 0.9 ** (number of layouts - 1)

drawn towards 1 where few pages speak: what a site repeats is unimportant, in its
words and in its form. A second tree merges the hosts (with hosts in the place of
pages), as sites share boilerplate; the lesser importance counts. A branch is as
important as the most important node in it, measured against the site's most
important node; times the weight of what its presentation says (menu, advert,
article text, ...) this must reach ``LEAST``, or the branch is removed.

Spark merges the pages: tasks count clauses, one shuffle by (node, clause) adds
them up within hosts and over hosts, and what is left is a row per host and node. No host meets in one task, and the judged nodes are joined to the pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, scratch, written

#: Tags by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template textarea title iframe noembed noframes xmp form select button dialog svg canvas object audio video map fieldset".split())
FRAME = frozenset("nav footer aside header menu".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th ul ol dl table tbody tr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_LIKE = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table tbody thead select #root".split())
#: Class and id words of branches that are not the article, wherever they are; those that are so outside an article only; and those of an article that is not the page's.
NOISE = re.compile(r"(^|[\s_-])(nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side-bar|ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|comments?|comment-?list|disqus|replies|reply|respond|share|sharing|newsletter|subscribe|subscription|signup|login|search|searchbox|footer|masthead|site-?header|topbar|toolbar|pagination|pager|skip-?link|copyright)([\s_-]|$)", re.I)
OUTER = re.compile(r"(^|[\s_-])(aside|banner|notice|notices|alert|social|related|recommend\w*|foot|widget|tags)([\s_-]|$)", re.I)
NOT_MAIN = re.compile(r"(^|[\s_-])(comments?|comment-?list|replies|reply|respond|related|recommend\w*|teaser|promo\w*|sponsor\w*|ads?|advert\w*)([\s_-]|$)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: A branch stays if weight x importance is at least LEAST. Weights of a branch by its presentation; one that says noise never reaches it.
LEAST = 0.5
SAYS_NOISE, DOUBTFUL, PLAIN, SAYS_TEXT = 0.4, 0.6, 1.0, 2.0
#: Layouts count more the more there are; pages of importance 1 that are added to those of a node; the importance above which no weight can remove a branch.
DAMP, FEW_PAGES, JUDGED_BELOW = 0.9, 3, LEAST / DOUBTFUL
#: Open elements; what is nested deeper becomes a child of the last one.
DEPTH = 256
#: Rows in a task's table of counts before they are sent on, and judged nodes that are broadcast: more are joined by host, in SALTS pieces each.
TABLE, BROADCAST_NODES, SALTS = 200_000, 200_000, 64

_start = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_stop = re.compile(r"[<>\"']")
_attr = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_space = re.compile(r"\s+")
_numeric = re.compile(r"&#(?:[xX][0-9a-fA-F]{7,}|[0-9]{8,});?")
_clause = re.compile(r"[.;:!?·|•»©]+")
_about = re.compile(r"(^|\s)(has|no|with|without|is|hide)[-_][\w-]+")
_digits = re.compile(r"\d{3,}")  # numbers of pages and posts in class names


class Node:
    """An element: ``path`` names its style node (of the block around it, for inline elements), ``weight`` is what its presentation says."""

    __slots__ = ("tag", "path", "parent", "dropped", "article", "weight", "children")

    def __init__(self, tag: str, path: int, parent: Node | None, dropped: bool = False, article: bool = False, weight: float = PLAIN) -> None:
        self.tag, self.path, self.parent, self.dropped, self.article, self.weight = tag, path, parent, dropped, article, weight
        self.children: list[Node | str] = []


class _Ends:
    """Finds the end of a tag in one forward pass: a quote without its pair is an ordinary character, and once the rest of the page has no end, nothing is looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.none = page, page.rfind(">"), {'"': len(page) + 1, "'": len(page) + 1}

    def __call__(self, at: int) -> int:
        """The place of the > of the tag that is open at ``at``; -1 if there is none. A < outside quotes spoils the tag: then the next > ends it."""
        if at > self.last:
            return -1
        page, pos = self.page, at
        while m := _stop.search(page, pos):
            c = m[0]
            if c == ">":
                return m.start()
            if c == "<":
                break
            pos = m.end()
            if m.start() < self.none[c]:
                pair = page.find(c, pos)
                if pair < 0:
                    self.none[c] = m.start()
                else:
                    pos = pair + 1
                    if pos > self.last:
                        break
        return page.find(">", at)


def _node(tag: str, raw: str, at: Node) -> Node:
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attr.finditer(raw)} if raw.strip() else {}
    look = _about.sub(" ", f"{a.get('class', '')} {a.get('id', '')}") if a else ""
    role = a.get("role", "").lower()
    hides = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    main = tag in ("article", "main") or role in ("main", "article")
    aside = main and bool(NOT_MAIN.search(look))
    article = at.article or main and not aside
    if hides or aside or tag in FRAME and not (tag == "header" and at.article) or role in ROLES:
        weight = SAYS_NOISE
    elif tag in ("html", "body") or main:
        weight = PLAIN
    elif look and NOISE.search(look):
        weight = SAYS_NOISE
    elif look and OUTER.search(look):
        weight = DOUBTFUL if at.article else SAYS_NOISE
    else:
        weight = SAYS_TEXT if at.article and tag in FLOW and not look.strip() else PLAIN
    if tag in INLINE:
        path = at.path
    else:
        path = xxhash.xxh3_64_intdigest(f"{at.path}>{tag}.{' '.join(sorted(_digits.sub('0', a.get('class', '')).split()))}" if a else f"{at.path}>{tag}.")
    return Node(tag, path, at, at.dropped or tag in DROPPED, article, weight)


def parse(page: str | None) -> Node:
    """The tree of a page, in time linear in its length. Unclosed paragraphs and list items end where the next one starts; an end tag without a start is ignored."""
    page = page or ""
    root = Node("#root", 0, None)
    at, pos, end, depth = root, 0, len(page), 0
    ends, opened = _Ends(page), {}  # elements that are open, by tag

    def close(to: Node) -> Node:
        nonlocal at, depth
        while at is not to:
            opened[at.tag] -= 1
            depth -= 1
            at = at.parent
        return at

    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            at.children.append(page[pos:])
            break
        nxt = page[lt + 1 : lt + 2]
        m = None
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                stop = end if stop < 0 else stop + 3
            else:
                stop = page.find(">", lt) + 1 if lt < ends.last else 0
        else:
            m = _start.match(page, lt + 1)
            stop = ends(m.end()) + 1 if m else 0
        if not stop:  # a bare < is text
            at.children.append(page[pos : lt + 1])
            pos = lt + 1
            continue
        if lt > pos:
            at.children.append(page[pos:lt])
        pos = stop
        if m is None:
            continue
        tag = m[1].lower()
        if nxt == "/":
            if opened.get(tag):
                up = at
                while up.tag != tag:
                    up = up.parent
                close(up.parent)
            elif tag == "p":
                at.children.append(Node("p", at.path, at, at.dropped, at.article))
            continue
        if tag in CLOSES_P and opened.get("p"):
            up = at
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                close(up.parent)
        elif tag in ENDS_LIKE:
            group, up, last = ENDS_LIKE[tag], at, None
            while up.tag not in HOLDERS:
                if up.tag in group:
                    last = up
                up = up.parent
            if last is not None and (tag != "td" and tag != "th" or last.tag in ("td", "th")):
                close(last.parent)
        node = _node(tag, page[m.end() : pos - 1], at)
        at.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            shut = _shut(tag).search(page, pos)
            stop = shut.start() if shut else end
            node.children.append(page[pos:stop])
            pos = page.find(">", stop) + 1 if shut else end
            pos = pos or end
            continue
        if depth < DEPTH:
            at, depth = node, depth + 1
            opened[tag] = opened.get(tag, 0) + 1
    return root


_shuts: dict[str, re.Pattern[str]] = {}


def _shut(tag: str) -> re.Pattern[str]:
    return _shuts.setdefault(tag, re.compile(rf"</{tag}[\s/>]", re.I))


def clean(parts: list[str]) -> str:
    """The text of pieces of a page: references decoded, white space as single spaces, trimmed."""
    t = "".join(parts)
    if "&" in t:
        t = html.unescape(_numeric.sub("�", t))
    return _space.sub(" ", t).strip()


def observe(root: Node) -> tuple[dict[int, tuple[int, ...]], set[tuple[int, int, int]]]:
    """Of a page: the style nodes with those around them, and (node, kind, value): kind 0 for a node, 1 for a clause of its own text, 2 for a layout."""
    chains: dict[int, tuple[int, ...]] = {0: (0,)}
    seen: set[tuple[int, int, int]] = set()
    todo: list[Node] = [root]
    while todo:
        block = todo.pop()
        own: list[str] = []
        layout: list[int] = []
        walk: list[Node | str] = [block]
        while walk:
            x = walk.pop()
            if isinstance(x, str):
                own.append(x)
                continue
            if x is not block:
                if x.dropped:
                    continue
                if x.tag not in INLINE:
                    own.append(" ")
                    layout.append(x.path)
                    if x.path not in chains:
                        chains[x.path] = (x.path, *chains[block.path])
                    todo.append(x)
                    continue
                if x.tag == "br":
                    own.append(" ")
            walk.extend(reversed(x.children))
        seen.add((block.path, 0, 0))
        seen.add((block.path, 2, xxhash.xxh3_64_intdigest(repr(layout))))
        for c in _clause.split(clean(own)):
            if c := c.strip():
                seen.add((block.path, 1, xxhash.xxh3_64_intdigest(c)))
    return chains, seen


def has_article(root: Node) -> bool:
    todo = [root]
    while todo:
        x = todo.pop()
        if x.article and not x.dropped:
            return True
        todo += [c for c in x.children if isinstance(c, Node) and not c.dropped and c.weight >= LEAST]
    return False


def blocks(root: Node, peaks: dict[int, float] | None, names: bool = True) -> list[str]:
    """The blocks of the main text in page order; if the page has an article, only what is in it. ``peaks`` is the importance of branches (1 where there is none).

    Without ``names`` the importance alone decides; with None for ``peaks`` too, only what never is text goes.
    """
    out: list[str] = []
    run: list[str] = []
    peaks = {} if peaks is None else peaks
    only = names and has_article(root)

    def flush() -> None:
        if run:
            if t := clean(run):
                out.append(t)
            run.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.dropped or (x.weight if names else PLAIN) * (1.0 if x.tag in INLINE else peaks.get(x.path, 1.0)) < LEAST:
            if x.tag not in INLINE:
                flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag not in INLINE:
                flush()
                stack.append(None)
            stack.extend(c for c in reversed(x.children) if x.article or not only or isinstance(c, Node))
    flush()
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _site_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, kind, value, pages), added up within the task as far as memory allows; kind 3 is a node (of host 0) and a node around it."""
    seen: dict[tuple[int, int, int, int], float] = {}

    def out() -> pa.RecordBatch:
        host, node, kind, value = (pa.array([_signed(v) for v in c], t) for c, t in zip(zip(*seen, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True))
        r = pa.RecordBatch.from_arrays([host, node, kind, value, pa.array(list(seen.values()), pa.float64())], ["host", "node", "kind", "value", "w"])
        seen.clear()
        return r

    for b in batches:
        for h, w, p in zip(b.column("host").to_pylist(), b.column("w").to_pylist(), b.column("html"), strict=True):
            chains, found = observe(parse(p.as_py()))
            for n, kind, v in found:
                key = (h, n, kind, v)
                seen[key] = seen.get(key, 0.0) + w
            for n, around in chains.items():
                if (0, n, 3, n) not in seen:
                    seen.update(((0, n, 3, a), 1.0) for a in around)
            if len(seen) > TABLE:
                yield out()
    if seen:
        yield out()


def host_key(url):
    """A hash of the host in an address, without port and case; addresses without a host are one site."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def site_counts(pages: DataFrame) -> DataFrame:
    """A row per host, node and kind: sums over its clauses or layouts, of the pages of the host and, once per clause, of hosts (``_all``); ``around`` the nodes around it. ``pages`` has host and html.

    Equal pages of a host count as one page: each has an equal share.
    """
    page = pages.withColumn("page", F.xxhash64("html"))
    copies = written(page.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_NODES else copies
    page = page.join(copies, ["host", "page"], "left").select("host", (1.0 / F.coalesce("copies", F.lit(1))).alias("w"), "html")
    part = map_rows(page, _site_nodes, "host long, node long, kind int, value long, w double").repartition("node", "value")
    each = part.groupBy("host", "node", "kind", "value").agg(F.round(F.sum("w"), 6).alias("n"))
    same = Window.partitionBy("node", "value", "kind")
    each = each.withColumn("all", F.count(F.lit(1)).over(same).cast("double")).withColumn("all", F.when(F.row_number().over(same.orderBy("host")) == 1, F.col("all")))
    up = lambda c: F.greatest(c, F.lit(1.0))
    return each.groupBy("host", "node", "kind").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.log(up(F.col("n")))).alias("h"), F.sum(F.col("n") * F.log(up(F.col("n")))).alias("e"),
        F.sum("all").alias("n_all"), F.count("all").alias("k_all"), F.sum(F.log(up(F.col("all")))).alias("h_all"), F.sum(F.col("all") * F.log(up(F.col("all")))).alias("e_all"),
        F.collect_set(F.when(F.col("kind") == 3, F.col("value"))).alias("around"),
    )


def judged_nodes(pages: DataFrame) -> DataFrame:
    """host, node, peak: the nodes of every host whose branch is not above what a weight can remove."""
    counts = written(site_counts(pages))
    around = counts.filter("kind = 3").select("node", F.explode("around").alias("up"))

    def importance(of: DataFrame, keys: list[str]) -> DataFrame:
        """``of``: keys with m (pages), h and k (of clauses), s (layouts shown), e and l (of layouts)."""
        spread = F.when(F.col("s") > 1.5, F.log("s"))
        tree = of.select(*keys, "h", "k").join(around, "node").groupBy(*[k for k in keys if k != "node"], F.col("up").alias("node")).agg(F.sum("h").alias("th"), F.sum("k").alias("tk"))
        both = of.select(*keys, "m", "s", "e", "l").join(tree, keys).filter("tk > 0")
        layout = F.coalesce((spread - F.col("e") / F.col("s")) / spread, F.lit(1.0))
        g = F.pow(F.lit(DAMP), F.greatest(F.col("l") - 1, F.lit(0)))
        importance = (1 - g) * layout + g * F.exp(-F.col("th") / F.col("tk"))
        return both.select(*keys, ((F.col("m") * importance + FEW_PAGES) / (F.col("m") + FEW_PAGES)).alias("imp"))

    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0.0)).alias(f"{c}{kind}")
    real = counts.filter("kind < 3")
    own = real.groupBy("host", "node").agg(of(0, "n"), of(1, "h"), of(1, "k"), of(2, "n"), of(2, "e"), of(2, "k")).select("host", "node", F.col("n0").alias("m"), F.col("n2").alias("s"), F.col("h1").alias("h"), F.col("k1").alias("k"), F.col("e2").alias("e"), F.col("k2").alias("l"))
    corpus = real.groupBy("node").agg(of(0, "n_all"), of(1, "h_all"), of(1, "k_all"), of(2, "n_all"), of(2, "e_all"), of(2, "k_all")).select("node", F.col("n_all0").alias("m"), F.col("n_all2").alias("s"), F.col("h_all1").alias("h"), F.col("k_all1").alias("k"), F.col("e_all2").alias("e"), F.col("k_all2").alias("l"))
    site, every = importance(own, ["host", "node"]), importance(corpus, ["node"]).select("node", F.col("imp").alias("imp_all"))
    both = site.join(every, "node").join(around, "node")
    peak = both.groupBy("host", F.col("up").alias("node")).agg(F.max("imp").alias("site"), F.max("imp_all").alias("every"))
    tops = peak.groupBy("host").agg(F.max("site").alias("top"), F.max("every").alias("top_all"))
    peak = peak.join(tops, "host").select("host", "node", F.round(F.least(F.col("site") / F.col("top"), F.col("every") / F.col("top_all")), 6).alias("peak"))
    return peak.filter(F.col("peak") < JUDGED_BELOW)


def _extract(batches: Iterator[pa.RecordBatch], names: bool) -> Iterator[pa.RecordBatch]:
    at, peaks = None, {}
    for b in batches:
        text = []
        for h, nodes, p in zip(b.column("host").to_pylist(), b.column("nodes"), b.column("html"), strict=True):
            if h != at:
                at, peaks = h, {x["node"] & (2**64 - 1): x["peak"] for x in nodes.as_py() or ()}
            text.append("\n".join(blocks(parse(p.as_py()), peaks, names)))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, names: bool = True) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars. Without ``names`` the tree decides alone, whatever tags and classes say.

    Null or empty html gives an empty text. A null url belongs to the site of
    addresses without a host. Repeated rows are each extracted (and count as
    one page of their site). A page without an article gives all branches that
    the tree keeps. An empty table gives no rows. Other columns are not looked at.
    """
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_key(F.col("url")).alias("host"))
    with scratch(pages.sparkSession):
        judged = written(judged_nodes(base.select("host", "html")), stay=True)
        few = judged.count() <= BROADCAST_NODES
    nodes = judged.groupBy("host").agg(F.collect_list(F.struct("node", "peak")).alias("nodes"))
    if few:
        rows = base.join(F.broadcast(nodes), "host", "left")
    else:  # a host may have any share of the pages: they are dealt by host and a salt
        nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = base.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(nodes, ["host", "salt"], "left")
    return map_rows(rows.select("page_id", "url", "html", "host", "nodes"), lambda it: _extract(it, names), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
