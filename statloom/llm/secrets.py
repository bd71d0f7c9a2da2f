"""Secret scanning with a random forest that removes false positives, in DataFrame operations only.

A candidate is a long run of key characters that mixes letters and digits, or a
value of any characters that is assigned to a name that calls it secret. Spark expressions give its features:
length, character transitions, coverage by dictionary words, signs of a path,
and the words before and after. The forest is grown in numpy on the driver from
a bounded table of labelled findings and is emitted as one nested conditional
expression per tree, so scoring stays in the plan.

A text is handled within its row: it is cut at its candidates into an array, and
places, features and scores are transformations of that array. Nothing is joined
or shuffled, and the work is in proportion to the text (times the square root of
its number of candidates for the places).
"""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Words and endings that make up names, paths and placeholders rather than keys.
DICTIONARY = (
    "about|access|account|action|address|admin|after|archive|article|assets|author|back|base|beta|blog|body|book|build|button|cache|cart|category|center|change|changeme|check|class|client|cloud|code|color|com|comment|common|config|connect|contact|content|core|count|country|create|custom|daily|data|date|debug|default|demo|design|detail|device|dev|digital|document|"
    "domain|download|dummy|edit|email|error|event|example|export|feed|field|file|first|float|folder|font|form|forum|from|function|gallery|game|green|group|guide|head|header|health|help|here|home|host|house|html|http|https|icon|image|import|index|info|input|insert|internal|invoice|item|java|jpg|json|just|label|language|last|latest|left|library|license|light|line|link|list|live|local|login|logo|"
    "mail|main|manager|market|master|media|member|menu|message|meta|mobile|model|module|music|name|net|news|next|none|null|number|object|office|offer|online|open|option|order|org|page|password|path|pdf|photo|placeholder|plugin|png|policy|post|price|print|private|product|profile|project|public|query|read|release|report|request|response|result|right|sale|sample|screen|script|search|secret|section|"
    "secure|server|service|session|setting|share|shop|show|side|site|size|source|special|start|static|status|stock|store|style|support|system|table|team|template|test|text|that|the|theme|this|time|title|token|tool|topic|total|travel|true|type|update|upload|url|user|value|version|video|view|web|week|white|widget|window|with|work|world|www|year|your|"
    "able|ado|ando|ation|aux|cion|der|die|eau|ement|esta|heit|ical|ing|keit|les|lich|ment|mente|ness|que|sch|tion|ung|ville|xxxx|0000|1234|abcd"
)
#: Names before a value that call it secret, and names that call it public.
SECRET_NAMES = "token|secret|passw|pwd|api_?-?key|apikey|auth|bearer|credential|private|access_?-?key|session|signature|cookie"
PUBLIC_NAMES = "commit|sha-?\\d|sha|md5|checksum|digest|hash|etag|uuid|guid|integrity|revision|build|version|id|isbn|doi|ref|file|path|url|href|src|image|base64"
_KEY = r"A-Za-z0-9_\-+/=.@:%"
_VALUE = r"""[^\s"'`]{8,}+"""
#: name=value after the start of a word, or a value of 8 and more characters after a secret name and = or :, or a run of 12 and more key characters with a letter and a digit. Cheap conditions first; no run has an upper length.
CANDIDATE = (
    rf"""(?:(?<![{_KEY}])(?=[\w.\-]{{3,}}+[=:][^\s"'`=:>])(?i:[\w.\-]*?(?:{SECRET_NAMES})[\w.\-]{{0,12}})[=:]{_VALUE}"""
    rf"""|(?<=[=:>]["'`\s]{{0,3}})(?=[^\s"'`=:>][^\s"'`]{{7}})(?<=(?i:{SECRET_NAMES.replace("?", "{0,1}")})[\w.\-]{{0,12}}["'`]{{0,1}}\s{{0,2}}[=:]>{{0,1}}\s{{0,2}}["'`]{{0,1}}){_VALUE}"""
    rf"""|(?<![{_KEY}])(?=[A-Za-z_\-+/=.@:%]*+[0-9])(?=[0-9_\-+/=.@:%]*+[A-Za-z])[{_KEY}]{{12,}}+)"""
)
NEAR = 48
TREES, DEPTH, SEED = 15, 5, 7
#: The most labelled findings that are used for training (least hash of the text around them).
TRAIN_ROWS = 20_000
FEATURES = ("length", "digits", "uppers", "hex", "transitions", "case_changes", "dictionary", "vowel_runs", "longest_letters", "specials", "slashes", "dots", "at", "is_uuid", "names_secret", "names_public", "assigned", "quoted", "placeholder", "after_word", "distinct")


def _clean(text: Column) -> Column:
    """The text with the mark of :func:`pieces` as a space; places do not change."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "\x01", " ")


def pieces(text: Column) -> Column:
    """A text cut at its candidates: every second piece is a candidate. Null if it has none.

    The row's number (never negative) keeps the optimizer from copying the
    expression into what is made of it, where it would run once per candidate.
    """
    return F.when(text.rlike(CANDIDATE) & (F.monotonically_increasing_id() >= 0), F.split(F.regexp_replace(text, F.lit("(" + CANDIDATE + ")"), F.lit("\x01$1\x01")), "\x01"))


def places(p: Column) -> Column:
    """The lengths before each piece: sums over stretches of about the square root of their number, then within each."""
    n = F.size(p)
    step = F.ceil(F.sqrt(n)).cast("int")
    stretches = F.transform(F.sequence(F.lit(1), n, step), lambda i: F.transform(F.slice(p, i, step), F.length))
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    total = lambda of: F.aggregate(of, F.lit(0), lambda a, x: a + x)
    before = lambda of: F.aggregate(F.transform(of, total), F.array(F.lit(0)), grow)
    return F.flatten(F.zip_with(stretches, F.slice(before(stretches), F.lit(1), F.size(stretches)), lambda of, at: F.slice(F.aggregate(of, F.array(at), grow), F.lit(1), F.size(of))))


def candidates(p: Column, at: Column) -> Column:
    """Structs (start, value, before, after) of the candidates of a text, from its :func:`pieces` and :func:`places`; before and after are up to NEAR characters each."""

    def one(x: Column, start: Column) -> Column:
        # a run may end a sentence or a clause; what is in quotes ends with them
        value = F.when(x["before"].rlike("[\"'`]$"), F.regexp_replace(x["value"], r"[.:,]+$", "")).otherwise(F.regexp_replace(x["value"], r"[.:,;)]+$", ""))
        near = F.substring(x["before"], F.greatest(F.length(x["before"]) - NEAR + 1, F.lit(1)), F.lit(NEAR))
        return F.struct(start.alias("start"), value.alias("value"), near.alias("before"), F.substring(x["after"], F.lit(1), F.lit(NEAR)).alias("after"))

    around = F.zip_with(every_second(p, 0), every_second(p, 1), lambda b, v: F.struct(b.alias("before"), v.alias("value")))
    three = F.zip_with(around, F.slice(every_second(p, 0), F.lit(2), F.size(p)), lambda x, a: F.struct(x["before"].alias("before"), x["value"].alias("value"), a.alias("after")))
    return F.zip_with(F.filter(three, lambda x: x["value"].isNotNull()), every_second(at, 1), one)


def every_second(x: Column, first: int) -> Column:
    return F.filter(x, lambda _, i: i % 2 == first)


_NAMED = r"^([A-Za-z_][A-Za-z_.\-]{1,39})[=:](?=.)"


def features(value: Column, before: Column, after: Column, dictionary: str = DICTIONARY) -> list[Column]:
    """One double per name in FEATURES."""
    # name=value in one run: the name counts as a word before
    name = F.lower(F.regexp_extract(value, _NAMED, 1))
    named = F.length(name) > 0
    c = F.when(named, F.substring(value, F.length(name) + 2, F.length(value))).otherwise(value)
    b = F.concat(F.lower(before), name)
    n = F.greatest(F.length(c), F.lit(1))
    count = lambda rx: F.regexp_count(c, F.lit(rx))
    tail = F.regexp_extract(b, r"([^\s]{0,40})[\s]*[\"'`(]*[\s]*[=:]*>?[\s]*[\"'`(]*$", 1)
    last_word = F.substring(b, F.greatest(F.length(b) - 30, F.lit(1)), F.lit(31))
    each = {
        "length": F.length(c), "digits": count("[0-9]") / n, "uppers": count("[A-Z]") / n, "hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "transitions": count("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n, "case_changes": count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), f"({dictionary})", "")) / n, "vowel_runs": count("(?i)[bcdfghjklmnpqrstvwxz][aeiouy]") / n,
        "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)), "specials": count("[^A-Za-z0-9]") / n,
        "slashes": count("/"), "dots": count("[.]"), "at": c.contains("@") | c.rlike("^(?i)https?:|www[.]|://"), "is_uuid": c.rlike("(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"),
        "names_secret": tail.rlike(SECRET_NAMES) | last_word.rlike(f"({SECRET_NAMES})[\\w]{{0,12}}[\\s\"'`]*[=:]?[\\s\"'`]*$"), "names_public": last_word.rlike(f"(^|[^a-z])({PUBLIC_NAMES})[\\s\"'`]*[=:]?[\\s\"'`]*$"),
        "assigned": named | b.rlike("[=:]>?[\\s\"'`]*$"), "quoted": b.rlike("[\"'`]$"), "placeholder": F.lower(c).rlike("x{4}|0{5}|1234|abcd|example|sample|your|changeme|dummy|placeholder|insert|(.)\\1{4}"),
        "after_word": after.rlike("^[\"'`]?[\\s,;)]|^[\"'`]?$"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.sqrt(n),
    }
    return [each[k].cast("double").alias(k) for k in FEATURES]


@lru_cache
def labelled_findings(n: int = 3000) -> tuple[tuple[str, str, str, int], ...]:
    """The findings that come with the library: (before, value, after, is_secret), made by a seeded rule from the shapes that keys and their look-alikes have."""
    rng = random.Random(SEED)
    hexa = lambda k: hashlib.sha512(str(rng.random()).encode()).hexdigest()[:k]
    chars = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    low, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    up = low.upper()
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "es", "ti", "or", "sch", "ung", "lich", "eau", "que", "ment", "ado", "ción")) for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 5)))
    names = ("token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "private_key", "apikey", "passwd", "API_TOKEN", "SECRET_KEY", "db_password", "session_token", "credential")
    public = ("commit", "sha256", "sha1", "md5", "checksum", "digest", "hash", "etag", "uuid", "id", "revision", "build", "version", "integrity", "ref", "file")
    sep = lambda: rng.choice((' = "', "=", ": ", ":", ' : "', ' => "', "='", " = ", '="'))
    out = []
    for i in range(n):
        before, after = prose() + " ", rng.choice((" ", '" ', "' ", "\n", "", '"### ', "*** ")) + prose()
        key = rng.choice((lambda: hexa(rng.choice((16, 18, 20, 24, 32, 40, 48, 64))), lambda: chars(rng.randint(16, 44), low + up + digit), lambda: chars(rng.randint(20, 64), low + up + digit + "+/") + "=", lambda: chars(rng.randint(12, 24), low + digit + up + "_-")))
        if i % 2 == 0:
            kind = rng.randrange(7)
            if kind < 3:
                before, value = before + rng.choice(names) + sep(), key()
            elif kind == 3:
                value = rng.choice(names) + rng.choice("=:") + key()
            elif kind == 4:
                value = "AKIA" + chars(16, up + digit)
            elif kind == 5:
                value = rng.choice(("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-", "AIza")) + chars(36, low + up + digit)
            else:
                before, value = before + rng.choice(("Authorization: Bearer ", "Authorization: Basic ", "x-api-key: ")), "eyJ" + chars(rng.randint(30, 80), low + up + digit + "_-")
            out.append((before, value, after, 1))
            continue
        kind = rng.randrange(13)
        if kind == 0:
            before, value = before + rng.choice(public) + sep(), key()
        elif kind == 1:
            before, value = before + rng.choice(("", "id = ", 'uuid: "')), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}"
        elif kind == 2:
            value = f"{word()}.{chars(2, digit)}@mail{chars(1, digit)}.example.com"
        elif kind == 3:
            value = f"https://www.{word()}.example.org/{word()}/{chars(4, digit)}/{word()}-{chars(2, digit)}.html"
        elif kind == 4:
            value = f"/usr/lib/{word()}/{word()}-{chars(1, digit)}.{chars(2, digit)}/{word()}.so"
        elif kind == 5:
            before, value = before + rng.choice(names) + sep(), rng.choice(("your-token-here-123", "xxxxxxxxxxxx1234", "EXAMPLE_KEY_000000", "changeme12345678", "<insert-key-1>", "000000000000000a", "sample-api-key-1", "abcd1234abcd1234", "test_secret_value_1", "placeholder-0001"))
        elif kind == 6:
            value = word() + word() + chars(rng.randint(1, 2), digit) + word() + word()
        elif kind == 7:
            before, value = before + rng.choice(("version ", "v", "release=")), f"{chars(1, digit)}.{chars(2, digit)}.{chars(1, digit)}-beta.{chars(8, digit)}"
        elif kind == 8:
            value = rng.choice(("image", "photo", "report", "screenshot")) + f"_{chars(8, digit)}_{chars(6, digit)}." + rng.choice(("jpg", "png", "pdf"))
        elif kind == 9:
            before, value = before + "data:image/png;base64,", chars(rng.randint(40, 200), low + up + digit + "+/")
        elif kind == 10:
            value = f"{chars(4, digit)}-{chars(2, digit)}-{chars(2, digit)}T{chars(2, digit)}:{chars(2, digit)}:{chars(2, digit)}Z"
        elif kind == 11:
            value = chars(rng.randint(12, 20), digit) + rng.choice(("km", "EUR", "px"))
        else:
            before, value = before + rng.choice(("commit ", "Merge ", "sha256:", "index ", "md5sum ")), hexa(rng.choice((32, 40, 64)))
        out.append((before, value, after, 0))
    for i in range(n // 5):  # assigned values that are no keys: passwords and passphrases, and words that only explain a name
        name, mark = rng.choice(names), rng.choice("!#$&*?~^")
        if i % 3 < 2:
            value = rng.choice((lambda: chars(rng.randint(4, 10), low) + chars(rng.randint(1, 4), digit) + mark, lambda: chars(rng.randint(8, 16), low + up + digit), lambda: chars(rng.randint(2, 6), up + low) + mark + chars(rng.randint(4, 10), low + digit) + mark, lambda: "".join(rng.choice(("correct", "horse", "battery", "winter", "dragon", "purple", "monkey", "summer")) for _ in range(3))))()
            out.append((prose() + " " + name + sep(), value, rng.choice(('"', "'", " ", "\n")) + " " + prose(), 1))
        else:
            out.append((prose() + " " + name + rng.choice((": ", " = ", "=", ' = "')), rng.choice(("required", "optional", "undefined", "<password>", "${PASSWORD}", "{{ token }}"[:8], "process.env.TOKEN", "your_password", "placeholder", "changeme1", "********", "xxxxxxxx")), " " + prose(), 0))
    return tuple(out)


def findings_table(spark: SparkSession) -> DataFrame:
    """before, value, after, label as a table of literals."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    rows = ",".join(f"({q(b[-NEAR:])},{q(v)},{q(a[:NEAR])},{y})" for b, v, a, y in labelled_findings())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(before, value, after, label)")


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> tuple | float:
    """A tree: (feature, threshold, left for <=, right) or the share of secrets in a leaf."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    if depth == 0 or len(y) < 10 or y.min() == y.max():
        return float(p)
    best = None
    for f in rng.choice(x.shape[1], 6, replace=False):
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        mid = (values[:-1] + values[1:]) / 2
        for t in mid if len(mid) <= 24 else np.quantile(mid, np.linspace(0.02, 0.98, 24)):
            left = x[:, f] <= t
            k = int(left.sum())
            if 3 <= k <= len(y) - 3:
                a, b = y[left].mean(), y[~left].mean()
                cost = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
                if best is None or cost < best[0]:
                    best = (cost, int(f), float(t), left)
    if best is None:
        return float(p)
    _, f, t, left = best
    return f, t, grow(x[left], y[left], rng, depth - 1), grow(x[~left], y[~left], rng, depth - 1)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list:
    rng = np.random.default_rng(SEED)
    return [grow(x[i := rng.integers(0, len(y), len(y))], y[i], rng, depth) for _ in range(trees)] if len(y) else [0.5]


def tree_column(tree: tuple | float, x: Column) -> Column:
    """A tree as a conditional on the fields of the struct ``x``."""
    if isinstance(tree, float):
        return F.lit(tree)
    f, t, low, high = tree
    return F.when(x[FEATURES[f]] <= F.lit(t), tree_column(low, x)).otherwise(tree_column(high, x))


def train_forest(labelled: DataFrame, bound: int = TRAIN_ROWS) -> list:
    """A forest from labelled findings (before, value, after, label: 1 for a secret); rows with a null are left out."""
    some = labelled.select("before", "value", "after", F.col("label").cast("int").alias("label")).dropna().orderBy(F.xxhash64("before", "value", "after"), "value", "before", "after", "label").limit(bound)
    rows = some.select("label", *features(F.col("value"), F.col("before"), F.col("after"))).collect()
    x = np.array([[r[k] for k in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_forest(x, np.array([r.label for r in rows], float))


def scored(docs: DataFrame, text: str, labelled: DataFrame | None) -> tuple[DataFrame, str, str]:
    """``docs`` with a column of the pieces of ``text`` and one of its findings, structs (start, value, score), both null for a text without candidates, and their names."""
    forest = train_forest(findings_table(docs.sparkSession) if labelled is None else labelled)
    p, at, found = (fresh(docs, c) for c in ("__pieces", "__places", "__found"))
    df = docs.withColumn(p, pieces(_clean(F.col(text)))).withColumn(at, places(F.col(p))).withColumn(found, candidates(F.col(p), F.col(at))).drop(at)
    with_features = lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), F.struct(*features(c["value"], c["before"], c["after"])).alias("x"))
    mean = lambda x: F.round(reduce(lambda a, b: a + b, [tree_column(t, x) for t in forest]) / F.lit(float(len(forest))), 9)
    df = df.withColumn(found, F.transform(found, with_features))
    return df.withColumn(found, F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), mean(c["x"]).alias("score")))), p, found


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """A row per candidate of every whole text: doc_id (or ``keep``), start, length, value, score, is_secret.

    start counts code points from 0; a name in front of a value (name=value) is
    part of the candidate. A null or empty text has no candidates; a null doc_id
    is kept; each of repeated rows has its own. Columns of ``docs`` other than
    ``keep`` and text are not looked at. ``labelled`` is a table of labelled
    findings (before, value, after, label); by default the library's own.
    """
    keep = keep or ["doc_id"]
    df = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col("text").cast("string").alias("text"))
    df, p, found = scored(df.filter(_clean(F.col("text")).rlike(CANDIDATE)), "text", labelled)
    rows = df.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.explode_outer(found).alias("__f"))
    f = F.col("__f")
    return rows.filter(f.isNotNull()).select(*keep, f["start"].cast("long").alias("start"), F.length(f["value"]).cast("long").alias("length"), f["value"].alias("value"), f["score"].alias("score"), (f["score"] >= threshold).alias("is_secret"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in text replaced by ``mark`` (and n_chars, if there is one, counted anew); no row is dropped.

    A null or empty text and one without a secret stay as they are; repeated rows
    are each redacted; columns of any other name are kept as they are.
    """
    df, p, found = scored(docs, "text", labelled)
    done = fresh(df, "__done")
    hit = F.exists(found, lambda f: f["score"] >= threshold)

    def shown(x: Column, f: Column) -> Column:
        return F.when(f["score"] >= threshold, F.concat(F.lit(mark), F.substring(x, F.length(f["value"]) + 1, F.length(x)))).otherwise(x)

    masked = F.zip_with(every_second(F.col(p), 1), F.col(found), shown)
    whole = F.array_join(F.zip_with(every_second(F.col(p), 0), masked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    df = df.withColumn(done, F.when(hit, whole))
    new = {"text": F.coalesce(F.col(done), F.col("text").cast("string")).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(done).isNull(), F.col("n_chars")).otherwise(F.length(done)).cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")
    return df.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])
