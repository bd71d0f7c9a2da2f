"""Fill-in-the-middle transformation as numpy kernels over whole Arrow batches.

A text is cut into tokens (a run of ASCII letters, or one other code point). The
kernel never looks at a text by itself: a table of byte classes turns the UTF-8
bytes of a batch into classes, a mask of adjacent bytes marks where tokens begin,
running sums that start anew at each text count them, and one sorted search finds
the cuts of all rows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 transformed ones so many in the order suffix, prefix, middle.
RATE, SPM = 90, 20
#: Byte classes: a byte within a code point, a letter, the first byte of any other code point.
INSIDE, LETTER, OTHER = 0, 1, 2
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x80:0xC0] = INSIDE
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = LETTER


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts (null: empty) and where each begins and ends in them (one more than there are texts)."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return body, at - at[0]


def marks(body: np.ndarray, at: np.ndarray, letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the marks ``<x>`` for each x of ``letters``, within one text each, and the rows they are in."""
    if len(body) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hit = (body[:-2] == ord("<")) & (body[2:] == ord(">"))
    place = np.flatnonzero(hit)
    place = place[np.isin(body[place + 1], np.frombuffer(letters.encode(), np.uint8))]
    row = np.searchsorted(at, place, side="right") - 1
    whole = place + 3 <= at[row + 1]
    return place[whole], row[whole]


def _joined(parts: list[list[bytes | np.ndarray]], rows: int) -> tuple[pa.Array, np.ndarray]:
    """One text per row from its parts in order."""
    sizes = np.array([sum(map(len, p)) for p in parts], np.int64).reshape(rows)
    out = np.concatenate([[0], np.cumsum(sizes)])
    data = pa.py_buffer(b"".join(bytes(x) if isinstance(x, bytes) else x.data for p in parts for x in p))
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(out), data]), sizes


def transform(texts: pa.Array, h: np.ndarray) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch; ``h`` has four unsigned numbers per row."""
    body, at = bytes_of(texts)
    rows = len(at) - 1
    kind = _CLASS[body]
    begins = kind == OTHER
    letter = kind == LETTER
    begins[1:] |= letter[1:] & ~letter[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = True  # a letter at the start of a text begins a token whatever the text before ends with
    tokens = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    before = tokens[at[:-1]]
    n = tokens[at[1:]] - before
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    # token k of a row begins where the running count first reaches before + k + 1
    cut = lambda k: np.minimum(np.searchsorted(tokens[1:], before + k + 1), at[1:])
    low, high = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    plain = (n == 0) | (h[:, 2] % 100 >= RATE)
    plain[marks(body, at, "PSM")[1]] = True
    spm = ~plain & (h[:, 3] % 100 < SPM)
    chars = np.concatenate([[0], np.cumsum(kind != INSIDE, dtype=np.int64)])
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    parts = []
    for i in range(rows):
        a, b, c, d = at[i], low[i], high[i], at[i + 1]
        parts.append([body[a:d]] if plain[i] else [s, body[c:d], p, body[a:b], m, body[b:c]] if spm[i] else [p, body[a:b], s, body[c:d], m, body[b:c]])
    return {
        "n": pa.array(n),
        "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()),
        "prefix_chars": pa.array(chars[low] - chars[at[:-1]], mask=plain),
        "middle_chars": pa.array(chars[high] - chars[low], mask=plain),
        "output": _joined(parts, rows)[0],
    }


def rebuild(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts behind the outputs, from outputs and forms alone."""
    body, at = bytes_of(outputs)
    rows = len(at) - 1
    form = forms.fill_null("plain").to_numpy(zero_copy_only=False)
    where = {}
    for x in "PSM":
        place, row = marks(body, at, x)
        where[x] = np.full(rows, -1, np.int64)
        where[x][row[::-1]] = place[::-1]  # the first of each row
    p, s, m = where["P"], where["S"], where["M"]
    parts = []
    for i in range(rows):
        a, d = at[i], at[i + 1]
        if form[i] == "psm":
            parts.append([body[a + 3 : s[i]], body[m[i] + 3 : d], body[s[i] + 3 : m[i]]])
        elif form[i] == "spm":
            parts.append([body[p[i] + 3 : m[i]], body[m[i] + 3 : d], body[a + 3 : p[i]]])
        else:
            parts.append([body[a:d]])
    return _joined(parts, rows)[0]


def _fim(batches: Iterator[pa.RecordBatch], keep: list[str], text: str, hashes: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = np.stack([b.column(c).to_numpy() for c in hashes], axis=1)
        new = transform(b.column(text), h)
        new["output"] = new["output"].cast(pa.string())
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *new.values()], [*keep, *new])


def _unfim(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], rebuild(b.column("output"), b.column("form")).cast(pa.string())], [*keep, "restored"])


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``; a null id counts as the empty text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output of every row.

    A null text is an empty one and stays plain, as do texts that hold one of the
    marks. Rows that repeat an id are cut alike; a null id is cut as the empty id.
    Texts of any length are taken whole, one is the least that a batch holds. An
    empty table gives no rows; other columns are not looked at.
    """
    names = [fresh(docs, f"__h{i}") for i in range(4)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"), *[h.alias(n) for h, n in zip(draws(F.col(doc_id), seed), names, strict=True)])
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_rows(rows, lambda it: _fim(it, ["doc_id"], "__text", names), schema)


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` (with output and form) and restored: the text without its marks, in order. A null output is an empty text, a null form a plain one."""
    keep = [c for c in outputs.columns if c != "restored"]
    rows = outputs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", restored string"
    return map_rows(rows, lambda it: _unfim(it, keep), schema)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ts, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT *, len(ts)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(ts[1 : a], '') AS pre, array_to_string(ts[a + 1 : b], '') AS mid, array_to_string(ts[b + 1 : n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
