"""Snippets of the few documents that a search returns: an Arrow-batched UDF over their bodies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN_RE2
from ..sources.shared import ship

MAX_BYTES, LEAD, MAX_SPANS, MAX_TERM = 600, 200, 64, 256
_TOKEN = re.compile(
    r"(?<!\.)[A-Za-zА-яЁёÀ-ÖØ-öø-ſ](?:\.[A-Za-zА-яЁёÀ-ÖØ-öø-ſ]){2,}+(?![0-9A-Za-zА-яЁёÀ-ÖØ-öø-ſ̀-ͯ])\.?"
    r"|[cC](?:#|\+\+)[0-9]*+(?![0-9A-Za-zА-яЁёÀ-ÖØ-öø-ſ̀-ͯ+#])|" + TOKEN_RE2
)
_FOLD = str.maketrans("ſ‐‑’ʼ", "s--''")


def _fold(token: str) -> str:
    t = "İ".join(p.lower() for p in token.translate(_FOLD).split("İ"))
    return t.replace(".", "") if re.match(r"^[^\W\d_]\.", t) else t


def groups(words: list[str], lemmas: dict[str, list[str]] | None = None, boolean: bool = False) -> dict[str, int]:
    """term -> bits of the query words it stands for; lemmas of a word share its bit, very long terms are left out."""
    out: dict[str, int] = {}
    bit = 0
    for w in words[:64]:
        if boolean and w in ("and", "or", "not"):
            continue
        for t in {w, *(lemmas or {}).get(w, ())}:
            if len(t.encode()) <= MAX_TERM:
                out[t] = out.get(t, 0) | 1 << bit
        bit += 1
    return out


def _boundary(text: str, at: int) -> bool:
    """Does a sentence end with the character at ``at``?"""
    c = text[at]
    return c == "\n" or (c in ".!?" and (at + 1 == len(text) or text[at + 1].isspace()))


def snippet(text: str, terms: dict[str, int]) -> tuple[str, list[tuple[int, int]], bool, bool]:
    """``(snippet, byte spans of the hits in it, cut at the left, cut at the right)``.

    The best sentence has most query words, then most hits close together, then the earliest begin. It is widened to its
    paragraph and cut to ``MAX_BYTES`` around the first hit. Without hits, the first sentence.
    """
    raw = text.encode()
    if not raw.strip():
        return "", [], False, False
    hits, offset, last = [], 0, 0
    for m in _TOKEN.finditer(text):
        mask = terms.get(_fold(m[0]))
        if mask:
            offset += len(text[last : m.start()].encode())
            last = m.start()
            hits.append((m.start(), offset, offset + len(m[0].encode()), mask))
    sentences, start = [], 0
    for at in range(len(text)):
        if _boundary(text, at):
            sentences.append((start, at + 1))
            start = at + 1
    sentences.append((start, len(text)))
    best, best_score, h = None, None, 0
    for a, b in sentences:
        mine = []
        while h < len(hits) and hits[h][0] < b:
            mine.append(hits[h])
            h += 1
        if mine:
            seen = 0
            for x in mine:
                seen |= x[3]
            width = mine[-1][2] - mine[0][1]
            score = 10_000 * seen.bit_count() + 100 * len(mine) ** 2 / (width + 1) - mine[0][1] / 10_000
            if best_score is None or score > best_score:
                best, best_score = (a, b, mine[0][1]), score
    if best is None:
        a, b = next(((x, y) for x, y in sentences if text[x:y].strip()), sentences[0])
        lo, hi = len(text[:a].encode()), len(text[:b].encode())
        first = lo
    else:
        a = text.rfind("\n", 0, best[0]) + 1
        b = text.find("\n", max(best[0], best[1] - 1))
        b = len(text) if b < 0 else b
        lo, hi, first = len(text[:a].encode()), len(text[:b].encode()), best[2]
    floor, ceiling = lo, hi
    if hi - lo > MAX_BYTES:
        lo = max(lo, min(first - LEAD, hi - MAX_BYTES))
        hi = min(hi, lo + MAX_BYTES)
    while lo < hi and raw[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
        hi -= 1
    left, right = lo > floor, hi < ceiling
    while lo < hi and raw[lo : lo + 1].isspace():
        lo += 1
    while hi > lo and raw[hi - 1 : hi].isspace():
        hi -= 1
    spans = [(x[1] - lo, x[2] - lo) for x in hits if x[1] >= lo and x[2] <= hi][:MAX_SPANS]
    return raw[lo:hi].decode(), spans, left, right


def with_snippets(hits: DataFrame, terms: dict[str, int], body_col: str = "body") -> DataFrame:
    """``hits`` with ``snippet, snippet_matches, snippet_left, snippet_right``. For results after their limit."""
    ship(hits.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kind = T.StructType([T.StructField("snippet", T.StringType()), T.StructField("snippet_matches", span), T.StructField("snippet_left", T.BooleanType()), T.StructField("snippet_right", T.BooleanType())])

    @F.pandas_udf(kind)
    def cut(bodies: pd.Series) -> pd.DataFrame:
        rows = [snippet(b or "", terms) for b in bodies]
        return pd.DataFrame([(s, [{"begin": x, "end": y} for x, y in m], left, right) for s, m, left, right in rows], columns=["snippet", "snippet_matches", "snippet_left", "snippet_right"])

    return hits.withColumn("_s", cut(F.col(body_col))).select(*hits.columns, "_s.*")


def marked(snippet_text: str, spans: list[tuple[int, int]]) -> str:
    """HTML of a snippet with its hits in ``<mark>``, everything else escaped."""
    import html

    raw, out, at = snippet_text.encode(), [], 0
    for a, b in spans:
        out += [html.escape(raw[at:a].decode()), "<mark>", html.escape(raw[a:b].decode()), "</mark>"]
        at = b
    return "".join([*out, html.escape(raw[at:].decode())])
