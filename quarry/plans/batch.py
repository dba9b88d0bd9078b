"""Query files: many queries at once, and responses as JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokenize, tokens_of
from ..sources.shared import table
from .language import QueryError, Term, parse, true_for_nothing
from .search import _signed, mask_of, phrase_hits


def conjunctive(queries: DataFrame, postings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(query_id, id)``: documents that hold every distinct term of ``queries(query_id, text)``, in one pass.

    Queries without a term have no hits. Partial counts per (query, document) are combined before the shuffle.
    """
    asked = queries.select("query_id", F.explode_outer(F.array_distinct(tokenize(F.col("text")))).alias("term")).where("term is not null")
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    met = postings.join(asked, "term").groupBy("query_id", id_col).agg(F.count("*").alias("met"))
    return met.join(wanted, (met["query_id"] == wanted["query_id"]) & (F.col("met") == F.col("n"))).select(met["query_id"], id_col)


#: Queries that are answered by one plan.
AT_ONCE = 64


def boolean_batch(queries: list[tuple[int, object, list[Term]]], postings: DataFrame, tokens: DataFrame, universe: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(query, id)`` of the hits of parsed queries ``(number, tree, operands)``: one scan of the postings of all their
    words, one aggregation of operand bits by query and document."""
    words: dict[str, dict[int, int]] = {}
    parts = []
    for number, _, operands in queries:
        for o in operands:
            if len(o.words) == 1:
                bits = words.setdefault(o.words[0], {})
                bits[number] = bits.get(number, 0) | 1 << o.bit
            else:
                hits = phrase_hits(tokens, [[w] for w in o.words], id_col)
                parts.append(hits.select(F.lit(number).alias("query"), id_col, F.lit(_signed(o.bit)).cast("long").alias("bits")))
    if words:
        pairs = [F.struct(F.lit(w).alias("w"), F.lit(q).alias("query"), F.lit(b - (1 << 64) if b >> 63 else b).cast("long").alias("bits")) for w, by in words.items() for q, b in by.items()]
        wanted = postings.where(F.col("term").isin(*words)).select(id_col, "term", F.explode(F.array(*pairs)).alias("x")).where(F.col("term") == F.col("x.w"))
        parts.append(wanted.select("x.query", id_col, "x.bits"))
    masks = reduce(DataFrame.unionByName, parts).groupBy("query", id_col).agg(F.bit_or("bits").alias("mask"))
    absent = [number for number, tree, _ in queries if true_for_nothing(tree)]
    if absent:
        # These hold for documents without any operand, so that all documents are looked at.
        every = universe.select(id_col, F.explode(F.array(*map(F.lit, absent))).alias("query"))
        rest = every.join(masks, ["query", id_col], "left").select("query", id_col, F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))
        masks = rest.unionByName(masks.where(~F.col("query").isin(*absent)).select("query", id_col, "mask"))
    holds = F.lit(False)
    for number, tree, _ in queries:
        holds = F.when(F.col("query") == number, mask_of(tree, F.col("mask"))).otherwise(holds)
    return masks.where(holds).select("query", id_col)


def respond(lines: list[str], spark: SparkSession, corpus: DataFrame, postings: DataFrame, tokens: DataFrame, limit: int = 5, id_col: str = "doc_id") -> list[str]:
    """One JSON line per query line: hits with the total, or the error; a bad line does not stop the rest.

    Queries are answered ``AT_ONCE`` at a time by one plan; at most ``limit`` hits of each come to the driver.
    """
    import json

    out: dict[int, dict] = {}
    good = []
    for i, line in enumerate(lines):
        try:
            good.append((i, *parse(line, tokens_of)))
        except QueryError as e:
            out[i] = {"query": line, "error": str(e)}
    for lo in range(0, len(good), AT_ONCE):
        part = good[lo : lo + AT_ONCE]
        hits = table(boolean_batch(part, postings, tokens, corpus, id_col), "batch")
        totals = {r.query: r["count"] for r in hits.groupBy("query").count().collect()}
        first = hits.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(id_col))).where(F.col("k") <= limit)
        named = corpus.select(id_col, "title").join(F.broadcast(first), id_col).collect()  # limit x AT_ONCE rows
        for i, _, _ in part:
            mine = sorted((r for r in named if r.query == i), key=lambda r: r.k)
            out[i] = {"query": lines[i], "total": totals.get(i, 0), "results": [{"id": r[id_col], "title": r.title} for r in mine]}
    return [json.dumps(out[i], ensure_ascii=False) for i in range(len(lines))]


def result_page(query: str, results: list[dict], total: int) -> str:
    """A plain HTML page of results with marked snippets; everything that comes from outside is escaped."""
    import html

    from ..operators.snippet import marked

    rows = []
    for r in results:
        href = r.get("url") or ""
        title = html.escape(r.get("title") or href or str(r.get("id")))
        link = f'<a href="{html.escape(href, quote=True)}">{title}</a>' if href.startswith(("http://", "https://")) else title
        rows.append(f"<li>{link}<p>{marked(r.get('snippet') or '', [tuple(m) for m in r.get('snippet_matches') or []])}</p></li>")
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(query)}</title><form><input name="q" value="{html.escape(query, quote=True)}"></form><p>{total}</p><ol>{"".join(rows)}</ol>'
