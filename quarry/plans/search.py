"""Queries compiled to DataFrames: Boolean and phrase search, ranked search, diagnostic search.

Boolean queries need no join per operator: every operand is a bit, one scan of the postings of all the query's terms
gives each document the OR of its bits, and the query tree becomes one expression over that mask. Only a query that
holds for documents without any operand joins the universe. ``search_by_sets`` is the plain translation with set
operations, for comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import idf, log_tf, tokens_of
from ..sources.shared import numbered, table
from .language import And, Not, Or, QueryError, Term, parse, true_for_nothing

MAX_TERMS, MAX_RESULTS, MAX_DIAGNOSTIC = 512, 1000, 2048


def slots(words: list[str] | tuple[str, ...], lemmas: dict[str, list[str]] | None = None) -> list[list[str]]:
    """The alternatives of each query word: itself, or its lemmas in the lemma space."""
    return [[w] if lemmas is None else lemmas.get(w, [w]) for w in words]


def mask_of(tree, mask: Column) -> Column:
    """The query tree over a bit mask. Bit 63 is the sign, hence the comparison with zero."""
    if isinstance(tree, Term):
        bit = 1 << tree.bit
        return mask.bitwiseAND(F.lit(bit - (1 << 64) if bit >> 63 else bit)) != 0
    if isinstance(tree, Not):
        return ~mask_of(tree.part, mask)
    return reduce(lambda a, b: a & b if isinstance(tree, And) else a | b, (mask_of(p, mask) for p in tree.parts))


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64) if bit == 63 else 1 << bit


def phrase_hits(tokens: DataFrame, words: list[list[str]], id_col: str = "doc_id") -> DataFrame:
    """Distinct ids of documents with the words in a row in one field; each slot may have alternatives.

    Every occurrence of a slot's word votes for the start of the phrase; a start with all slots is a hit. ``tokens`` has
    rows (id, field, pos, term).
    """
    alternatives: dict[str, list[int]] = {}
    for i, terms in enumerate(words):
        for t in dict.fromkeys(terms):
            alternatives.setdefault(t, []).append(i)
    wanted = tokens.where(F.col("term").isin(*alternatives))
    slot = F.explode(F.create_map(*(x for t, s in alternatives.items() for x in (F.lit(t), F.array(*map(F.lit, s)))))[F.col("term")])
    votes = wanted.select(id_col, "field", "pos", slot.alias("slot")).select(id_col, "field", (F.col("pos") - F.col("slot")).alias("start"), "slot").where("start >= 0")
    seen = F.bit_or(F.expr("shiftleft(1L, slot)"))
    full = -1 if len(words) == 64 else (1 << len(words)) - 1
    return votes.groupBy(id_col, "field", "start").agg(seen.alias("seen")).where(F.col("seen") == full).select(id_col).distinct()


def boolean_search(query: str, spark: SparkSession, postings: DataFrame, tokens: DataFrame, universe: DataFrame, id_col: str = "doc_id", lemmas: dict[str, list[str]] | None = None) -> DataFrame:
    """Ids of the documents that satisfy ``query``; ``postings`` (term, id) and ``tokens`` are of one term space."""
    tree, operands = parse(query, tokens_of)
    bits: dict[str, int] = {}
    parts = []
    for o in operands:
        alternatives = slots(o.words, lemmas)
        if len(alternatives) == 1:
            for t in alternatives[0]:
                bits[t] = bits.get(t, 0) | 1 << o.bit
        else:
            parts.append(phrase_hits(tokens, alternatives, id_col).select(id_col, F.lit(_signed(o.bit)).cast("long").alias("bit")))
    if bits:
        table = F.create_map(*(x for t, b in bits.items() for x in (F.lit(t), F.lit(b - (1 << 64) if b >> 63 else b).cast("long"))))
        parts.append(postings.where(F.col("term").isin(*bits)).select(id_col, table[F.col("term")].alias("bit")))
    masks = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.bit_or("bit").alias("mask"))
    if true_for_nothing(tree):
        masks = universe.select(id_col).join(masks, id_col, "left").select(id_col, F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))
    return masks.where(mask_of(tree, F.col("mask"))).select(id_col)


def search_by_sets(query: str, spark: SparkSession, postings: DataFrame, tokens: DataFrame, universe: DataFrame, id_col: str = "doc_id", lemmas: dict[str, list[str]] | None = None) -> DataFrame:
    """The same result by set operations: one join per operator."""
    tree, _ = parse(query, tokens_of)
    everything = universe.select(id_col).distinct()

    def ids(node) -> DataFrame:
        if isinstance(node, Term):
            alternatives = slots(node.words, lemmas)
            if len(alternatives) == 1:
                return postings.where(F.col("term").isin(*alternatives[0])).select(id_col).distinct()
            return phrase_hits(tokens, alternatives, id_col)
        if isinstance(node, Not):
            return everything.join(ids(node.part), id_col, "left_anti")
        if isinstance(node, Or):
            return reduce(DataFrame.unionByName, map(ids, node.parts)).distinct()
        positive = [p for p in node.parts if not isinstance(p, Not)]
        out = reduce(lambda a, b: a.join(b, id_col, "left_semi"), map(ids, positive)) if positive else everything
        for p in node.parts:
            if isinstance(p, Not):
                out = out.join(ids(p.part), id_col, "left_anti")
        return out

    return ids(tree)


def first_hits(hits: DataFrame, corpus: DataFrame, limit: int, columns: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """The first ``limit`` hits by id with the total over all, joined with their documents only after the limit."""
    if not 1 <= limit <= MAX_RESULTS:
        raise QueryError(f"the limit is 1 to {MAX_RESULTS}")
    total = hits.agg(F.count("*").alias("total")).scalar()
    top = hits.orderBy(id_col).limit(limit)
    return corpus.select(id_col, *columns).join(F.broadcast(top), id_col).withColumn("total", total)


def result_digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(total, digest)``: the number of hits, and 60 bits that depend on the hits and their order by id.

    Every hit's place is hashed with its id, and the hashes are combined by exclusive or: partial results, one row.
    """
    placed = numbered(hits.select(id_col), [id_col], "k")
    each = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("k") + 1, F.col(id_col))), 1, 15), 16, 10).cast("long")
    return placed.agg(F.count("*").alias("total"), F.bit_xor(each).alias("digest"))


def search_statistics(query: str, postings: DataFrame, universe: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(operand, postings, occurrences)``: what a Boolean query reads for each different word, and a row ``*`` with the
    documents of the universe if the query holds for documents without any operand."""
    tree, operands = parse(query, tokens_of)
    words = list(dict.fromkeys(w for o in operands for w in o.words))
    read = postings.where(F.col("term").isin(*words)).groupBy(F.col("term").alias("operand")).agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))
    if true_for_nothing(tree):
        read = read.unionByName(universe.agg(F.lit("*").alias("operand"), F.count("*").alias("postings"), F.lit(0).cast("long").alias("occurrences")))
    return read


def metadata_filter(corpus: DataFrame, years: list[int] = (), types: list[str] = (), sources: list[str] = (), id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents of the given years, types and sources; an empty choice means any."""
    out = corpus
    for name, chosen in (("year", years), ("type", types), ("source", sources)):
        if chosen:
            out = out.where(F.col(name).isin(*chosen))
    return out.select(id_col)


def ranked_search(query: str, spark: SparkSession, postings: DataFrame, norms: DataFrame, tokens: DataFrame, n_documents: Column | int, limit: int = 20, id_col: str = "doc_id", allowed: DataFrame | None = None, lemmas: dict[str, list[str]] | None = None) -> DataFrame:
    """``(id, score, total)`` of the best ``limit`` documents by TF-IDF cosine.

    Documents weigh 1 + log10(tf) over their full norm; query terms (1 + log10(tf)) log10(N / df). All words of the query
    are a bag; quoted spans must occur as phrases besides. ``postings`` has (term, id, tf), ``norms`` (id, norm).
    """
    if not 1 <= limit <= MAX_RESULTS:
        raise QueryError(f"the limit is 1 to {MAX_RESULTS}")
    split = tokens_of
    pieces = query.split('"')
    if len(pieces) % 2 == 0:
        raise QueryError("a quotation mark is not closed")
    phrases = [p for p in (split(s) for s in pieces[1::2]) if p]
    words = split(query.replace('"', " "))
    bag: dict[str, int] = {}
    for w in words:
        for t in slots([w], lemmas)[0]:
            bag[t] = bag.get(t, 0) + 1
    if len(words) > 64 or len(phrases) > 64 or len(bag) > MAX_TERMS:
        raise QueryError("the query is too long")
    asked = spark.createDataFrame(list(bag.items()), "term string, q int")
    # Read once: frequencies, weights and scores all need them, and they are few against the corpus.
    chosen = table(postings.where(F.col("term").isin(*bag)) if bag else postings.where(F.lit(False)), "query-postings")
    df = chosen.groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(n_documents) if isinstance(n_documents, int) else n_documents
    weights = F.broadcast(asked).join(df, "term").select("term", (log_tf(F.col("q")) * idf(n, F.col("df"))).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(F.lit(1))))  # at most MAX_TERMS rows
    weights = weights.select("term", F.col("w"), length.alias("q_norm")).where("w > 0")
    for p in phrases:
        chosen = chosen.join(phrase_hits(tokens, slots(p, lemmas), id_col), id_col, "left_semi")
    if allowed is not None:
        chosen = chosen.join(allowed, id_col, "left_semi")
    dots = chosen.join(F.broadcast(weights), "term").groupBy(id_col).agg(F.sum(log_tf(F.col("tf")) * F.col("w")).alias("dot"), F.first("q_norm").alias("q_norm"))
    scored = dots.join(norms, id_col).select(id_col, F.round(F.col("dot") / (F.col("q_norm") * F.col("norm")), 9).alias("score")).where("score > 0")
    scored = table(scored, "hits")
    total = scored.agg(F.count("*").alias("total")).scalar()
    return scored.orderBy(F.desc("score"), id_col).limit(limit).withColumn("total", total)


def diagnostic_search(queries: DataFrame, tokens: DataFrame, lemma_tokens: DataFrame, lemmas: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """``(query_id, mode, rank, id, score)`` for a table of queries ``(query_id, term)``, one row per distinct term.

    A document is a hit if it has every distinct term (exact) or a lemma of every term (lemma, hybrid). The score is
    title hits times (n + 1), plus the exactly met terms in hybrid mode, n the number of distinct terms.
    """
    asked = queries.select("query_id", "term").distinct()
    # A query file is small; its terms as literals reach the scans of tables that are sorted by term.
    words = [r.term for r in asked.select("term").distinct().limit(MAX_DIAGNOSTIC + 1).collect()]
    if len(words) > MAX_DIAGNOSTIC:
        raise QueryError(f"a query file has at most {MAX_DIAGNOSTIC} different terms")
    n = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    exact = tokens.where(F.col("term").isin(*words)).join(asked, "term").groupBy("query_id", "term", id_col).agg(F.max((F.col("field") == 0).cast("int")).alias("title"))
    by_lemma = asked.join(lemmas.where(F.col("term").isin(*words)).select("term", F.explode("lemmas").alias("lemma")), "term")
    wanted = [r.lemma for r in by_lemma.select("lemma").distinct().collect()]  # at most 64 for each of the terms
    loose = lemma_tokens.where(F.col("term").isin(*wanted)).withColumnRenamed("term", "lemma").join(by_lemma, "lemma").groupBy("query_id", "term", id_col).agg(F.max((F.col("field") == 0).cast("int")).alias("title"))
    e = exact.groupBy("query_id", id_col).agg(F.count("*").alias("met"), F.sum("title").alias("titles"))
    l = loose.groupBy("query_id", id_col).agg(F.count("*").alias("met"), F.sum("title").alias("titles"))  # noqa: E741
    both = l.join(e.select("query_id", id_col, F.col("met").alias("exactly")), ["query_id", id_col], "left").join(n, "query_id").where("met = n")
    base = F.col("titles") * (F.col("n") + 1)
    modes = e.join(n, "query_id").where("met = n").select("query_id", F.lit("exact").alias("mode"), id_col, base.alias("score"))
    modes = modes.unionByName(both.select("query_id", F.lit("lemma").alias("mode"), id_col, base.alias("score")))
    modes = modes.unionByName(both.select("query_id", F.lit("hybrid").alias("mode"), id_col, (base + F.coalesce("exactly", F.lit(0))).alias("score")))
    rank = F.row_number().over(W.partitionBy("query_id", "mode").orderBy(F.desc("score"), id_col))
    return modes.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "mode", "rank", id_col, "score")
