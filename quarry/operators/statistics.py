"""Corpus statistics and relevance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def token_statistics(tokens: DataFrame, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Tokens, characters, bytes and mean length: in all, by field and by source, in one pass of grouping sets."""
    base = tokens.groupBy("field", source).agg(F.count("*").alias("t"), F.sum(F.length("term")).alias("c"), F.sum(F.octet_length("term")).alias("b"))
    base.createOrReplaceTempView("_token_statistics")
    return tokens.sparkSession.sql(
        f"""select case when grouping(field) = 0 then concat('field:', field) when grouping(`{source}`) = 0 then concat('source:', `{source}`) else 'all' end as scope,
        sum(t) as tokens, sum(c) as characters, sum(b) as token_bytes, round(sum(c) / sum(t), 6) as mean_characters
        from _token_statistics group by grouping sets ((), (field), (`{source}`))"""
    )


def corpus_statistics(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Counts, lengths, unique and repeated texts: over all documents and by source.

    Digests are counted per (source, digest) first, so that a hot source is combined before the shuffle.
    """
    rows = docs.select(F.coalesce(source, F.lit("unknown")).alias("s"), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.select("s", F.length("t").cast("long").alias("chars"), F.regexp_count("t", F.lit("[^ \\t\\n\\r\\f\\x0B]+")).cast("long").alias("words"), F.sha2("t", 256).alias("digest"))
    keyed = rows.select(F.explode(F.array(F.lit("ALL"), F.col("s"))).alias("scope"), "chars", "words", "digest")
    sums = keyed.groupBy("scope").agg(
        F.count("*").alias("documents"), F.sum("chars").alias("characters"), F.sum("words").alias("words"), F.round(F.avg("words"), 6).alias("mean_words"),
        F.median("words").alias("median_words"), F.min("words").alias("min_words"), F.max("words").alias("max_words"), F.count_if(F.col("words") == 0).alias("empty"),
    )
    unique = keyed.groupBy("scope", "digest").agg(F.lit(1).alias("one")).groupBy("scope").agg(F.count("*").alias("unique_texts"))
    return sums.join(unique, "scope").withColumn("repeated_texts", F.col("documents") - F.col("unique_texts"))


def catalog_counts(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``(facet, value, documents)``: how often each value of each column occurs."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return docs.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("documents"))


def relevance(rankings: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """Precision, recall and nDCG at ``k`` per query: ``rankings(query_id, rank, doc_id)``, ``judgments(query_id, doc_id, grade)``.

    Unjudged documents have grade 0; precision divides by k; gain is 2^grade - 1 over log2(rank + 1).
    """
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + F.lit(1.0))
    judged = rankings.where(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    got = judged.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("found"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    best = judgments.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = best.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r")))).alias("ideal"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return ideal.join(got, "query_id", "left").select(
        "query_id", (F.coalesce("found", F.lit(0)) / F.lit(float(k))).alias("precision"), share(F.coalesce("found", F.lit(0)).cast("double"), F.col("relevant")).alias("recall"),
        share(F.coalesce("dcg", F.lit(0.0)), F.col("ideal")).alias("ndcg"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "ndcg")), F.count("*").alias("queries"))


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Vocabulary reduction in percent, by group: both sides have (group, tokens, vocabulary)."""
    a, b = before.select("group", F.col("vocabulary").alias("surface")), after.select("group", F.col("vocabulary").alias("lemma"))
    return a.join(b, "group").withColumn("reduction", F.round(100.0 * (F.col("surface") - F.col("lemma")) / F.col("surface"), 6))


def median_of_repeats(timings: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    """``(keys, runs, median_seconds)`` of repeated timings, exact."""
    return timings.groupBy(*keys).agg(F.count("*").alias("runs"), F.median(seconds).alias("median_seconds"))


def frequency_report(statistics: DataFrame, top: DataFrame) -> DataFrame:
    """``(place, line)`` of a Markdown report: a table of groups, then each group's most frequent terms in order.

    ``statistics(group, tokens, vocabulary, hapax)`` and ``top(group, rank, term)``, as of a frequency count; both are
    small, one row for each group or for its first ranks.
    """
    escaped = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    head = statistics.select(F.lit("group | tokens | vocabulary | hapax").alias("line")).distinct().withColumn("place", F.array(F.lit("0")))
    rule = head.select(F.lit("--- | ---: | ---: | ---:").alias("line"), F.array(F.lit("1")).alias("place"))
    rows = statistics.select(F.concat_ws(" | ", escaped(F.col("group")), "tokens", "vocabulary", "hapax").alias("line"), F.array(F.lit("2"), "group").alias("place"))
    words = top.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("w"))
    lists = words.select(F.concat(F.lit("**"), "group", F.lit("**: "), "w").alias("line"), F.array(F.lit("3"), "group").alias("place"))
    every = head.select("place", "line").unionByName(rule).unionByName(rows).unionByName(lists)
    return every.select(F.array_join("place", ":").alias("place"), F.concat(F.when(F.get("place", F.lit(0)) < "3", "| ").otherwise(""), "line", F.when(F.get("place", F.lit(0)) < "3", " |").otherwise("")).alias("line"))


def context(tokens: DataFrame, hit: Column, width: int, id_col: str = "doc_id") -> DataFrame:
    """The tokens within ``width`` positions of every token for which ``hit`` holds, hits marked."""
    by = W.partitionBy(id_col, "field").orderBy("pos")
    near = F.max(F.when(hit, 1)).over(by.rangeBetween(-width, width))
    return tokens.withColumn("near", near).where("near = 1").select(id_col, "field", "pos", "term", F.coalesce(hit, F.lit(False)).alias("is_hit"))


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
