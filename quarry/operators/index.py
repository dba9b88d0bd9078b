"""Term tables: postings, document norms, lemmas, frequencies and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import log_tf, tokens, variable_byte_length
from ..sources.shared import numbered, table

#: Detachment rules of WordNet's morphology: (part of speech, suffix, ending), in order.
SUFFIXES = (
    ("n", "s", ""), ("n", "ses", "s"), ("n", "xes", "x"), ("n", "zes", "z"), ("n", "ches", "ch"), ("n", "shes", "sh"), ("n", "men", "man"), ("n", "ies", "y"),
    ("v", "s", ""), ("v", "ies", "y"), ("v", "es", "e"), ("v", "es", ""), ("v", "ed", "e"), ("v", "ed", ""), ("v", "ing", "e"), ("v", "ing", ""),
    ("a", "er", ""), ("a", "est", ""), ("a", "er", "e"), ("a", "est", "e"),
)
_POS = "nvar"


def postings(tokens_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(term, id, tf)``, both fields together."""
    return tokens_.groupBy("term", id_col).agg(F.count("*").alias("tf"))


def vocabulary(postings_: DataFrame) -> DataFrame:
    """``(term, df, cf)``: documents and occurrences of each term."""
    return postings_.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def norms(postings_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, norm)``: Euclidean length of the logarithmic term weights over the whole vocabulary."""
    w = log_tf(F.col("tf"))
    return postings_.groupBy(id_col).agg(F.sqrt(F.sum(w * w)).alias("norm"))


def write_tokens(tokens_: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """``(id, field, pos, term)`` as Parquet, each partition's files sorted by term.

    Partitions are left as they are: of tokens that come by document, each holds whole documents of a bounded size, so
    that nothing is shuffled, no task grows with the table, and every word is spread over all files, where it is found
    by the statistics of the pages.
    """
    tokens_.select(id_col, "field", "pos", "term").sortWithinPartitions("term", id_col, "field", "pos").write.mode("errorifexists").parquet(path)


def write_postings(postings_: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """``(term, id, tf)`` in the same way."""
    postings_.select("term", id_col, "tf").sortWithinPartitions("term", id_col).write.mode("errorifexists").parquet(path)


def write_norms(postings_: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """``(id, norm)`` of stored postings: as a file holds few documents, most is summed before the shuffle."""
    norms(postings_, id_col).write.mode("errorifexists").parquet(path)


def write_index(corpus: DataFrame, path: str, id_col: str = "doc_id", buckets: int | None = None) -> None:
    """Tokens, postings and norms of a corpus's words. Fails if a folder exists."""
    found = tokens(corpus.repartition(buckets, id_col) if buckets else corpus, id_col)
    write_tokens(found, f"{path}/tokens", id_col)
    write_postings(postings(found, id_col), f"{path}/postings", id_col)
    write_norms(corpus.sparkSession.read.parquet(f"{path}/postings"), f"{path}/norms", id_col)


def dictionary(pairs: DataFrame) -> DataFrame:
    """``(key, lemmas)`` from pairs (key, lemma): distinct, sorted, 1 to 64 each."""
    grouped = pairs.groupBy("key").agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))
    return grouped.withColumn("lemmas", F.when(F.size("lemmas") <= 64, F.col("lemmas")).otherwise(F.raise_error(F.concat(F.lit("more than 64 lemmas: "), F.col("key")))))


def lemmatize(terms: DataFrame, dictionary_: DataFrame) -> DataFrame:
    """``(term, lemmas, known)`` for distinct ``terms(term)``.

    Russian words are looked up as they are (``ru:``). English words are tried as noun, verb, adjective and adverb: the
    word itself, then either its exceptions (``x:<pos>:``), which replace the rules of that part of speech, or the
    suffix rules. Words that give nothing stay as they are and are unknown. One explode into candidate keys, one join
    with the dictionary, one aggregation.
    """
    word = F.col("term")
    candidates = [F.struct(F.lit(0).alias("p"), F.lit(0).alias("r"), F.concat(F.lit("ru:"), word).alias("key"), F.lit(False).alias("rule"), F.lit(False).alias("exc"))]
    english = []
    for i, pos in enumerate(_POS):
        english.append(F.struct(F.lit(i).alias("p"), F.lit(0).alias("r"), F.concat(F.lit(f"{pos}:"), word).alias("key"), F.lit(False).alias("rule"), F.lit(False).alias("exc")))
        english.append(F.struct(F.lit(i).alias("p"), F.lit(1).alias("r"), F.concat(F.lit(f"x:{pos}:"), word).alias("key"), F.lit(False).alias("rule"), F.lit(True).alias("exc")))
    for r, (pos, suffix, ending) in enumerate(SUFFIXES):
        stem = F.concat(F.lit(f"{pos}:"), F.expr(f"substring(term, 1, length(term) - {len(suffix)})"), F.lit(ending))
        fits = word.endswith(suffix) & (F.length(word) > len(suffix))
        english.append(F.when(fits, F.struct(F.lit(_POS.index(pos)).alias("p"), F.lit(r + 2).alias("r"), stem.alias("key"), F.lit(True).alias("rule"), F.lit(False).alias("exc"))))
    keys = F.when(word.rlike("^[а-яё]+$"), F.array(*candidates)).when(word.rlike("^[a-z]+$"), F.filter(F.array(*english), lambda c: c.isNotNull()))
    each = terms.select("term", F.explode_outer(keys).alias("c")).select("term", "c.*")
    hits = each.join(F.broadcast(dictionary_) if _bounded(dictionary_) else dictionary_, "key", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("lemmas").isNotNull(), F.struct("p", "r", "rule", "exc", "lemmas"))))
    grouped = hits.groupBy("term").agg(found.alias("f"))
    excepted = F.transform(F.filter("f", lambda x: x["exc"]), lambda x: x["p"])
    # A rule counts only for parts of speech without an exception.
    kept = F.filter(F.zip_with("f", F.array_repeat(excepted, F.size("f")), lambda x, e: F.struct(x.alias("x"), e.alias("e"))), lambda y: ~(y["x"]["rule"] & F.array_contains(y["e"], y["x"]["p"])))
    lemmas = F.array_distinct(F.flatten(F.transform(kept, lambda y: y["x"]["lemmas"])))
    return grouped.select("term", lemmas.alias("l")).select("term", F.when(F.size("l") > 0, F.col("l")).otherwise(F.array("term")).alias("lemmas"), (F.size("l") > 0).alias("known"))


def _bounded(dictionary_: DataFrame, rows: int = 2_000_000) -> bool:
    return dictionary_.limit(rows + 1).count() <= rows


def inflections(dictionary_: DataFrame) -> DataFrame:
    """``(term)``: all words that may have a lemma, the rules of ``lemmatize`` read backwards from the dictionary's keys.

    Some have none; no word outside has any. Their number goes with the dictionary, not with the corpus.
    """
    key = F.col("key")
    words = [F.when(key.startswith(p), F.expr(f"substring(key, {len(p) + 1})")) for p in ("ru:", *(f"{pos}:" for pos in _POS), *(f"x:{pos}:" for pos in _POS))]
    for pos, suffix, ending in SUFFIXES:
        stem = F.expr(f"substring(key, 3, length(key) - {2 + len(ending)})")
        words.append(F.when(key.startswith(f"{pos}:") & key.endswith(ending), F.concat(stem, F.lit(suffix))))
    return dictionary_.select(F.explode(F.array(*words)).alias("term")).where("term is not null").distinct()


def lemma_map(dictionary_: DataFrame) -> DataFrame:
    """``(term, lemmas)`` of all words that the dictionary knows, in whatever corpus."""
    return table(lemmatize(inflections(dictionary_), dictionary_).where("known").select("term", "lemmas"), "lemma-map")


def _with_lemmas(rows: DataFrame, known: DataFrame) -> DataFrame:
    found = known.select("term", F.col("lemmas").alias("_lemmas"))
    return rows.join(F.broadcast(found) if _bounded(found) else found, "term", "left")


def lemmas_of(terms: DataFrame, known: DataFrame) -> DataFrame:
    """``terms`` with ``(lemmas, known)`` by ``lemma_map``; the same as ``lemmatize``, without a candidate key of any word."""
    return _with_lemmas(terms, known).select(*terms.columns, F.coalesce("_lemmas", F.array("term")).alias("lemmas"), F.col("_lemmas").isNotNull().alias("known"))


#: Words that are listed in the filter of a scan.
LISTED = 4096


def in_lemma_space(rows: DataFrame, known: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Rows with ``term`` once for each lemma of it, by ``lemma_map``.

    ``only`` keeps the rows of these lemmas; the words that have them reach the scan.
    """
    if only is not None:
        having = known.where(F.arrays_overlap("lemmas", F.array(*map(F.lit, only)))) if only else known.where(F.lit(False))
        words = [r.term for r in having.select("term").limit(LISTED + 1).collect()]
        if len(words) <= LISTED:
            rows = rows.where(F.col("term").isin(*only, *words))
    each = _with_lemmas(rows, known).select(*(c for c in rows.columns if c != "term"), F.explode(F.coalesce("_lemmas", F.array("term"))).alias("term"))
    return each if only is None else each.where(F.col("term").isin(*only))


def lemma_tokens(tokens_: DataFrame, lemmas: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Tokens of the lemma space: one row per distinct (id, field, pos, lemma)."""
    return tokens_.join(lemmas.select("term", F.explode("lemmas").alias("lemma")), "term").select(id_col, "field", "pos", F.col("lemma").alias("term")).distinct()


def group_frequencies(tokens_: DataFrame, groups: dict[str, str]) -> DataFrame:
    """``(group, term, frequency)``: term counts over all tokens and within each column of ``groups`` (name -> column).

    One pass with grouping sets; the group is ``all`` or ``name:value``.
    """
    base = tokens_.groupBy("term", *groups.values()).agg(F.count("*").alias("c"))
    names = list(groups.values())
    sets = ", ".join(["(term)", *(f"(term, `{c}`)" for c in names)])
    base.createOrReplaceTempView("_group_frequencies")
    label = " ".join(f"when grouping(`{c}`) = 0 then concat('{n}:', coalesce(`{c}`, 'unknown'))" for n, c in groups.items())
    return base.sparkSession.sql(f"select case {label} else 'all' end as `group`, term, sum(c) as frequency from _group_frequencies group by grouping sets ({sets})")


def ranked(frequencies: DataFrame) -> DataFrame:
    """Rank (most frequent first, ties by term) and relative frequency within each group.

    Ranks come from places in the order of all groups, so that the vocabulary of one group is spread over tasks too.
    """
    placed = numbered(frequencies.select("group", "term", "frequency"), ["group", F.desc("frequency"), "term"], "_n")
    groups = placed.groupBy("group").agg(F.min("_n").alias("_from"), F.sum("frequency").alias("_sum")).withColumnRenamed("group", "_g")
    joined = placed.join(groups, F.col("group").eqNullSafe(F.col("_g")))
    return joined.select("group", (F.col("_n") - F.col("_from") + 1).alias("rank"), "term", "frequency", (F.col("frequency") / F.col("_sum")).alias("relative_frequency"))


def zipf_statistics(ranked_: DataFrame, fit_min: int = 10, fit_max: int = 10_000) -> DataFrame:
    """Per group: tokens, vocabulary, hapax, top frequency, harmonic constant and the power-law fit on logarithms.

    alpha and power_c are null without two points of different rank; r2 is null without variance of the frequencies.
    """
    inside = F.col("rank").between(fit_min, fit_max)
    x, y = F.when(inside, F.log("rank")), F.when(inside, F.log(F.col("frequency").cast("double")))
    sums = ranked_.groupBy("group").agg(
        F.sum("frequency").alias("tokens"), F.count("*").alias("vocabulary"), F.count_if(F.col("frequency") == 1).alias("hapax"), F.max("frequency").alias("top_frequency"),
        F.sum(1.0 / F.col("rank")).alias("harmonic"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("raw_r2"),
        F.count(x).alias("points"), F.var_pop(y).alias("spread"),
    )
    enough = F.col("points") >= 2
    return sums.select(
        "group", "tokens", "vocabulary", "hapax", "top_frequency", (F.col("tokens") / F.col("harmonic")).alias("zipf_c"), F.when(enough, -F.col("slope")).alias("alpha"),
        F.when(enough, F.exp("intercept")).alias("power_c"), F.when(enough & (F.col("spread") > 1e-15), F.col("raw_r2")).alias("r2"),
    )


def curve_ranks(last: int) -> list[int]:
    """The ranks drawn in a frequency plot: the first 50, then geometric steps, and the last."""
    out, x = list(range(1, min(50, last) + 1)), 50.0
    while x < last:
        x = max(x * 1.025, out[-1] + 1)
        if int(x) <= last:
            out.append(int(x))
    return sorted({*out, last}) if last > 0 else []


def sampled_curve(ranked_: DataFrame) -> DataFrame:
    """The rows of ``ranked`` at each group's curve ranks."""
    last = ranked_.groupBy(F.col("group").alias("_g")).agg(F.max("rank").alias("_last"))
    ranks = curve_ranks(1 << 31)
    return ranked_.join(last, F.col("group").eqNullSafe(F.col("_g"))).where(F.col("rank").isin(*ranks) | (F.col("rank") == F.col("_last"))).drop("_g", "_last")


#: Document ids that share a chunk of a posting list.
CHUNK = 1 << 16


def codec_sizes(postings_: DataFrame, id_col: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Per term: postings, bytes as 8-byte ids, bytes as variable-byte gaps, and skip pointers (every root of n from 256 on).

    Gaps are taken within chunks of ids; then one row for each chunk gives the gap at its start, so that a frequent
    term's list is never in one task.
    """
    part = F.floor(F.col(id_col) / chunk)
    inside = F.col(id_col) - F.lag(id_col).over(W.partitionBy("term", "part").orderBy(id_col))
    rows = postings_.select("term", id_col, part.alias("part"))
    chunks = rows.withColumn("bytes", variable_byte_length(inside)).groupBy("term", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min(id_col).alias("a"), F.max(id_col).alias("b"))
    start = F.col("a") - F.coalesce(F.lag("b").over(W.partitionBy("term").orderBy("part")), F.lit(0))
    sizes = chunks.withColumn("start", variable_byte_length(start)).groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.coalesce("bytes", F.lit(0)) + F.col("start")).alias("gap_bytes"))
    step = F.ceil(F.sqrt("df")).cast("long")
    skips = F.when(F.col("df") >= 256, F.ceil(F.col("df") / step) - 1).otherwise(0).cast("long")
    return sizes.select("term", "df", (F.col("df") * 8).alias("raw_bytes"), "gap_bytes", skips.alias("skips"))


def front_coding(vocabulary_: DataFrame, block: int = 16) -> DataFrame:
    """``(term, block, shared, suffix)``: terms in byte order, in blocks whose first term is whole."""
    rows = numbered(vocabulary_.select("term"), ["term"], "i").withColumn("block", F.floor(F.col("i") / block))
    before = F.lag("term").over(W.partitionBy("block").orderBy("i"))
    letters = lambda c: F.split(c, "")
    rows = rows.withColumn("before", before).withColumn("same", F.zip_with(letters(F.col("term")), letters(F.col("before")), lambda a, b: a.eqNullSafe(b)))
    shared = F.when(F.col("before").isNull(), 0).otherwise(F.array_position("same", False) - 1).cast("int")
    return rows.select("term", "block", shared.alias("shared")).withColumn("suffix", F.expr("substring(term, shared + 1)"))


def verify(postings_: DataFrame, vocabulary_: DataFrame, documents: DataFrame, norms_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(check, violations)``: uniqueness, referential integrity, document frequencies, finite positive norms."""
    counted = postings_.groupBy("term").agg(F.count("*").alias("n"))
    # A row for each document instead of its postings meets documents and norms.
    held = postings_.groupBy(id_col).agg(F.count("*").alias("n"))
    count = F.count("*")
    checks = {
        # By id first: counts of pairs that hardly repeat would only fill the memory of a task before the shuffle.
        "duplicate postings": (postings_.repartition(id_col).groupBy("term", id_col).count().where("count > 1"), count),
        "unknown documents": (held.join(documents, id_col, "left_anti"), F.coalesce(F.sum("n"), F.lit(0))),
        "postings without frequency": (postings_.where("tf is null or tf < 1"), count),
        "wrong document frequency": (vocabulary_.join(counted, "term", "full").where("df is distinct from n"), count),
        "norms missing": (held.join(norms_, id_col, "left_anti"), count),
        "norms not positive": (norms_.where("norm is null or norm <= 0 or isnan(norm)"), count),
    }
    out = None
    for name, (bad, violations) in checks.items():
        one = bad.agg(F.lit(name).alias("check"), violations.alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out
