"""Personal data: base patterns, then information-theoretic sanitisation of what stands around them.

Base spans are e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers. Each different value is a
protected entity. Any term (word, number or identifier) of a text that holds an entity may give it away, wherever it
stands in it: over the whole corpus, with documents as events, the pointwise mutual information PMI(entity; term) is set against the
entity's own information IC(entity) = -log p(entity). A term whose PMI reaches ``REMOVE`` of the IC says nearly as
much as the entity itself and is removed; from ``GENERALISE`` on it is generalised (its initial stays). Every pair is
judged, those of a single text too; as pairs of few texts in small corpora may be chance, the share is tempered by
1 - N ** (-``EVIDENCE`` * texts), N being the number of documents.

Everything runs on built-in functions. Documents without personal data cost one scan; term frequencies are counted
over all documents but only for terms that stand in a text with an entity, with partial counts before the shuffle. The terms are
broadcast only while they are at most ``BROADCAST_TERMS``, else joined by shuffle.

Defined results: a null text counts as empty (and stays null when sanitised); null ids are handled like others;
repeated rows give repeated rows; an empty table gives an empty result; columns other than id and text are ignored by
``find`` and kept by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .spans import disjoint, keep, rendered, replaced, tagged, with_spans

_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?=[{_LOCAL}])(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "remove", "generalise"]
BASE = KINDS[:4]
#: Words of letters and digits, whole when joined by a mark (hyphenated names, identifiers).
TERM = r"[\p{L}\p{N}\p{M}]++(?:[._'\u2019-][\p{L}\p{N}\p{M}]++)*+"
REMOVE, GENERALISE = 0.9, 0.75
#: Exponent of the tempering; the larger, the sooner a single text is believed.
EVIDENCE = 0.25
BROADCAST_TERMS, BROADCAST_KEYS = 200_000, 1_000_000
#: Characters of texts whose terms one task locates.
SHARE = 4 << 20
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(digits, i, F.lit(1)).cast("int") * 2) - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one array of spans (start, end, value) per base kind."""
    t = F.col(text)
    df = with_spans(df, "email", text, EMAIL, t.contains("@"))
    df = with_spans(df, "ip", text, IP, t.rlike(r"[0-9]\.[0-9]"))
    df = with_spans(df, "card", text, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"))
    df = with_spans(df, "phone", text, PHONE, t.contains("+"))
    df = df.withColumn("ip", keep("ip", lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")))
    card = lambda v: F.when(F.length(_digits(v)).between(16, 19), _luhn(_digits(v))).otherwise(False)
    df = df.withColumn("card", keep("card", card))
    return df.withColumn("phone", keep("phone", lambda v: F.length(_digits(v)).between(8, 15)))


def _blanked(text: Column) -> Column:
    """``text`` with every base span blanked; positions stay."""
    spans = F.array_sort(F.concat(*(F.transform(F.col(k), lambda s: F.struct(s["start"], s["end"])) for k in BASE)))
    return replaced(text, disjoint(spans), lambda s, part: F.repeat(F.lit(" "), s["end"] - s["start"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, version, email, ip, card, phone, entities, rest)``: spans without values, the hashes of the entities and
    the text without them; ``rest`` is null where there is no entity."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = base_spans(docs.select(F.col(id_col), F.xxhash64(text).alias("version"), text.alias("t")), "t")

    def hashes(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.xxhash64(F.lit(kind), F.lower(s["value"]) if kind in ("email", "ip") else _digits(s["value"])))

    entities = F.array_distinct(F.concat(*(hashes(k) for k in BASE)))
    rest = F.when(F.greatest(*(F.size(k) for k in BASE)) > 0, _blanked(F.col("t")))
    return df.select(id_col, "version", *(F.transform(F.col(k), lambda s: F.struct(s["start"], s["end"])).alias(k) for k in BASE), entities.alias("entities"), rest.alias("rest"))


def _words(text: Column) -> Column:
    """The different terms of a text; null for none, as an inner explosion would search the text twice, once to filter."""
    return F.explode_outer(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))).alias("term")


def disclosures(docs: DataFrame, rows: DataFrame, texts: DataFrame, text_col: str, generalise: float = GENERALISE) -> DataFrame:
    """``(version, term, share)``: the terms of each text whose tempered PMI with one of its entities is at least
    ``generalise`` of the entity's information, with their greatest share.

    Entities that stand in the same texts have the same shares and are judged once, as a class.
    """
    n = float(max(rows.count(), 2))
    held = texts.select("version", "copies", F.explode("entities").alias("entity"))
    stats = held.groupBy("entity").agg(F.bit_xor("version").alias("a"), F.bit_xor(F.xxhash64("version")).alias("b"), F.sum("copies").alias("n_c"))
    members = held.join(stats, "entity").select("version", "a", "b", "n_c").distinct().where(F.col("n_c") < n)
    words = table(texts.select("version", "copies", _words(F.col("rest"))).where("term is not null"), "pii-words")
    terms = table(words.select("term").distinct(), "terms")
    every = docs.select(_words(F.col(text_col))).where("term is not null")
    if terms.count() <= BROADCAST_TERMS:
        n_t = every.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        n_t = every.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")
    # No pair of a term beyond this can reach the share, so that only rare terms meet the entities of their texts.
    limit = lambda n_c: n * F.pow(n_c / n, F.lit(generalise)) * 1.000001
    most = members.groupBy("version").agg(F.max("n_c").alias("most"))
    rare = words.join(n_t, "term", "left").join(most, "version").where(F.coalesce("n_t", F.lit(0)) <= limit(F.col("most"))).drop("most")
    pairs = table(rare.join(members, "version").where(F.coalesce("n_t", F.lit(0)) <= limit(F.col("n_c"))), "pairs")
    judged = pairs.groupBy("a", "b", "n_c", "term").agg(F.sum("copies").alias("n_ct"), F.count("*").alias("texts"), F.max("n_t").alias("n_t"))
    pmi = F.log(F.col("n_ct") * n / (F.col("n_c") * F.greatest("n_t", "n_ct")))
    trust = 1 - F.pow(F.lit(n), -EVIDENCE * F.col("texts"))
    risky = judged.select("a", "b", "n_c", "term", (pmi / F.log(n / F.col("n_c")) * trust).alias("share")).where(F.col("share") >= generalise)
    return pairs.select("version", "a", "b", "n_c", "term").join(risky, ["a", "b", "n_c", "term"]).groupBy("version", "term").agg(F.max("share").alias("share"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """``(id, version, email, ip, card, phone, remove, generalise)`` for every row: arrays of spans (start, end)."""
    rows = table(scan(docs, id_col, text_col), "pii-rows")
    some = rows.where(F.col("rest").isNotNull())
    # One row per different text; its copies are the ids that hold it, repeated rows of an id being one document.
    copies = some.select("version", id_col).distinct().groupBy("version").agg(F.count("*").alias("copies"))
    texts = table(some.select("version", "entities", "rest").dropDuplicates(["version"]).join(copies, "version"), "pii-texts")
    risky = table(disclosures(docs, rows, texts, text_col, generalise), "pii-risky")
    dirty = texts.join(risky.select("version").distinct(), "version", "left_semi").select("version", "rest")
    # Finding positions costs far more than reading: shares of bounded length, however few bytes they are.
    letters = texts.agg(F.sum(F.length("rest"))).first()[0] or 0
    dirty = dirty.repartition(max(1, -(-letters // SHARE)))
    # Outer, as the filter of an inner explosion would be pushed into the columns before and evaluate them at each other's elements.
    found = with_spans(dirty, "terms", "rest", TERM).select("version", F.explode_outer("terms").alias("x")).where("x is not null")
    hits = found.select("version", F.lower("x.value").alias("term"), F.struct("x.start", "x.end").alias("s")).join(risky, ["version", "term"])
    per_text = hits.groupBy("version").agg(
        F.array_sort(F.collect_list(F.when(F.col("share") >= remove, F.col("s")))).alias("remove"), F.array_sort(F.collect_list(F.when(F.col("share") < remove, F.col("s")))).alias("generalise")
    ).select(F.col("version").alias("__q_v"), "remove", "generalise")
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = rows.join(per_text, F.col("version") == F.col("__q_v"), "left")
    return joined.select(id_col, "version", *BASE, F.coalesce("remove", none).alias("remove"), F.coalesce("generalise", none).alias("generalise"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    base = F.array_sort(F.concat(*(tagged(k, i, "kind") for i, k in enumerate(BASE))))
    every = F.array_sort(F.concat(*(tagged(k, i, "kind") for i, k in enumerate(KINDS))))
    return found.select(
        id_col, *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(rendered(base, KINDS, "kind"), 256).alias("base_sha256"), rendered(every, KINDS, "kind").alias("spans"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every base span replaced by ``[KIND]``, removed terms by ``[TERM]``, generalised ones by their initial.

    Overlapping spans become one, named after its first (of two that begin together, the longer). Texts without spans
    stay where they are as long as the keys of the others can be broadcast; else all rows are joined by shuffle.
    """
    found = find(docs, id_col, text_col)

    def ordered(name: str, kind: int) -> Column:
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), F.lit(kind).alias("kind")))

    spans = F.array_sort(F.concat(*(ordered(k, i) for i, k in enumerate(KINDS))))
    spans = disjoint(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["less"]).alias("end"), s["kind"].alias("kind"))))
    key = [F.col(id_col).alias("__q_id"), F.col("version").alias("__q_v")]
    dirty = table(found.select(*key, spans.alias("__q_spans"), F.greatest(*(F.size(k) for k in KINDS)).alias("__q_n")).where("__q_n > 0").groupBy("__q_id", "__q_v").agg(F.first("__q_spans").alias("__q_spans")), "pii-spans")
    text = F.col(text_col)
    df = docs.withColumn("__q_version", F.xxhash64(F.coalesce(text, F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col("__q_id")) & (F.col("__q_version") == F.col("__q_v"))
    clean_rows = None
    if dirty.count() <= BROADCAST_KEYS:
        keys = F.broadcast(dirty.select("__q_id", "__q_v"))
        clean_rows, df = df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")
    df = df.join(dirty, same, "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in BASE), F.lit("[TERM]"), F.lit(""))
    shorter = lambda s, part: F.concat(F.get(names, s["kind"]), F.when(s["kind"] == 5, F.concat(part(s["start"], s["start"] + 1), F.lit("."))).otherwise(""))
    clean = replaced(text, F.col("__q_spans"), shorter)
    done = df.withColumn(text_col, F.when(F.col("__q_spans").isNull(), text).otherwise(clean)).select(*docs.columns)
    return done if clean_rows is None else done.unionByName(clean_rows.select(*docs.columns))
