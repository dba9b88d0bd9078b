"""Secret scans: base patterns, then ownership frequency over the whole corpus.

Base spans are the matches of three patterns (see ``KINDS``). Candidates are their secret values (for an assignment,
the value alone) and, beside them, long tokens that mix letters and digits. Every candidate's hash is counted over the
corpus by distinct repositories and distinct owners. A value that several owners or many repositories hold has been
copied from somewhere, an example or a fixture (``copied``); one that stays with its owner and looks random is taken
for live (``live``). These spans are added to the base ones, which always stay.

Everything runs on built-in functions. Ownership is counted by two-level aggregation (distinct triples are combined
before the shuffle), so a value that a third of all rows hold is no hot spot; the classes go back to the rows by an
equi-join on the hash, which adaptive execution splits where it is skewed.

Defined results: a null text counts as empty; a null owner or repository is one owner or repository of its own; null
ids are scanned like others; repeated rows give repeated rows and count once; an empty table gives an empty result;
columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .spans import keep, rendered, tagged, with_spans

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: Tokens of 20 characters and more, at most one per run.
LOOSE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ["assign", "access", "hex", "live", "copied"]
#: A value is copied from this many distinct owners or repositories on.
OWNERS, REPOSITORIES = 3, 8
#: Different characters that a live-looking value has at least.
VARIETY = 8


def _value(assignment: Column) -> Column:
    return F.regexp_extract(assignment, "^" + ASSIGN, 2)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Base spans and candidates of every row: ``(id, version, owner, repository, assign, access, hex, found)``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    version = F.xxhash64(text)
    df = docs.select(
        F.col(id_col), version.alias("version"), (F.lit(None).cast("string") if owner is None else owner.cast("string")).alias("owner"),
        (version.cast("string") if repository is None else repository.cast("string")).alias("repository"), text.alias("t"),
    )
    low = F.lower(F.col("t"))
    keyword = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    df = with_spans(df, "assign", "t", ASSIGN, keyword)
    df = with_spans(df, "access", "t", ACCESS, F.col("t").contains("AKIA"))
    df = with_spans(df, "hex", "t", HEX, F.col("t").rlike("[0-9a-f]{32}"))
    df = with_spans(df, "loose", "t", LOOSE, F.col("t").rlike("[A-Za-z0-9+/_=-]{20}"))
    df = df.withColumn("assign", keep("assign", lambda v: F.length(_value(v)) >= 8))
    mixed = keep("loose", lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    values = F.concat(
        F.transform(F.col("assign"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _value(s["value"]).alias("value"))),
        F.col("access"), F.col("hex"), mixed,
    )
    lively = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= VARIETY
    found = F.transform(values, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("hash"), lively(s["value"]).alias("lively")))
    return df.select(id_col, "version", "owner", "repository", *(F.transform(F.col(k), lambda s: F.struct(s["start"], s["end"])).alias(k) for k in KINDS[:3]), found.alias("found"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, repositories, owners)`` over ``candidates(hash, repository, owner)``: distinct holders of each value."""
    triples = candidates.groupBy("hash", "repository", "owner").agg(F.lit(1).alias("one"))
    repositories = triples.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    owners = triples.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("owners"))
    return repositories.join(owners, "hash")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """``(id, assign, access, hex, live, copied)`` for every row: arrays of spans ``(start, end)``, in order.

    ``owner`` and ``repository`` are columns of ``docs``; without a repository each different text is one.
    """
    rows = table(scan(docs, id_col, text_col, owner, repository), "secret-rows")
    each = rows.where(F.size("found") > 0).select(id_col, "version", "owner", "repository", F.explode("found").alias("f"))
    each = each.select(id_col, "version", "owner", "repository", F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.hash").alias("hash"), F.col("f.lively").alias("lively"))
    held = ownership(each)
    copied = (F.col("owners") >= owners) | (F.col("repositories") >= repositories)
    named = each.join(held, "hash").select(id_col, "version", F.struct("start", "end").alias("s"), copied.alias("copied"), "lively").where("copied or lively")
    per_row = named.groupBy(id_col, "version").agg(
        F.array_sort(F.collect_set(F.when(~F.col("copied"), F.col("s")))).alias("live"), F.array_sort(F.collect_set(F.when(F.col("copied"), F.col("s")))).alias("copied")
    ).select(F.col(id_col).alias("_id"), F.col("version").alias("_v"), "live", "copied")
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = rows.join(per_row, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_v")), "left")
    return joined.select(id_col, "assign", "access", "hex", F.coalesce("live", none).alias("live"), F.coalesce("copied", none).alias("copied"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    base = F.array_sort(F.concat(*(tagged(k, i) for i, k in enumerate(KINDS[:3]))))
    every = F.array_sort(F.concat(*(tagged(k, i) for i, k in enumerate(KINDS))))
    return found.select(
        id_col, *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(rendered(base, KINDS), 256).alias("base_sha256"), rendered(every, KINDS).alias("spans"),
    )
