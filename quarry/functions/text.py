"""Tokenization and text scalars as native column expressions.

A token is a dotted acronym of single letters, ``c#`` or ``c++`` (with a standard's number), a dotted number, or a run
of word characters; connectors (hyphens, apostrophes) join it to further word characters, combining marks continue it.
Word characters are ASCII letters and digits, Cyrillic А to я with Ё and ё, and Latin letters from U+00C0 to U+017F
without the multiplication and division signs. All repetitions are possessive where that changes nothing, so that no
text, however long its chains of dots or hyphens, exhausts the regular-expression engine's stack.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OTHER = "А-яЁёÀ-ÖØ-öø-ſ"
_LETTER = "A-Za-z" + _OTHER
_WORD = "0-9" + _LETTER
_MARK = "\u0300-\u036f"
_JOIN = "\\-\u2010\u2011'\u2019\u02bc"


def _pattern(letter: str, word: str, run: str, no_c: str) -> str:
    """The token pattern over four classes: letters, word characters, these with marks, and these with + and # besides."""
    tail = f"(?:[{_JOIN}]{word}{run}*+)*+"
    return (
        rf"(?={word})(?:(?<!\.){letter}(?:\.{letter}){{2,}}+(?!{run})\.?"
        rf"|[cC](?:#|\+\+)[0-9]*+(?!{no_c}){tail}"
        rf"|(?:[vV]?[0-9]+(?:\.[0-9]+)++|{word}){run}*+{tail})"
    )


TOKEN = _pattern(f"[{_LETTER}]", f"[{_WORD}]", f"[{_WORD}{_MARK}]", f"[{_WORD}{_MARK}+#]")
#: The same for Java, where a union of ranges is tried one by one: ASCII by its own class first.
TOKEN_JAVA = _pattern(*(rf"[\p{{{c}}}[{_OTHER}{more}]]" for c, more in (("Alpha", ""), ("Alnum", ""), ("Alnum", _MARK), ("Alnum", _MARK + "+#"))))
#: The third branch without possessive marks: what RE2 can do; equal on texts without acronyms and C languages.
TOKEN_RE2 = rf"(?:[vV]?[0-9]+(?:\.[0-9]+)+|[{_WORD}])[{_WORD}{_MARK}]*(?:[{_JOIN}][{_WORD}][{_WORD}{_MARK}]*)*"
#: Characters with a fold of their own, what they become, and the stand-in that keeps the dotted capital I.
_FOLD_FROM, _FOLD_TO, _KEEP = "ſ\u2010\u2011\u2019\u02bcİ", "s--''\ue000", "\ue000"

_TOKEN, _ACRONYM, _FOLDS = re.compile(TOKEN), re.compile(rf"[{_LETTER}]\."), str.maketrans(_FOLD_FROM, _FOLD_TO)


def raw_tokens(text: Column) -> Column:
    """The tokens of a text as they stand, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_JAVA), F.lit(0))


def normalise(token: Column) -> Column:
    """Case folded, connectors unified, acronyms without dots."""
    folded = F.translate(F.lower(F.translate(token, _FOLD_FROM, _FOLD_TO)), _KEEP, "İ")
    return F.when(folded.rlike(rf"^[{_LETTER}]\."), F.replace(folded, F.lit("."), F.lit(""))).otherwise(folded)


def is_odd(text: Column) -> Column:
    """Whether any token of a text may need more than lower case: a character with a fold of its own, or an acronym.

    Asked once for a text, it spares ``normalise`` for each of its tokens.
    """
    folds = (F.contains(text, F.lit(c)) for c in _FOLD_FROM + _KEEP)
    return reduce(lambda a, b: a | b, folds, text.rlike(rf"\.[\p{{Alpha}}[{_OTHER}]]\."))


def normalise_if(odd: Column, token: Column) -> Column:
    return F.when(odd, normalise(token)).otherwise(F.lower(token))


def tokenize(text: Column) -> Column:
    """Array of normalised tokens; a token's position is its index."""
    return F.transform(raw_tokens(text), normalise)


def tokens_of(text: str) -> list[str]:
    """``tokenize`` of one string, on the driver: the same pattern and folds without a Spark job."""
    out = []
    for m in _TOKEN.finditer(text):
        folded = m[0].translate(_FOLDS).lower().replace(_KEEP, "İ")
        out.append(folded.replace(".", "") if _ACRONYM.match(folded) else folded)
    return out


def tokens(corpus: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("title", "body"), keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, field, pos, term, *keep)``: one row per token; field is the index in ``fields``."""
    texts = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(f).alias("t")) for i, f in enumerate(fields)))
    each = corpus.select(id_col, *keep, F.explode(texts).alias("f")).select(id_col, *keep, F.col("f.field").alias("field"), raw_tokens(F.col("f.t")).alias("a"), is_odd(F.col("f.t")).alias("odd"))
    # Outer, as an inner explosion would bring a filter that tokenizes the text once more.
    found = each.select(id_col, *keep, "field", "odd", F.posexplode_outer("a").alias("pos", "raw")).where("raw is not null")
    return found.select(id_col, "field", "pos", normalise_if(F.col("odd"), F.col("raw")).alias("term"), *keep)


@F.arrow_udf(T.ArrayType(T.LongType()))
def running_sums(lists: pa.Array) -> pa.Array:
    """The running sums within each list of numbers, all lists of a batch at once."""
    import numpy as np

    ends = np.asarray(lists.offsets, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(lists.values.to_numpy(zero_copy_only=False), dtype=np.int64)])
    each = total[ends[0] + 1 : ends[-1] + 1] - np.repeat(total[ends[:-1]], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(each))


def token_spans(corpus: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """``(id, field, pos, begin_byte, end_byte, term, n_chars)`` with UTF-8 offsets in the field.

    Offsets are running sums of the lengths of gaps and tokens within the row of a text: linear in the text, and no
    token is shuffled or sorted.
    """
    texts = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(f).alias("t")) for i, f in enumerate(fields)))
    each = corpus.select(id_col, F.explode(texts).alias("f")).select(id_col, F.col("f.field").alias("field"), F.coalesce("f.t", F.lit("")).alias("t"))
    each = each.select(id_col, "field", raw_tokens(F.col("t")).alias("raw"), F.split("t", TOKEN_JAVA, -1).alias("gap"), is_odd(F.col("t")).alias("odd"))
    # The last gap has no token after it.
    sizes = F.zip_with("raw", F.slice("gap", F.lit(1), F.size("raw")), lambda r, g: (F.octet_length(r) + F.octet_length(g)).cast("long"))
    each = each.select(id_col, "field", "raw", "odd", running_sums(sizes).alias("end"))
    rows = each.select(id_col, "field", "odd", F.posexplode_outer(F.arrays_zip("raw", "end")).alias("pos", "p")).select(id_col, "field", "odd", "pos", F.col("p.raw").alias("raw"), F.col("p.end").alias("end")).where("raw is not null")
    return rows.select(
        id_col, "field", "pos", (F.col("end") - F.octet_length("raw")).alias("begin_byte"), F.col("end").alias("end_byte"),
        normalise_if(F.col("odd"), F.col("raw")).alias("term"), F.length("raw").alias("n_chars"),
    )


def collapse_blanks(text: Column, blanks: str = " \t") -> Column:
    """Runs of blanks become one space, none beside a line end, and at most one empty line stays in a row."""
    t = F.regexp_replace(text, f"[{blanks}]+", " ")
    t = F.regexp_replace(t, " *\n *", "\n")
    return F.regexp_replace(t, "\n{3,}", "\n\n")


def clean_text(text: Column) -> Column:
    """Line ends unified, blanks collapsed, lines stripped, at most one empty line in a row."""
    return F.trim(collapse_blanks(F.regexp_replace(text, "\r\n?", "\n"), " \t\u00a0"), F.lit(" \n"))


def word_count(text: Column) -> Column:
    """Words by the plain statistics rule: runs of word characters, apostrophes and hyphens that begin with a word character."""
    return F.regexp_count(text, F.lit(r"(?U)\b[\w'-]+\b")).cast("long")


def log_tf(n: Column) -> Column:
    return F.when(n > 0, 1 + F.log10(n.cast("double"))).otherwise(0.0)


def idf(n_documents: Column, df: Column) -> Column:
    return F.log10(n_documents.cast("double") / df)


def queue_order(url: Column) -> Column:
    """The first 8 bytes of the URL's SHA-256 without the sign bit: a stable shuffle."""
    digest = F.sha2(url, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    return F.shiftleft(high, 32).bitwiseOR(F.conv(F.substring(digest, 9, 8), 16, 10).cast("long"))


def variable_byte_length(n: Column) -> Column:
    """Bytes of a non-negative integer in groups of seven bits."""
    bits = F.length(F.bin(n))
    return F.ceil(bits / 7.0).cast("int")


def publication_year(date: Column) -> Column:
    """The year that an ISO date begins with (1900 to 2100), else 0."""
    year = F.regexp_extract(date, r"^((?:19|20)[0-9][0-9]|2100)(?:-|$)", 1)
    return F.coalesce(F.nullif(year, F.lit("")).cast("int"), F.lit(0))
