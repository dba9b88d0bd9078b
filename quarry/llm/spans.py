"""Positions of regular-expression matches with built-in functions only.

Spark gives the strings of all matches, but not where they are. The text split at the same pattern gives the gaps, and
sums of lengths give the positions, in code points. Sums run in blocks, so that the cost stays linear in the number of
matches up to a factor of ``BLOCK``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
#: Characters of the pieces that a text is cut into.
CHUNK = 64
_NONE = "array<struct<start:int,end:int,value:string>>"


def no_spans() -> Column:
    return F.array().cast(_NONE)


def _running(values: Column, start: Column, op=lambda a, b: a + b) -> Column:
    """Exclusive running values of an int array from ``start``, sums by default; quadratic, for short arrays."""
    seed = F.struct(start.cast("int").alias("s"), F.array().cast("array<int>").alias("a"))
    return F.aggregate(values, seed, lambda acc, x: F.struct(op(acc["s"], x).cast("int").alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")), lambda acc: acc["a"])


def _blocks(values: Column) -> Column:
    """An array as an array of arrays of ``BLOCK`` elements; none for an empty one."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def disjoint(spans: Column) -> Column:
    """Sorted spans (start, end, ...) with overlapping ones made into one, which has the other fields of its first."""

    def merge(v: Column) -> Column:
        ends = F.transform(v["blocks"], lambda b: F.aggregate(b, F.lit(0), lambda a, x: F.greatest(a, x["end"])))
        before = F.zip_with(v["blocks"], _running(ends, F.lit(0), F.greatest), lambda b, o: F.struct(b.alias("b"), o.alias("o")))
        reach = F.flatten(F.transform(before, lambda x: _running(F.transform(x["b"], lambda s: s["end"]), x["o"], F.greatest)))
        # ``reach`` is how far the spans before went; a span that begins no earlier opens a new one, which ends where
        # the last span before the next opening leaves off.
        opened = F.filter(F.zip_with(v["s"], reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), lambda x: x["s"]["start"] >= x["r"])
        far = F.array_max(F.transform(v["s"], lambda s: s["end"]))
        return once(F.struct(opened.alias("o"), F.concat(F.transform(F.slice(opened, F.lit(2), F.size(opened)), lambda x: x["r"]), F.array(far)).alias("e")), lambda w: F.zip_with(w["o"], w["e"], lambda x, e: x["s"].withField("end", e)))

    return F.when(F.size(spans) > 0, once(spans, lambda s: once(F.struct(s.alias("s"), _blocks(s).alias("blocks")), merge))).otherwise(spans)


def replaced(text: Column, spans: Column, fill) -> Column:
    """``text`` with each of the sorted, disjoint ``spans`` replaced by ``fill(span, part)``; ``part(a, b)`` is the text
    from a to b.

    The text is cut once into pieces of ``CHUNK`` characters, so that finding a position does not cost a walk from the
    start: linear in the text and its spans.
    """

    def part(c: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        head = lambda n: F.substring(F.get(c, i), a % CHUNK + 1, n)
        many = F.concat(head(F.lit(CHUNK)), F.array_join(F.slice(c, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(c, j), F.lit(1), b % CHUNK), F.lit("")))
        return F.when(b <= a, "").when(i == j, head(b - a)).otherwise(many)

    def join(v: Column) -> Column:
        ends = F.transform(v["s"], lambda s: s["end"])
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        pieces = F.zip_with(v["s"], before, lambda s, at: F.concat(part(v["c"], at, s["start"]), fill(s, lambda a, b: part(v["c"], a, b))))
        return F.array_join(F.concat(pieces, F.array(part(v["c"], F.element_at(ends, -1), v["n"]))), "")

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, once(F.struct(chunks.alias("c"), spans.alias("s"), F.length(text).alias("n")), join)).otherwise(text)


def with_spans(df: DataFrame, name: str, text: str, pattern: str, maybe: Column | None = None) -> DataFrame:
    """``df`` with array ``name`` of the matches of ``pattern`` in column ``text``: start, end (exclusive) and value.

    ``pattern`` must not match the empty string. Rows where ``maybe`` is not true get none, unsearched.
    """
    z, blocks, bases = f"{name}_z", f"{name}_b", f"{name}_o"
    rx = F.lit(pattern)
    pieces = F.zip_with(
        F.split(F.col(text), pattern, -1),
        F.regexp_extract_all(F.col(text), rx, F.lit(0)),
        lambda g, m: F.struct(F.length(g).alias("gap"), (F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("step"), m.alias("value")),
    )
    pieces = F.when(F.col(text).isNotNull() & (F.lit(True) if maybe is None else maybe), pieces)
    df = df.withColumn(z, pieces)
    some = F.size(F.col(z)) > 1  # the last piece is the gap after the last match
    n = F.size(F.col(z))
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(F.col(z), b * BLOCK + 1, F.lit(BLOCK)))
    df = df.withColumn(blocks, F.when(some, cut))
    totals = F.transform(F.col(blocks), lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["step"]))
    df = df.withColumn(bases, F.zip_with(F.col(blocks), _running(totals, F.lit(0)), lambda b, o: F.struct(b.alias("b"), o.alias("o"))))
    inner = F.flatten(
        F.transform(
            F.col(bases),
            lambda x: F.zip_with(
                x["b"],
                _running(F.transform(x["b"], lambda p: p["step"]), x["o"]),
                lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["step"]).alias("end"), p["value"].alias("value")),
            ),
        )
    )
    found = F.when(F.col(bases).isNotNull(), F.filter(inner, lambda x: x["value"].isNotNull())).otherwise(no_spans())
    return df.withColumn(name, found.cast(_NONE)).drop(z, blocks, bases)


def keep(name: str, test) -> Column:
    """The spans whose value passes ``test``."""
    return F.filter(F.col(name), lambda s: test(s["value"]))


def tagged(name: str, rank: int, order: str = "start") -> Column:
    """Spans as sortable structs: by start then rank, or by rank then start."""
    if order == "start":
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("a"), F.lit(rank).alias("b"), s["end"].alias("end")))
    return F.transform(F.col(name), lambda s: F.struct(F.lit(rank).alias("a"), s["start"].alias("b"), s["end"].alias("end")))


def rendered(sorted_spans: Column, kinds: list[str], order: str = "start") -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*(F.lit(k) for k in kinds))
    start, rank = ("a", "b") if order == "start" else ("b", "a")
    return F.array_join(F.transform(sorted_spans, lambda s: F.concat_ws(":", F.get(names, s[rank]), s[start], s["end"])), ",")
