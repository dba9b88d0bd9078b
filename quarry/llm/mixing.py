"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up by cell, the combination of source, language and topic. Raking scales the cells' weights to each
marginal's targets in turn until every marginal holds to ``TOLERANCE``; where the cells there are can't meet all
targets, it ends when ``STUCK`` rounds in a row bring it no nearer (or after ``ROUNDS``), with the last axis's targets
met. The cells' weights, over their tokens, give each document's probability, scaled so
that the expected size is the budget, where no probability exceeds one (cells that would are taken whole and the rest
shares what is left). Such cells keep a marginal from its target, so ``marginals`` reports what is reached. Documents are then drawn by a hash of their id against the probability,
so that the draw is the same on every run, whatever the partitioning.

Targets: a mapping of category to share for a marginal, or a power to which the category's own token share is raised
(0.5: between natural and uniform). Categories that a mapping leaves out keep their natural share, and all shares are
scaled to sum up to one. Everything runs on built-in functions; only cells are shuffled after the first aggregation,
and a hot source is combined before it. Cells are never brought into one task: marginals are grouped sums, whose
factors are applied to all cells, and the scale of the probabilities is found by a few sums over all cells.

Defined results: null source, language or topic is a category of its own; a null or empty text has no tokens but one
is counted for it, so that it can be drawn; null ids are drawn by the hash of nothing; repeated rows are drawn alike; an
empty table gives an empty result; other columns are kept by ``sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

NULL = "\u0000"
AXES = ("source", "lang", "topic")
#: Relative error that a marginal may keep, and the rounds, in all and without progress, after which raking ends.
TOLERANCE, ROUNDS, STUCK = 1e-9, 200, 3
#: Categories of an axis whose factors are kept as numbers.
FEW = 200


def token_estimate(text: Column) -> Column:
    """White-space separated words, at least one."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)), F.lit(1)).cast("long")


def length_topic(n_tokens: Column) -> Column:
    """A coarse topic for tables without one: the text's form by length."""
    return F.when(n_tokens < 120, "note").when(n_tokens < 800, "article").otherwise("longread")


def tokens(docs: DataFrame, source: Column, lang: Column, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, source, lang, topic, n_tokens)`` of every row, nulls as a category."""
    n = token_estimate(F.col(text_col))
    df = docs.select(F.col(id_col), source.cast("string").alias("source"), lang.cast("string").alias("lang"), n.alias("n_tokens"), (F.lit(None) if topic is None else topic).cast("string").alias("topic"))
    topics = length_topic(F.col("n_tokens")) if topic is None else F.col("topic")
    return df.select(id_col, F.coalesce("source", F.lit(NULL)).alias("source"), F.coalesce("lang", F.lit(NULL)).alias("lang"), F.coalesce(topics, F.lit(NULL)).alias("topic"), "n_tokens")


def _target(cells: DataFrame, axis: str, wanted: dict[str, float] | float, total: float) -> DataFrame:
    """``cells`` with the target share of their category on ``axis``."""
    share = F.col("s") / F.lit(total)
    if isinstance(wanted, dict):
        pairs = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)) if wanted else None
        raw = F.coalesce(pairs[F.col("_k")], share) if wanted else share
    else:
        raw = F.pow(share, F.lit(float(wanted)))
    sums = table(cells.groupBy(F.col(axis).alias("_k")).agg(F.sum("n").alias("s")).select("_k", raw.cast("double").alias("raw")), "targets")
    whole = sums.agg(F.sum("raw")).first()[0]
    return cells.join(sums.select("_k", (F.col("raw") / F.lit(whole)).alias(f"t_{axis}")), F.col(axis) == F.col("_k")).drop("_k")


def _weights(cells: DataFrame, factors: dict[str, dict[str, float] | DataFrame], leave: str | None = None) -> tuple[DataFrame, Column]:
    """``cells`` and the column of their tokens times the factors of their categories, of all axes but ``leave``."""
    w = F.col("n")
    for axis, factor in factors.items():
        if axis == leave:
            continue
        if isinstance(factor, dict):
            w = w * F.create_map(*(F.lit(x) for kv in factor.items() for x in kv))[F.col(axis)]
        else:
            cells = cells.join(factor.withColumnRenamed("f", f"_f_{axis}"), F.col(axis) == F.col("_k")).drop("_k")
            w = w * F.col(f"_f_{axis}")
    return cells, w


def rake(docs: DataFrame, targets: dict[str, dict[str, float] | float], rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """``(source, lang, topic, n, t_source, t_lang, t_topic, w)``: tokens of each cell, the target shares of its
    categories, and the weight after raking; all weights sum up to 1.

    A cell's weight is its tokens times a factor for each of its categories, and a step sets one axis's factors so that
    its marginal holds. Factors are numbers in the plan while an axis has at most ``few`` categories, else a table.
    """
    cells = table(docs.groupBy(*AXES).agg(F.sum("n_tokens").cast("double").alias("n")), "cells")
    total = cells.agg(F.sum("n")).first()[0]
    if total is None:
        return cells.select(*AXES, "n", *(F.lit(0.0).alias(f"t_{a}") for a in AXES), F.lit(0.0).alias("w"))
    for axis in AXES:
        cells = _target(cells, axis, targets.get(axis, 1.0), total)
    cells = table(cells, "cells")
    factors: dict[str, dict[str, float] | DataFrame] = {}
    for axis in AXES:
        names = cells.select(axis).distinct()
        taken = names.limit(few + 1).collect()
        factors[axis] = {r[0]: 1.0 for r in taken} if len(taken) <= few else table(names.select(F.col(axis).alias("_k"), F.lit(1.0).alias("f")), "factors")
    before, stuck = float("inf"), 0
    for _ in range(rounds):
        off = 0.0
        for axis in AXES:
            each, w = _weights(cells, factors, axis)
            sums = each.groupBy(F.col(axis).alias("_k")).agg((F.first(f"t_{axis}") / F.sum(w)).alias("f"))
            if isinstance(factors[axis], dict):
                fresh = {r[0]: r[1] for r in sums.collect()}
                off = max(off, *(abs(factors[axis][k] / fresh[k] - 1) for k in fresh))
            else:
                fresh = table(sums, "factors")
                off = max(off, fresh.join(factors[axis].withColumnRenamed("f", "old"), "_k").agg(F.max(F.abs(F.col("old") / F.col("f") - 1))).first()[0])
            factors[axis] = fresh
        stuck = stuck + 1 if off > 0.99 * before else 0
        before = off
        if off <= TOLERANCE or stuck == STUCK:
            break
    each, w = _weights(cells, factors)
    return each.select(*AXES, "n", *(f"t_{a}" for a in AXES), w.alias("w"))


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` with column ``p``: probabilities in proportion to ``w / n``, at most 1, whose expected tokens are ``budget``
    of all tokens.

    Cells whose probability would exceed 1 are taken whole, which raises the scale of the rest; repeated until no more
    cells join them, which sums over all cells decide.
    """
    r = F.col("w") / F.col("n")
    total, scale, n_whole = cells.agg(F.sum("n")).first()[0], 0.0, -1
    while total is not None:
        over = F.lit(scale) * r >= 1
        count, n, w = cells.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0.0)), F.sum(F.when(~over, F.col("w")))).first()
        if not w:
            return cells.withColumn("p", F.lit(1.0))
        if count == n_whole:
            break
        scale, n_whole = max(0.0, (budget * total - n) / w), count
    return cells.withColumn("p", F.least(F.lit(1.0), F.lit(scale) * r))


def marginals(cells: DataFrame) -> DataFrame:
    """``(axis, category, target, natural, expected)``: target shares, shares of all tokens, and shares of the expected
    sample, from cells with probabilities."""
    total, kept = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("p"))).first()
    parts = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("category"), F.col(f"t_{a}").alias("target")) for a in AXES))
    each = cells.select("n", (F.col("n") * F.col("p")).alias("kept"), F.explode(parts).alias("x"))
    sums = each.groupBy("x.axis", "x.category").agg(F.first("x.target").alias("target"), F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    return sums.select("axis", "category", "target", (F.col("n") / F.lit(total or 1.0)).alias("natural"), (F.col("kept") / F.lit(kept or 1.0)).alias("expected"))


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id's text: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan(counted: DataFrame, targets: dict[str, dict[str, float] | float], budget: float = 0.5) -> DataFrame:
    """The cells of ``tokens`` with weights and probabilities."""
    return table(probabilities(table(rake(counted, targets), "raked"), budget), "probabilities")


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | float], budget: float = 0.5, seed: int = 7, source: Column | None = None, lang: Column | None = None, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, source, lang, topic, n_tokens, weight, p, kept)`` for every row, and ``target_<axis>``, ``expected_<axis>``: the
    shares of the row's categories that were asked for and that the sample can be expected to have.

    ``weight`` is the cell's raked share over its natural one.
    """
    counted = tokens(docs, F.col("source") if source is None else source, F.col("lang") if lang is None else lang, topic, id_col, text_col)
    cells = plan(counted, targets, budget)
    total = cells.agg(F.sum("n")).first()[0] or 1.0
    shares = cells.select(*AXES, (F.col("w") / (F.col("n") / F.lit(total))).alias("weight"), "p")
    reached = table(marginals(cells), "marginals")
    for axis in AXES:
        own = reached.where(F.col("axis") == axis).select(F.col("category").alias("_k"), F.col("target").alias(f"target_{axis}"), F.col("expected").alias(f"expected_{axis}"))
        shares = shares.join(own, F.col(axis) == F.col("_k")).drop("_k")
    joined = counted.join(table(shares, "shares"), list(AXES))
    report = [f"{kind}_{axis}" for axis in AXES for kind in ("target", "expected")]
    return joined.select(id_col, *AXES, "n_tokens", "weight", "p", (draw(F.col(id_col), seed) < F.col("p")).alias("kept"), *report)


def sample(docs: DataFrame, targets: dict[str, dict[str, float] | float], budget: float = 0.5, seed: int = 7, source: str = "source", lang: str = "lang", topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, all columns."""
    n = token_estimate(F.col(text_col))
    counted = tokens(docs, F.col(source), F.col(lang), topic, id_col, text_col)
    cells = plan(counted, targets, budget)
    keys = cells.select(*(F.col(a).alias(f"__q_{a}") for a in AXES), F.col("p").alias("__q_p"))
    topics = length_topic(n) if topic is None else topic.cast("string")
    marked = docs.withColumn("__q_n", n)
    joined = marked.join(
        keys,
        (F.coalesce(F.col(source).cast("string"), F.lit(NULL)) == F.col("__q_source"))
        & (F.coalesce(F.col(lang).cast("string"), F.lit(NULL)) == F.col("__q_lang"))
        & (F.coalesce(topics, F.lit(NULL)) == F.col("__q_topic")),
    )
    return joined.where(draw(F.col(id_col), seed) < F.col("__q_p")).select(*docs.columns)
