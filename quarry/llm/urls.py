"""URL filters: allow and block rules, then a ratio of two character language models.

Rules are (verdict, host, path); one fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's; the longest fitting rule (host and path together) decides. Where none fits, two smoothed
variable-order Markov models decide, one of accepted and one of rejected URLs, which are those that the rules decide:
a symbol's probability backs off along its longest known contexts (Witten-Bell), up to ``ORDER`` symbols, and the
difference of the log-likelihoods, divided by the length, is held against a calibrated threshold. Digits count as one
symbol, since numbers in URLs say little.

The models are tables. All decided URLs are counted, each as often as it occurs, but for those whose form's hash puts
them aside; on these the threshold is calibrated: the cut of best balanced accuracy among bins of ``BIN``, so that a
bounded histogram is all that reaches the driver (0 if a kind has none). A form is a sequence of windows, a symbol
with the up to ``ORDER`` symbols before it. Windows are counted first and then split into contexts; likewise each
different window is scored once, by joins with the model's tables, and the forms add their windows up. Nothing is
capped, and nothing is broadcast but what Spark finds small when it runs.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and the models' verdict on the
empty string (margin 0, hence "allow" when the threshold is at most 0); repeated rows and null ids are judged row by
row, and repeated URLs are learnt from as often as they stand; URLs of any length are read whole; an empty table gives
an empty result, and models without URLs margins of 0; columns other than the id and the URL are ignored. The margin
is null where a rule decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, field, table

ORDER = 5
#: Symbols that an unknown one is one of.
SYMBOLS = 256
#: One in so many decided forms is put aside for the threshold; the width of its bins.
ASIDE, BIN = 5, 0.001
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
KINDS = ("allow", "block")
_DIGITS = re.compile(r"[0-9]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as the filter sees them."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
    return host, m[2]


def match_rule(host: str, path: str, rules=RULES) -> tuple[str, str, str] | None:
    """The longest rule that fits; of equally long ones the first by host, then path, then verdict."""
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return min(fits, key=lambda r: (-len(r[1] + r[2]), r[1], r[2], r[0])) if fits else None


def normal(url: str | None) -> str:
    """What the models read: from the host on, A-Z lower-cased in the host, digits as one symbol, fragment left out."""
    if url is None or (at := url.find("://")) < 0:
        return ""
    host, path = split_url(url)
    return "^" + _DIGITS.sub("0", host + path)


@dataclass
class Model:
    """``grams`` has (context, symbol, allow, block): a known symbol's log-probability less its context's back-off;
    ``contexts`` (context, allow, block): the summed log-back-off of a context and all its endings. Null: not known."""

    grams: DataFrame
    contexts: DataFrame
    order: int
    threshold: float = 0.0


def look(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, kind, form)`` of every row: what the rules say, and what the models read."""

    def fn(batch: pa.RecordBatch) -> list:
        urls = batch.column(1).to_pylist()
        parts = [split_url(u) for u in urls]
        found = [match_rule(h, p, rules) for h, p in parts]
        return [batch.column(0), [h for h, _ in parts], [p for _, p in parts], [r and r[1] + r[2] for r in found], [r and r[0] for r in found], [normal(u) for u in urls]]

    names = ("host", "path", "rule", "kind", "form")
    return arrow_map(pages.select(id_col, url_col), fn, T.StructType([field(pages, id_col), *(T.StructField(n, T.StringType()) for n in names)]), 4096)


def _windows(forms: DataFrame, order: int) -> DataFrame:
    """``forms`` with one row for each symbol of ``form``: the ``window`` that ends with it."""
    each = forms.where("form <> ''").withColumn("i", F.explode(F.sequence(F.lit(1), F.length("form"))))
    return each.withColumn("window", F.substring(F.col("form"), F.greatest(F.col("i") - order, F.lit(1)), F.least(F.col("i"), F.lit(order + 1)))).drop("i")


def _contexts(windows: DataFrame) -> DataFrame:
    """One row for each context of a window: ``k`` symbols before the last, which is ``symbol``."""
    n = F.length("window")
    each = windows.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumns({"context": F.when(F.col("k") == 0, "").otherwise(F.substring(F.col("window"), n - F.col("k"), F.col("k"))), "symbol": F.substring(F.col("window"), n, F.lit(1))})


def fit(forms: DataFrame, order: int = ORDER) -> Model:
    """Both models from ``forms(kind, form, n)``; the threshold is 0.

    From order to order, a gram's smoothed probability needs that of the gram without its first symbol: a join a step.
    """
    windows = _windows(forms.where(F.col("kind").isin(*KINDS)), order).groupBy("kind", "window").agg(F.sum("n").alias("n"))
    times = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("double")
    counts = table(_contexts(windows).groupBy("k", "context", "symbol").agg(*(times(k).alias(k) for k in KINDS)), "url-grams")
    levels = []
    for k in range(order + 1):
        level = counts.where(F.col("k") == k)
        sums = level.groupBy("context").agg(*(F.sum(m).alias(f"n_{m}") for m in KINDS), *(F.count_if(F.col(m) > 0).alias(f"kinds_{m}") for m in KINDS))
        level = level.join(sums, "context")
        if k:
            shorter = levels[-1].select(F.col("context").alias("_c"), F.col("symbol").alias("_s"), *(F.col(f"p_{m}").alias(f"_p_{m}") for m in KINDS), *(F.col(f"b_{m}").alias(f"_b_{m}") for m in KINDS))
            level = level.join(shorter, (F.substring("context", 2, order) == F.col("_c")) & (F.col("symbol") == F.col("_s")))
        out = []
        for m in KINDS:
            n, kinds = F.col(f"n_{m}"), F.col(f"kinds_{m}")
            below = F.col(f"_p_{m}") if k else F.lit(1 / SYMBOLS)
            out.append(F.when(F.col(m) > 0, (F.col(m) + kinds * below) / (n + kinds)).alias(f"p_{m}"))
            out.append(F.when(n > 0, F.log(kinds / (n + kinds)) + (F.col(f"_b_{m}") if k else F.lit(0.0))).alias(f"b_{m}"))
        levels.append(table(level.select("context", "symbol", *out), "url-level"))
    every = reduce(DataFrame.unionByName, levels)
    contexts = every.groupBy("context").agg(*(F.first(f"b_{m}").alias(m) for m in KINDS))
    grams = every.select("context", "symbol", *((F.log(f"p_{m}") - F.col(f"b_{m}")).alias(m) for m in KINDS))
    return Model(table(grams, "url-model"), table(contexts, "url-contexts"), order)


def margins(forms: DataFrame, model: Model) -> DataFrame:
    """``(form, margin)`` of the different ``forms(form)``: the log-likelihood difference per symbol; 0 for the empty form."""
    forms = forms.select("form").distinct()
    key = F.struct(F.xxhash64("form").alias("a"), F.hash("form").alias("b"), F.length("form").alias("c"))
    symbols = _windows(forms, model.order).select(key.alias("key"), F.length("form").alias("size"), "window")
    known = model.grams.select("context", "symbol", *(F.col(m).alias(f"g_{m}") for m in KINDS))
    backed = model.contexts.select("context", *(F.col(m).alias(f"b_{m}") for m in KINDS))
    each = _contexts(symbols.select("window").distinct()).join(known, ["context", "symbol"], "left").join(backed, "context", "left")
    longest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("k")))
    total = lambda m: F.coalesce(longest(f"g_{m}"), F.log(F.lit(1 / SYMBOLS))) + F.coalesce(longest(f"b_{m}"), F.lit(0.0))
    scores = table(each.groupBy("window").agg((total("allow") - total("block")).alias("d")), "url-windows")
    summed = symbols.join(scores, "window").groupBy("key", "size").agg(F.sum("d").alias("d"))
    found = forms.join(summed.select(F.col("key").alias("_key"), (F.col("d") / F.col("size")).alias("d")), key == F.col("_key"), "left")
    return found.select("form", F.round(F.coalesce("d", F.lit(0.0)), 12).alias("margin"))


def best_cut(histogram: list[tuple[int, float, float]], width: float = BIN) -> float:
    """The threshold of best balanced accuracy from rows (bin, accepted, rejected); the middle between two bins."""
    rows = sorted(histogram)
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    # Cut before row i: all rejected below are right, all accepted below are wrong.
    best, cut, gain = 0.0, rows[0][0] * width, 0.0
    for (here, g, b), after in zip(rows, [*rows[1:], None]):
        gain += b / bad - g / good
        if gain > best + 1e-12:
            best, cut = gain, ((here + 1 + after[0]) / 2 if after else here + 1) * width
    return cut


def train(looked: DataFrame, order: int = ORDER) -> Model:
    """Fit and calibrate on the decided rows of ``look``."""
    forms = table(looked.where("kind is not null and form <> ''").groupBy("kind", "form").agg(F.count("*").alias("n")), "url-forms")
    aside = F.pmod(F.xxhash64("form", F.lit("aside")), F.lit(ASIDE)) == 0
    model = fit(forms.where(~aside), order)
    held = forms.where(aside)
    binned = held.join(margins(held, model), "form").groupBy(F.floor(F.col("margin") / BIN).alias("bin")).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == m, F.col("n"))), F.lit(0)).cast("double").alias(m) for m in KINDS))
    model.threshold = best_cut([tuple(r) for r in binned.collect()])
    return model


def judge(looked: DataFrame, model: Model, id_col: str = "page_id") -> DataFrame:
    """``(id, host, path, rule, verdict, margin)`` of the rows of ``look``."""
    asked = looked.where("kind is null")
    said = margins(asked, model).withColumnRenamed("form", "_form")
    verdict: Column = F.when(F.col("margin") >= F.lit(model.threshold), "allow").otherwise("block")
    by_model = asked.join(said, F.col("form") == F.col("_form")).select(id_col, "host", "path", "rule", verdict.alias("verdict"), "margin")
    by_rule = looked.where("kind is not null").select(id_col, "host", "path", "rule", F.col("kind").alias("verdict"), F.lit(None).cast("double").alias("margin"))
    return by_rule.unionByName(by_model)


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rules and models fitted on the decided rows of the same table: ``judge`` of every row."""
    looked = table(look(pages, rules, id_col, url_col), "urls")
    return judge(looked, train(looked), id_col)
