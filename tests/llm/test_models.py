"""Nearest neighbours, URL filter, quality classifier and mixing."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, mixing, quality, urls
from quarry.llm import queries as q
from quarry.llm.common import table

DATA = "/root/testdata/sf0.01"


def brute_nearest(ids, vectors, queries, k=10):
    out = {}
    for i in queries:
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in best if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize("block", [16384, 100])
def test_recall_and_exact_scores(spark, block):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    pdf = df.toPandas().sort_values("vec_id")
    ids, vectors = pdf.vec_id.to_numpy(), np.array(pdf.embedding.tolist(), dtype=np.float64)
    want = brute_nearest(ids, vectors, np.flatnonzero(ids % 10 == 0))
    rows = ann.nearest(df, df.where("vec_id % 10 = 0"), block=block, query_block=20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    met = sum(len({i for i, _ in got[k]} & {i for i, _ in want[k]}) for k in want)
    assert met >= 0.9 * 10 * len(want)
    at = {int(i): v for i, v in zip(ids, vectors)}
    for k, found in got.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and all(i != k for i, _ in found)
        assert all(abs(math.sqrt(((at[i] - at[k]) ** 2).sum()) - s) < 1e-12 for i, s in found)


def test_few_vectors_are_verified():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((8000, 64))
    index = ann.Index(np.arange(8000), vectors)
    found, verified = 0, 0
    for i in range(0, 8000, 400):
        ids, distances, n = index.search(vectors[i], 10, i)
        want = brute_nearest(np.arange(8000), vectors, [i])[i]
        found, verified = found + len(set(ids) & {j for j, _ in want}), verified + n
    assert found >= 0.9 * 200 and verified < 0.15 * 20 * 8000
    d = ann.directions(20, 7)
    assert d.shape == (20, 7) and np.allclose(np.linalg.norm(d, axis=1), 1) and np.allclose(d[:7] @ d[:7].T, np.eye(7)) and ann.directions(5, 9).shape == (5, 9)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [5.0, 0.0]), (8, [5.0, 0.0]), (0, [3.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0]), (10, [])]
    df = spark.createDataFrame([(a, b, 0, 0.0) for a, b in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id in (0, 2, 9)")).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 1), (0, 4, 8)] and got[0][3] == 0.0 and got[3][3] == 4.0
    assert ann.nearest(df.where("false"), df).collect() == [] and ann.nearest(df, df.where("false")).collect() == []


def test_identical_vectors_go_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.nearest(df, df.where("vec_id = 5"), block=50).orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_url_parts_and_rules():
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme/x": ("", "", None), "http://A.Example.NET/en/1?q#f": ("a.example.net", "/en/1", "allow"), "http://x.net": ("x.net", "", None),
        "http://x.net/": ("x.net", "/", "block"), "http://evilexample.com/de/": ("evilexample.com", "/de/", None), "http://example.com/de/x": ("example.com", "/de/x", "block"),
        "http://a.org/fr/": ("a.org", "/fr/", "allow"), "http://a.org/fr": ("a.org", "/fr", None), "x://h?y://z/en/": ("h", "", None), "http://example.net/EN/": ("example.net", "/EN/", "block"), "http://É.NET/x": ("É.net", "/x", "block"),
        "http://a.org#/fr/": ("a.org", "", None),
    }
    for url, (host, path, verdict) in cases.items():
        assert urls.split_url(url) == (host, path)
        r = urls.match_rule(host, path)
        assert (r and r[0]) == verdict, url


class PlainMarkov:
    """Counts of symbols after contexts; probabilities by recursion over the context's length."""

    def __init__(self, weighted, order):
        self.order, self.after = order, {}
        for text, n in weighted:
            for i, ch in enumerate(text):
                for k in range(min(i, order) + 1):
                    seen = self.after.setdefault(text[i - k : i], {})
                    seen[ch] = seen.get(ch, 0) + n

    def prob(self, context, ch):
        below = 1 / 256 if not context else self.prob(context[1:], ch)
        seen = self.after.get(context)
        return below if not seen else (seen.get(ch, 0) + len(seen) * below) / (sum(seen.values()) + len(seen))

    def log_likelihood(self, text):
        return math.fsum(math.log(self.prob(text[max(0, i - self.order) : i], ch)) for i, ch in enumerate(text))


def plain_rule(url):
    """(host, path, rule, verdict) by plain splitting."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
        before = rest[:end]
        host, slash, path = before.partition("/")
        path = slash + path
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if ("." + host).endswith("." + h) and path[: len(p)] == p and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def plain_judge(rows):
    """page_id, url -> (host, path, rule, verdict, margin), with models of its own."""
    looked = [(i, *plain_rule(u), "" if u is None or "://" not in u else "^" + re.sub("[0-9]", "0", plain_rule(u)[0] + plain_rule(u)[1])) for i, u in rows]
    forms = {}
    for _, _, _, _, kind, form in looked:
        if kind and form:
            forms[kind, form] = forms.get((kind, form), 0) + 1
    return looked, forms


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "no scheme"), (-4, "http://a.org/fr/"), (-4, "http://a.org/fr/"), (-5, "x://ÉÜ.shop/" + "ab" * 20_000), (None, "http://casino.example.org/x")], "page_id long, url string")
    pages = pages.unionByName(odd).withColumns({"host": F.lit("x"), "form": F.lit("y"), "n": F.lit(1)})
    looked = table(urls.look(pages), "looked")
    model = urls.train(looked)
    return pages.select("page_id", "url").collect(), looked, model, urls.judge(looked, model).collect()


def test_url_verdicts_against_plain_models(spark, judged):
    rows, looked, model, got = judged
    plain, forms = plain_judge([tuple(r) for r in rows])
    aside = {r.form for r in looked.where(F.pmod(F.xxhash64("form", F.lit("aside")), F.lit(urls.ASIDE)) == 0).select("form").collect()}
    markov = {k: PlainMarkov([(f, n) for (kind, f), n in forms.items() if kind == k and f not in aside], urls.ORDER) for k in ("allow", "block")}

    def margin(form):
        return (markov["allow"].log_likelihood(form) - markov["block"].log_likelihood(form)) / len(form) if form else 0.0

    held = [(margin(f), k, n) for (k, f), n in forms.items() if f in aside]

    def right(cut):
        return sum(sum(n for m, kind, n in held if kind == k and (m >= cut) == (k == "allow")) / sum(n for _, kind, n in held if kind == k) for k in ("allow", "block"))

    assert right(model.threshold) >= max(right(math.floor(m / urls.BIN) * urls.BIN) for m, _, _ in held) - 1e-9
    want = []
    for i, host, path, rule, kind, form in plain:
        m = None if kind else margin(form)
        want.append((i, host, path, rule, kind or ("allow" if m >= model.threshold else "block"), m))
    order = lambda r: (str(r[0]), r[1])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert g[:5] == w[:5] and (g[5] is None) == (w[5] is None) and (w[5] is None or abs(g[5] - w[5]) < 1e-9), (g, w)


def test_url_models_on_urls_put_aside(spark, judged):
    _, looked, model, _ = judged
    aside = looked.where(F.pmod(F.xxhash64("form", F.lit("aside")), F.lit(urls.ASIDE)) == 0).where("kind is not null and form <> ''")
    found = aside.join(urls.margins(aside, model), "form").collect()
    right = {k: [(r.margin >= model.threshold) == (k == "allow") for r in found if r.kind == k] for k in urls.KINDS}
    assert all(len(v) > 3 and np.mean(v) > 0.8 for v in right.values())


def test_url_tables_without_rows_or_decisions(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(none).collect() == []
    odd = spark.createDataFrame([(1, None), (2, "http://a.shop/x")], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict, r.margin) for r in urls.filter_urls(odd).collect()) == [(1, None, "allow", 0.0), (2, None, "allow", 0.0)]


def test_url_cut():
    assert urls.best_cut([]) == urls.best_cut([(3, 1.0, 0.0)]) == 0.0
    assert urls.best_cut([(-5, 0, 4.0), (4, 2.0, 0)], 1.0) == 0.0
    assert urls.best_cut([(2, 0, 4.0), (6, 2.0, 0)], 1.0) == 4.5
    assert urls.best_cut([(2, 1.0, 0), (6, 0, 2.0)], 1.0) == 2.0


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in q.op6_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in labels if got[i].held_out]
    right = {k: [got[i].predicted == k for i in held if labels[i] == k] for k in (0, 1)}
    assert np.mean(right[1]) > 0.98 and np.mean(right[0]) > 0.9


def test_quality_learns_from_an_id_once_a_label(spark):
    ids = spark.range(100).where(~quality.held_out("id")).orderBy("id").limit(16).collect()
    texts = [(r.id, f"text {'words ' * (i + 1)}{r.id}") for i, r in enumerate(ids)]
    docs = spark.createDataFrame(texts * 20 + texts[:1] * 100, "doc_id long, text string")
    labels = spark.createDataFrame([(r.id, i % 2) for i, r in enumerate(ids)] + [(ids[0].id, 0)] * 100, "doc_id long, quality int")
    plain = quality.train(docs.distinct(), labels.distinct())
    for sample in (16, 400):
        model = quality.train(docs, labels, sample=sample)
        assert model is not None and np.allclose(model.centre, plain.centre) and abs(model.offset - plain.offset) < 1e-9
    several = docs.unionByName(docs.select("doc_id", F.concat(F.col("text"), F.lit(" more")).alias("text")))
    assert quality.train(several, labels, sample=16) is not None


def plain_scores(x, y, at):
    """A quadratic discriminant by densities and plain inverses; the tempering fitted by gradient steps of its own."""
    centre, scale = x.mean(0), x.std(0) + 1e-6
    fix = lambda v: np.clip((v - centre) / scale, -12, 12)
    z = fix(x)
    n = len(z[0])
    own = {k: sum(np.outer(r, r) for r in z[y == k] - z[y == k].mean(0)) / (y == k).sum() for k in (0, 1)}
    pooled = sum((y == k).mean() * own[k] for k in (0, 1))
    log_density = []
    for k in (0, 1):
        c = 0.8 * own[k] + 0.2 * pooled
        c = 0.98 * c + 0.02 * np.trace(c) / n * np.eye(n) + 1e-9 * np.eye(n)
        inverse, size = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        m = z[y == k].mean(0)
        log_density.append(lambda v, i=inverse, s=size, m=m, k=k: np.array([-0.5 * (r - m) @ i @ (r - m) - 0.5 * s + np.log((y == k).mean()) for r in fix(v)]))
    margin = lambda v: log_density[1](v) - log_density[0](v)
    m = np.clip(margin(x), -200, 200)

    def loss(a, b):
        return np.logaddexp(0, -(2 * y - 1) * (a * m + b)).sum() + 0.5e-2 * (a * a + b * b)

    return margin(at), loss


def test_quality_against_plain_discriminant(spark):
    rng = random.Random(8)
    words = ["river", "Mountain", "and", "the", "of", "blue", "12", "house.", "(see)", "walks"]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 90))) for _ in range(60)]
    bad = ["\n".join([rng.choice(["BUY", "now!!", "$$$", "click", "http"]) * rng.randrange(1, 4)] * rng.randrange(3, 40)) + rng.choice(["", " and the river"]) for _ in range(60)]
    mixed = [a[:30] + b[:60] for a, b in zip(good, bad)]
    texts = [*good, *bad, *mixed, "", "one"]
    x = np.array([quality.statistics(t) for t in texts])
    y = np.array([1] * 60 + [0] * 60 + [rng.randrange(2) for _ in mixed])
    model = quality.fit(x[: len(y)], y)
    margins, loss = plain_scores(x[: len(y)], y, x)
    assert np.allclose(model.margins(x), margins, rtol=1e-6, atol=1e-6)
    here = loss(model.temper, model.bias)
    assert all(here <= loss(model.temper * (1 + a), model.bias + b) + 1e-6 for a in (-0.02, 0, 0.02) for b in (-0.02, 0, 0.02))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in quality.score(docs, model).orderBy("doc_id").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-np.clip(model.temper * margins + model.bias, -700, 700))), atol=1e-6)


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} in a row of text", 0.5) for i in range(40)] + [(100 + i, "BUY!!! " * (9 + i), 0.5) for i in range(40)] + [(None, None, None), (7, "", None), (200, "long " * 200_000, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(0, None), (None, 1), (3, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 83 and all(0 <= r.score <= 1 for r in got) and sorted(docs.columns) == sorted(got[0].asDict())
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).collect() == []


def plain_mix(rows, targets, budget, rounds):
    cells = {}
    for s, l, t, n in rows:
        cells[s, l, t] = cells.get((s, l, t), 0) + n
    total = sum(cells.values())
    want = []
    for axis, name in enumerate(("source", "lang", "topic")):
        sums = {}
        for k, n in cells.items():
            sums[k[axis]] = sums.get(k[axis], 0) + n
        wanted = targets.get(name, 1.0)
        raw = {k: wanted.get(k, n / total) if isinstance(wanted, dict) else (n / total) ** wanted for k, n in sums.items()}
        want.append({k: v / sum(raw.values()) for k, v in raw.items()})
    w = dict(cells)
    for _ in range(rounds):
        for axis in range(3):
            sums = {}
            for k, v in w.items():
                sums[k[axis]] = sums.get(k[axis], 0) + v
            w = {k: v * want[axis][k[axis]] / sums[k[axis]] for k, v in w.items()}
    whole = set()
    while True:  # cells that would exceed 1 are taken whole
        rest = [k for k in cells if k not in whole]
        scale = (budget * total - sum(cells[k] for k in whole)) / sum(w[k] for k in rest) if rest else 0
        over = {k for k in rest if scale * w[k] / cells[k] > 1 + 1e-12}
        if not over:
            break
        whole |= {max(over, key=lambda k: w[k] / cells[k])}
    return w, {k: 1.0 if k in whole else min(1.0, scale * w[k] / cells[k]) for k in cells}, total


def test_mixing_against_plain_raking(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "a", "a", "b", "c"]), rng.choice([None, "en", "en", "de"]), " ".join(["w"] * rng.choice([1, 50, 130, 400, 900]))) for i in range(900)] + [(None, "a", "en", None), (5, "b", "de", "")]
    docs = spark.createDataFrame([(a, b, c, d, 1, 2.0) for a, b, c, d in rows], "doc_id long, source string, lang string, text string, n_tokens int, weight double")
    targets = {"source": {"a": 0.2, "b": 0.5}, "lang": 0.5}
    got = mixing.mix(docs, targets, 0.4).collect()
    assert len(got) == len(rows)
    w, p, total = plain_mix([(r.source, r.lang, r.topic, r.n_tokens) for r in got], targets, 0.4, 200)
    for r in got:
        key = (r.source, r.lang, r.topic)
        assert abs(r.p - p[key]) < 1e-9 and r.kept == (plain_draw(r.doc_id) < r.p)
    assert abs(sum(r.p * r.n_tokens for r in got) / total - 0.4) < 1e-9
    kept = sum(r.p * r.n_tokens for r in got)
    for axis in mixing.AXES:
        for k in {r[axis] for r in got}:
            mine = [r for r in got if r[axis] == k]
            assert abs(sum(w[c] for c in w if c[mixing.AXES.index(axis)] == k) / sum(w.values()) - mine[0][f"target_{axis}"]) < 1e-8
            assert abs(sum(r.p * r.n_tokens for r in mine) / kept - mine[0][f"expected_{axis}"]) < 1e-9
    drawn = mixing.sample(docs, targets, 0.4)
    assert drawn.columns == docs.columns
    assert sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert mixing.mix(docs.where("false"), targets, 0.4).collect() == [] and mixing.sample(docs.where("false"), targets).collect() == []


def test_mixing_targets_that_contradict_each_other(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x y"), (2, "b", "de", "x y"), (3, "b", "de", "w " * 500)], "doc_id long, source string, lang string, text string")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}, "topic": {"note": 0.3, "article": 0.7}}
    cells = mixing.rake(mixing.tokens(docs, F.col("source"), F.col("lang")), targets).collect()
    share = {k: sum(r.w for r in cells if r.topic == k) for k in ("note", "article")}
    assert abs(share["note"] - 0.3) < 1e-9 and abs(share["article"] - 0.7) < 1e-9 and len(cells) == 3
    assert all(0 <= r.p <= 1 for r in mixing.mix(docs, targets, 0.5).collect())


def test_mixing_factors_as_tables(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(40)}", rng.choice(["en", "de"]), rng.choice(["a", "b"]), rng.randrange(1, 90)) for _ in range(500)]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    targets = {"source": 0.5, "lang": {"en": 0.3, "de": 0.7}}
    w = {k: {(r.source, r.lang, r.topic): r.w for r in mixing.rake(df, targets, few=k).collect()} for k in (200, 1)}
    assert all(abs(w[k][c] - w[200][c]) < 1e-12 for k in (1,) for c in w[200]) and abs(sum(w[200].values()) - 1) < 1e-9


def test_mixing_very_long_and_equal_texts(spark):
    docs = spark.createDataFrame([(1, "a", "en", "w " * 500_000), (2, "a", "en", "w " * 500_000), (2, "a", "en", "w " * 500_000), (3, "b", "en", "\t")], "doc_id long, source string, lang string, text string")
    got = mixing.mix(docs, {}, 0.4).collect()
    assert sorted(r.n_tokens for r in got) == [1, 500_000, 500_000, 500_000] and all(abs(r.p - 0.4) < 1e-12 for r in got)


def plain_draw(doc_id, seed=7):
    import hashlib

    text = str(seed) if doc_id is None else f"{seed}:{doc_id}"
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
