"""Query language, Boolean, phrase and ranked search, lemmas: golden values and independent recomputation."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import index as ix
from quarry.operators import snippet as sn
from quarry.plans import search as se
from quarry.plans.language import And, Not, Or, QueryError, Term, lex, parse, true_for_nothing

PHRASES = [(3, "Doom", "Eternal game"), (8, "Doom Eternal", "red blue red red blue"), (42, "", "doom amazing eternal blue red игры стали"), (100, "doom eternal", "игрой сталь"), (5000000000, "", "doom eternal doom eternal game Игры стать")]
PAIRS = [("ru:игра", "игра"), ("ru:игры", "игра"), ("ru:играми", "игра"), ("ru:игрой", "игра"), ("ru:стали", "сталь"), ("ru:стали", "стать"), ("ru:ёлки", "ёлка"), ("n:game", "game"), ("n:child", "child"), ("n:saw", "saw"), ("v:see", "see"), ("v:play", "play"), ("v:make", "make"), ("a:good", "good"), ("a:fast", "fast"), ("x:n:children", "child"), ("x:v:saw", "see"), ("x:a:better", "good"), ("n:window", "window")]


class Space:
    def __init__(self, spark, rows, pairs=()):
        self.spark = spark
        self.corpus = spark.createDataFrame(rows, "doc_id long, title string, body string")
        self.tokens = tx.tokens(self.corpus).cache()
        self.postings = ix.postings(self.tokens).cache()
        self.norms = ix.norms(self.postings)
        self.n = self.corpus.count()

    def ids(self, query, **more):
        args = (query, self.spark, self.postings, self.tokens, self.corpus)
        got = sorted(r.doc_id for r in se.boolean_search(*args, **more).collect())
        assert got == sorted(r.doc_id for r in se.search_by_sets(*args, **more).collect())
        return got

    def ranked(self, query, limit=10, **more):
        rows = se.ranked_search(query, self.spark, self.postings, self.norms, self.tokens, self.n, limit, **more).collect()
        return [r.doc_id for r in rows], {r.doc_id: r.score for r in rows}, rows[0].total if rows else 0


@pytest.fixture(scope="module")
def phrases(spark):
    return Space(spark, PHRASES)


def test_parser():
    words = lambda t: t.lower().split()
    tree, operands = parse('a OR b AND NOT "c d"', words)
    assert tree == Or((Term(0, ("a",)), And((Term(1, ("b",)), Not(Term(2, ("c", "d"))))))) and len(operands) == 3
    assert parse("a|b&!c", words)[0] == parse("a OR b AND NOT c", words)[0]
    assert lex("and AND") == [("word", "and"), ("and", "AND")]
    for bad in ("", "a b", "a AND", "(a", "a)", '"a', '""', "NOT", "OR a", "a" * 9000, " OR ".join(["a"] * 65), "(" * 70 + "a" + ")" * 70, "! " * 1100 + "a"):
        with pytest.raises(QueryError):
            parse(bad, words)
    with pytest.raises(QueryError):
        parse("foo/bar", lambda t: t.split("/"))
    assert true_for_nothing(parse("NOT a", words)[0]) and not true_for_nothing(parse("a AND NOT b", words)[0])
    assert parse(" OR ".join(f"w{i}" for i in range(64)), words)[1][-1].bit == 63


@pytest.mark.parametrize(
    "query,ids",
    [("doom AND eternal", [3, 8, 42, 100, 5000000000]), ('"doom eternal"', [8, 100, 5000000000]), ('"eternal doom"', [5000000000]), ('"red red"', [8]), ('"red blue red"', [8]), ('"blue red"', [8, 42]), ('"red red red"', []), ('"doom absent"', []), ('"doom eternal" AND game', [5000000000]), ('NOT "doom eternal"', [3, 42]), ('"doom eternal" OR "blue red"', [8, 42, 100, 5000000000])],
)
def test_phrases(phrases, query, ids):
    assert phrases.ids(query) == ids


def test_truth_table(spark):
    ids = [3, 12, 45, 100, 1000, 2000, 4000, 5000000000]
    s = Space(spark, [(i, "", " ".join(w for k, w in enumerate("abc") if m >> k & 1)) for m, i in enumerate(ids)])
    holds = lambda m, w: m >> "abc".index(w) & 1
    for x, y, z in itertools.product("abc", repeat=3):
        want = [i for m, i in enumerate(ids) if (holds(m, x) or not holds(m, y)) and holds(m, z)]
        got = sorted(r.doc_id for r in se.boolean_search(f"({x} OR NOT {y}) AND {z}", spark, s.postings, s.tokens, s.corpus).collect())
        assert got == want
    assert s.ids("a OR b AND NOT c") == [i for m, i in enumerate(ids) if m & 1 or (m & 2 and not m & 4)]
    assert s.ids("NOT absent") == sorted(ids) and s.ids("NOT (a OR b OR c)") == [3] and s.ids("NOT NOT a") == [i for m, i in enumerate(ids) if m & 1]


def test_sixty_four_operands(spark):
    s = Space(spark, [(1, "", "w63"), (2, "", "w0 w63"), (3, "", "none")])
    query = " OR ".join(f"w{i}" for i in range(63)) + " OR w63"
    assert s.ids(query) == [1, 2]


def test_first_hits_count_all(spark, phrases):
    hits = se.boolean_search("doom", spark, phrases.postings, phrases.tokens, phrases.corpus)
    rows = se.first_hits(hits, phrases.corpus, 2, ("title",)).collect()
    assert sorted((r.doc_id, r.title, r.total) for r in rows) == [(3, "Doom", 5), (8, "Doom Eternal", 5)]
    with pytest.raises(QueryError):
        se.first_hits(hits, phrases.corpus, 0, ())


def test_ranked(spark):
    big = (1 << 63) - 1
    s = Space(spark, [(3, "car", "insurance auto insurance common"), (19, "car", "car common"), (5000000000, "insurance", "best rare common"), (big - 1, "car", "car common"), (big, "", "")])
    order, score, total = s.ranked("car")
    assert order == [19, big - 1, 3] and total == 3
    assert abs(score[3] - 1 / math.sqrt(3 + (1 + math.log10(2)) ** 2)) < 1e-9
    assert s.ranked("unknown")[0] == [] and s.ranked('"common car"')[0] == [] and s.ranked('"car insurance"')[0] == []
    assert s.ranked('"car common"')[0] == [19, big - 1] and s.ranked('"insurance auto" car')[0] == [3]
    allowed = s.corpus.where("doc_id <> 19").select("doc_id")
    assert s.ranked("car", allowed=allowed)[0] == [big - 1, 3] and s.ranked("car", 1)[2] == 3
    with pytest.raises(QueryError):
        s.ranked('a "b')


def test_ranked_equals_recomputed_cosine(spark):
    import random

    rng = random.Random(8)
    rows = [(i, "", " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(12)))) for i in range(300)]
    s = Space(spark, rows)
    docs = {i: {w: b.split().count(w) for w in b.split()} for i, _, b in rows}
    query = {"a": 2, "bb": 1, "c": 1}
    df = {w: sum(w in d for d in docs.values()) for w in query}
    weight = {w: (1 + math.log10(n)) * math.log10(300 / df[w]) for w, n in query.items()}
    want = {}
    for i, d in docs.items():
        dot = sum((1 + math.log10(d[w])) * weight[w] for w in query if w in d)
        if dot > 0:
            want[i] = dot / math.sqrt(sum((1 + math.log10(n)) ** 2 for n in d.values())) / math.sqrt(sum(x * x for x in weight.values()))
    order, score, total = s.ranked("a bb c a", 1000)
    assert total == len(want) and all(abs(score[i] - want[i]) < 2e-9 for i in want)
    assert order == sorted(order, key=lambda i: (-score[i], i))


def test_lemmas(spark):
    d = ix.dictionary(spark.createDataFrame(PAIRS, "key string, lemma string"))
    want = {
        "игры": (["игра"], True), "стали": (["сталь", "стать"], True), "елки": (["елки"], False), "ёлки": (["ёлка"], True), "games": (["game"], True), "playing": (["play"], True), "played": (["play"], True), "making": (["make"], True),
        "fastest": (["fast"], True), "xyzings": (["xyzings"], False), "children": (["child"], True), "better": (["good"], True), "saw": (["saw", "see"], True), "ps5": (["ps5"], False), "c++": (["c++"], False), "half-life": (["half-life"], False), "s": (["s"], False),
    }
    got = ix.lemmatize(spark.createDataFrame([(w,) for w in want], "term string"), d).collect()
    assert {r.term: (list(r.lemmas), r.known) for r in got} == want


def test_lemma_space(spark, phrases):
    d = ix.dictionary(spark.createDataFrame(PAIRS, "key string, lemma string"))
    lem = ix.lemmatize(phrases.tokens.select("term").distinct(), d)
    lt = ix.lemma_tokens(phrases.tokens, lem).cache()
    asked = {r.term: list(r.lemmas) for r in lem.collect()}
    hits = se.boolean_search('"игры стали"', spark, ix.postings(lt), lt, phrases.corpus, lemmas=asked)
    assert sorted(r.doc_id for r in hits.collect()) == [42, 100, 5000000000]


def test_diagnostic_modes(spark):
    s = Space(spark, [(1, "release window", ""), (2, "Windows 10", "")])
    d = ix.dictionary(spark.createDataFrame([("n:window", "window")], "key string, lemma string"))
    lem = ix.lemmatize(s.tokens.select("term").distinct(), d)
    rows = se.diagnostic_search(spark.createDataFrame([("q", "windows")], "query_id string, term string"), s.tokens, ix.lemma_tokens(s.tokens, lem), lem).collect()
    ids = lambda mode: [r.doc_id for r in sorted(rows, key=lambda r: r.rank) if r.mode == mode]
    assert ids("exact") == [2] and ids("lemma") == [1, 2] and ids("hybrid") == [2, 1]


def test_zipf(spark):
    rows = [(1, "one", "Games games", "Игра игра игры"), (2, "two", "Games", "Game game C++ C#")]
    t = tx.tokens(spark.createDataFrame(rows, "doc_id long, source string, title string, body string"), keep=("source",))
    ranked = ix.ranked(ix.group_frequencies(t, {"source": "source"}))
    top = [(r.term, r.frequency, r.relative_frequency) for r in ranked.where("group = 'all'").orderBy("rank").collect()]
    assert top[:4] == [("games", 3, 0.3), ("game", 2, 0.2), ("игра", 2, 0.2), ("c#", 1, 0.1)]
    s = ix.zipf_statistics(ranked).where("group = 'all'").first()
    assert (s.tokens, s.vocabulary, s.hapax, s.top_frequency, s.alpha, s.r2) == (10, 6, 3, 3, None, None)
    counts = spark.createDataFrame([("all", w, n) for w, n in zip("abcde", (60, 30, 20, 15, 12))], "group string, term string, frequency long")
    f = ix.zipf_statistics(ix.ranked(counts), 1, 5).first()
    assert abs(f.alpha - 1) < 1e-9 and abs(f.power_c - 60) < 1e-6 and abs(f.r2 - 1) < 1e-9
    flat = spark.createDataFrame([("all", w, 5) for w in "abc"], "group string, term string, frequency long")
    g = ix.zipf_statistics(ix.ranked(flat), 1, 5).first()
    assert abs(g.alpha) < 1e-12 and g.r2 is None
    assert ix.curve_ranks(3) == [1, 2, 3] and ix.curve_ranks(1000)[-1] == 1000 and len(set(ix.curve_ranks(10**6))) == len(ix.curve_ranks(10**6))


def test_snippets():
    terms = sn.groups(["doom", "eternal"], boolean=True)
    text, spans, left, right = sn.snippet("Первый абзац.\nDoom Eternal is fast. Doom again.\nДругой блок", terms)
    assert text == "Doom Eternal is fast. Doom again." and [text.encode()[a:b].decode() for a, b in spans] == ["Doom", "Eternal", "Doom"] and not left and not right
    assert sn.snippet("", terms)[0] == "" and sn.snippet(" \n ", terms)[0] == ""
    long = "x" * 800 + " Ёж и Doom"
    text, spans, left, right = sn.snippet(long, terms)
    assert len(text.encode()) <= 600 and left and not right and text.endswith("Doom")
    text, spans, left, right = sn.snippet("l" * 700 + " контекст " + "r" * 700, sn.groups(["контекст"]))
    assert left and right and len(text.encode()) <= 600 and [text.encode()[a:b].decode() for a, b in spans] == ["контекст"]
    assert sn.snippet("One here. Two there.", {})[0] == "One here."
    assert sn.groups(["a", "and", "b"], boolean=True) == {"a": 1, "b": 2}
    assert sn.marked("a <b> c", [(2, 5)]) == "a <mark>&lt;b&gt;</mark> c"


def test_index_checks_find_faults(spark, phrases):
    p, docs = phrases.postings, phrases.corpus.select("doc_id")
    v = ix.vocabulary(p)
    clean = {r.check: r.violations for r in ix.verify(p, v, docs, phrases.norms).collect()}
    assert len(clean) == 6 and not any(clean.values())
    broken = p.unionByName(spark.createDataFrame([("doom", 3, 0), ("new", 77, 1)], "term string, doc_id long, tf long"))
    bad = {r.check: r.violations for r in ix.verify(broken, v, docs, phrases.norms).collect()}
    assert bad["duplicate postings"] == 1 and bad["unknown documents"] == 1 and bad["postings without frequency"] == 1 and bad["wrong document frequency"] == 2 and bad["norms missing"] == 1


def test_written_index_prunes_terms(spark, phrases, tmp_path):
    ix.write_index(phrases.corpus, str(tmp_path / "i"), buckets=3)
    p = spark.read.parquet(str(tmp_path / "i/postings"))
    assert p.count() == phrases.postings.count()
    plan = p.where("term = 'doom'")._jdf.queryExecution().toString()
    assert "EqualTo(term,doom)" in plan
    with pytest.raises(Exception):
        ix.write_index(phrases.corpus, str(tmp_path / "i"))


def test_codec_sizes_and_front_coding(spark):
    p = spark.createDataFrame([("a", i * 200, 1) for i in range(1, 301)] + [("b", 5, 1)], "term string, doc_id long, tf long")
    got = {r.term: r for r in ix.codec_sizes(p).collect()}
    assert got["a"].df == 300 and got["a"].gap_bytes == 600 and got["a"].skips == math.ceil(300 / 18) - 1 and got["b"].gap_bytes == 1 and got["b"].skips == 0
    words = ["ab", "abc", "abd", "b", "abdé", "xyz"]
    rows = ix.front_coding(spark.createDataFrame([(w,) for w in words], "term string")).orderBy("term").collect()
    before = ""
    for r in rows:
        assert before[: r.shared] + r.suffix == r.term
        before = r.term
    assert max(r.shared for r in rows) == 3
