"""Places in an order, the stored index, fences, the driver's tokenizer and site rules."""

import random

from pyspark.sql import functions as F

from quarry.functions import sites
from quarry.functions import text as tx
from quarry.operators import collection as co
from quarry.operators import index as ix
from quarry.sources.shared import built_once, files_version, numbered


def test_places_of_skewed_and_empty_tables(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "a", "a", "b", "ü"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(7)
    got = sorted((r.n, r.k, r.i) for r in numbered(df, [F.col("k").desc(), "i"]).collect())
    want = sorted(rows, key=lambda r: r[1])
    want = sorted(want, key=lambda r: (r[0] is not None, (r[0] or "").encode()), reverse=True)
    assert [g[0] for g in got] == list(range(3000)) and [(k, i) for _, k, i in got] == want
    assert numbered(df.where("false"), ["k"]).collect() == []


def test_ranks_by_group(spark):
    rows = [("x", "a", 5), ("x", "b", 5), ("x", "c", 9), (None, "a", 1), ("y", "z", 2)]
    got = {(r.group, r.term): (r.rank, r.relative_frequency) for r in ix.ranked(spark.createDataFrame(rows, "group string, term string, frequency long")).collect()}
    assert got == {("x", "c"): (1, 9 / 19), ("x", "a"): (2, 5 / 19), ("x", "b"): (3, 5 / 19), (None, "a"): (1, 1.0), ("y", "z"): (1, 1.0)}


def test_gaps_over_chunks(spark):
    rows = [("t", i, 1) for i in (3, 4, 700, 90_000, 90_001, 5_000_000)] + [("u", 9, 2)]
    df = spark.createDataFrame(rows, "term string, doc_id long, tf long")
    want = sorted(map(tuple, ix.codec_sizes(df).collect()))
    assert want == [("t", 6, 48, 1 + 1 + 2 + 3 + 1 + 4, 0), ("u", 1, 8, 1, 0)]
    assert all(sorted(map(tuple, ix.codec_sizes(df, chunk=c).collect())) == want for c in (1, 10, 1000))


def test_an_index_is_built_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    version = files_version(spark, str(tmp_path / "t"))
    calls = []

    def build(path):
        calls.append(path)
        spark.range(3).write.parquet(f"{path}/part")

    first, second = built_once(spark, f"test-{version}", build), built_once(spark, f"test-{version}", build)
    assert first == second and len(calls) == 1 and spark.read.parquet(f"{first}/part").count() == 3
    spark.range(6).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert files_version(spark, str(tmp_path / "t")) != version


def test_tokens_on_the_driver(spark):
    rng = random.Random(7)
    parts = ["S.T.A.L.K.E.R.", "c++17", "C#", "v1.2.3", "é", "ſ", "İ", "x-ray", "l’été", "Ё", ".", " ", "a.b.c.", "́", "ÀÖ", "ŉ", "-", "'", "9.9", "×", "日", "🙂", "ß", "ſ.S.t."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(800)] + [chr(c) + "x" for c in range(0x2100)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.tokenize(F.col("t")).alias("w")).collect()
    assert all(tx.tokens_of(texts[r.i]) == r.w for r in got)


def test_fences(spark):
    frontier = spark.createDataFrame([("a", "in_progress", "t1"), ("b", "in_progress", None), ("c", "done", "t1")], "url string, state string, lease_token string")
    answers = spark.createDataFrame([("a", "t1"), ("a", "t0"), ("b", None), ("c", "t1"), ("d", "t1"), (None, "t1")], "url string, lease_token string")
    got = [(r.url, r.lease_token, r.verdict) for r in co.fenced(answers, frontier).collect()]
    assert sorted(got, key=str) == sorted([("a", "t1", "accepted"), ("a", "t0", "lost lease"), ("b", None, "lost lease"), ("c", "t1", "no lease"), ("d", "t1", "unknown"), (None, "t1", "unknown")], key=str)
    raw = spark.createDataFrame([("a", 2)], "url string, generation long")
    results = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("z", 1), ("a", None)], "url string, generation long")
    assert sorted((str(r.url), str(r.generation), r.verdict) for r in co.fence_generations(results, raw).collect()) == [("a", "1", "superseded"), ("a", "2", "current"), ("a", "3", "unknown"), ("a", "None", "unknown"), ("z", "1", "unknown")]


def test_maps_that_loop_and_nest_deeply(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(45)] + [(45, 0), (3, 3), (7, 2)], "parent long, url long")
    got = {r.url: r.depth for r in co.expand_sitemaps(spark.createDataFrame([(0,)], "url long"), links).collect()}
    assert got == {i: i for i in range(46)}
    assert co.expand_sitemaps(spark.createDataFrame([], "url long"), links).collect() == []


def test_site_rules_on_plain_pages():
    page = '<h1> T <b>x</b></h1><article class="reviews-details"><div class="content-row__section">one</div><div class="content-row__center--lg"><div class="content-row__section">two</div></div><div class="content-row__center--lg js-comment-section">no</div></article>'
    got = sites.parse_article(page, sites.SITES["gamemag"], "https://gamemag.ru/reviews/1")
    assert (got["title"], got["text"], got["category"], got["parse_error"]) == ("T x", "one\n\ntwo", "review", None)
    gallery = '<div id="gallery-body"><p class="gallery-image"><i class="gallery-text">same</i></p><p class="gallery-image"><i class="gallery-text">same</i></p></div>'
    assert sites.parse_article(gallery, sites.SITES["pcgamer"])["text"] == "same"
    assert sites.parse_article('<h1>t</h1><div class="article-content"><img src="x"></div>', sites.SITES["playground"])["parse_error"] is None
    assert sites.parse_article('<h1>t</h1><div class="article-content"></div>', sites.SITES["playground"])["parse_error"] == "no body"
    data = '<script type="application/ld+json">{"@type": "NewsArticle", "headline": "H", "author": [{"name": "A"}, {"name": "B"}], "keywords": "k, k,l", "about": {"name": "G"}}</script><article class="h-entry"><p class="e-content">text</p></article>'
    got = sites.parse_article(data, sites.SITES["gamingonlinux"])
    assert (got["title"], got["author"], got["category"], got["tags"], got["games"]) == ("H", "A, B", "news", ["k", "l"], ["G"])
    deep = "<div>" * 50_000 + "x" + "</b>" * 50_000
    assert sites.text_of(sites.tree(deep)) == "x"
    assert sites.parse_article(None, sites.Site())["parse_error"] == "no title and no text"
