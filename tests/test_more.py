"""Checked joins, repairs, archives, dictionaries, batches and per-site parsing."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import sites
from quarry.functions import text as tx
from quarry.operators import collection as co
from quarry.operators import index as ix
from quarry.plans import batch
from quarry.sources import corpus as so


def test_zip_checked(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, a string")
    b = spark.createDataFrame([(2, "v"), (1, "u")], "id long, b string")
    assert sorted(map(tuple, co.zip_checked(a, b, "id").collect())) == [(1, "x", "u"), (2, "y", "v")]
    for bad in (b.where("id = 1"), b.unionByName(b), b.unionByName(spark.createDataFrame([(3, "w")], "id long, b string"))):
        with pytest.raises(Exception):
            co.zip_checked(a, bad, "id").collect()


def test_archive_eviction_and_restore(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "<a>"), ("u2", "<b>")], "url string, html string")
    so.write_archive(pages, str(tmp_path / "a"))
    archived = spark.read.parquet(str(tmp_path / "a"))
    live = spark.createDataFrame([("u1", "<a>"), ("u2", "<changed>")], "url string, html string")
    got = {r.url: (r.html, r.archive_ref is not None) for r in co.evict(archived, live).collect()}
    assert got == {"u1": (None, True), "u2": ("<changed>", False)}
    assert tuple(co.restore_sample(archived, live, 1000).first()) == (2, 1)


def test_url_repair_is_idempotent(spark):
    f = spark.createDataFrame([("s/news/1", "done"), ("s/newsdata/2", "done"), ("s/news/2", "pending"), ("s/x", "retry")], "url string, state string")
    rewrite = F.regexp_replace("url", "/news/", "/newsdata/")
    fixed, report = co.repair_urls(f, rewrite)
    assert {r.change: r.n for r in report.collect()} == {"kept": 2, "moved": 1, "excluded": 1}
    rows = sorted(map(tuple, fixed.collect()))
    assert rows == [("s/news/2", "excluded"), ("s/newsdata/1", "done"), ("s/newsdata/2", "done"), ("s/x", "retry")]
    assert sorted(map(tuple, co.repair_urls(fixed, rewrite)[0].collect())) == rows
    hits = spark.createDataFrame([("a", "a"), ("b", "http://x/news"), ("c", "http://x/y/z")], "url string, final_url string")
    from quarry.functions.web import is_listing

    assert [r.url for r in co.listing_redirects(hits, is_listing(F.col("final_url"))).collect()] == ["b"]


def test_dictionary_sources(spark, tmp_path):
    for name in ("noun", "verb", "adj", "adv"):
        (tmp_path / f"index.{name}").write_text("  1 licence\n" + {"noun": "game n 1\nice_age n 1\n", "verb": "see v 1\n"}.get(name, ""))
        (tmp_path / f"{name}.exc").write_text({"verb": "saw see\n", "noun": "dice die dice\n"}.get(name, ""))
    assert sorted(map(tuple, so.read_wordnet_pairs(spark, str(tmp_path)).collect())) == [("n:game", "game"), ("v:see", "see"), ("x:n:dice", "dice"), ("x:n:dice", "die"), ("x:v:saw", "see")]
    (tmp_path / "lex.xml").write_text('<dictionary><lemmata><lemma id="1"><l t="игра"/><f t="игра"/><f t="Игры"/></lemma><lemma id="2"><l t="x1"/><f t="x1"/></lemma></lemmata></dictionary>')
    assert sorted(map(tuple, so.read_lexicon_xml(spark, str(tmp_path / "lex.xml")).collect())) == [("ru:игра", "игра"), ("ru:игры", "игра")]
    d = ix.dictionary(so.read_wordnet_pairs(spark, str(tmp_path)))
    assert {r.key: list(r.lemmas) for r in d.collect()}["x:n:dice"] == ["dice", "die"]
    with pytest.raises(Exception):
        ix.dictionary(spark.createDataFrame([("k", f"l{i}") for i in range(65)], "key string, lemma string")).collect()


def test_snapshots_and_validation(spark):
    m = spark.createDataFrame([("a", 1), ("c", 3), ("b", 3)], "path string, created_at long")
    assert so.latest_snapshot(m).first().path == "c"
    s = spark.createDataFrame([("ok_1",), ("Bad",), (None,), ("x" * 65,)], "s string")
    assert [r[0] for r in s.select(so.valid_source("s")).collect()] == [True, False, False, False]
    assert s.select(so.valid_text("s").alias("t")).where("s = 'ok_1'").first().t == "ok_1"
    with pytest.raises(Exception):
        spark.sql("select cast(x'ff41' as string) as s").select(so.valid_text("s")).collect()


def test_batches_and_responses(spark):
    c = spark.createDataFrame([(1, "A", "red blue"), (2, "B <x>", "red"), (3, "C", "blue red green")], "doc_id long, title string, body string")
    t = tx.tokens(c)
    p = ix.postings(t)
    q = spark.createDataFrame([("q1", "blue RED blue"), ("q2", "absent red"), ("q3", "!!"), ("q4", "red")], "query_id string, text string")
    assert sorted(map(tuple, batch.conjunctive(q, p).collect())) == [("q1", 1), ("q1", 3), ("q4", 1), ("q4", 2), ("q4", 3)]
    got = [json.loads(x) for x in batch.respond(["red AND blue", "red blue", "absent"], spark, c, p, t, 1)]
    assert got[0]["total"] == 2 and [r["id"] for r in got[0]["results"]] == [1] and "error" in got[1] and got[2]["total"] == 0
    page = batch.result_page('<q>"', [{"id": 1, "title": "<t>", "url": "javascript:x", "snippet": "a <b>", "snippet_matches": [(0, 1)]}, {"id": 2, "title": "t", "url": "http://x/?a&b"}], 2)
    assert "<q>" not in page and "&lt;t&gt;" in page and "javascript" not in page and "<mark>a</mark> &lt;b&gt;" in page and 'href="http://x/?a&amp;b"' in page


def test_site_parsers(spark):
    body = " ".join(["слово"] * 40)
    page = f"<html><head><title>Заголовок — Сайт</title></head><body><div class='menu'>menu</div><div class='post body'><p>{body}</p><div class='share'>share<br>it</div><p>end</p></div><div>after</div></body></html>"
    rules = {"s": sites.Site(bodies=((sites.css("body"),),), noise=(sites.css("share"),), suffixes=(" — Сайт",))}
    df = spark.createDataFrame([("s", page), ("unknown", page), ("s", None)], "source string, html string")
    got = df.select(sites.parse_articles(F.col("source"), F.col("html"), rules).alias("p")).select("p.*").collect()
    assert got[0].title == "Заголовок" and got[0].text == f"{body}\n\nend" and got[0].parse_error is None
    assert got[1].title == "Заголовок — Сайт" and "menu" in got[1].text
    assert got[2].parse_error == "no title and no text"


def test_settings():
    from quarry.plans.settings import Settings

    assert Settings(("a", "b"), known=("a", "b", "c")).workers == 4
    for bad in ({"sources": ()}, {"sources": ("a", "a")}, {"sources": ("x",), "known": ("a",)}, {"sources": ("a",), "workers": 0}, {"sources": ("a",), "workers": True}, {"sources": ("a",), "lease": 10.0}, {"sources": ("a",), "timeout": -1.0}):
        with pytest.raises(ValueError):
            Settings(**bad)
