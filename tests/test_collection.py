"""Sources, sinks, web functions, collection operators and streams."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from quarry.functions import web
from quarry.operators import collection as co
from quarry.operators import statistics as st
from quarry.sources import corpus as so
from quarry.streaming import frontier as fr


def values(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column).collect()]


def test_canonical_urls(spark):
    cases = {
        "HTTPS://Example.COM?utm_source=x&a=1&FBCLID=2#top": "https://example.com/?a=1", "http://x.org/A/b?b=2&_ga=1&c": "http://x.org/A/b?b=2&c", "http://x.org/?utm_campaign=1": "http://x.org/", "nonsense": None, None: None,
    }
    assert values(spark, [(u,) for u in cases], "u string", web.canonical_url(F.col("u"))) == list(cases.values())
    assert values(spark, [("https://s.ru/news/12/x",)], "u string", web.alias_path(F.col("u"), "news", "newsdata")) == ["https://s.ru/newsdata/12/x"]


def test_listing_category_and_names(spark):
    urls = ["http://a.b/", "http://a.b/news", "http://a.b/news/x", "http://a.b/tag/x/y", "http://a.b/x/page/3", "http://a.b/reviews/z"]
    assert values(spark, [(u,) for u in urls], "u string", web.is_listing(F.col("u"))) == [True, True, False, True, True, False]
    assert values(spark, [(u,) for u in urls], "u string", web.category(F.col("u")))[1:3] == ["news", "news"]
    assert values(spark, [(urls[5],)], "u string", web.safe_name(F.col("u")))[0].startswith("reviews_z-")


def test_challenges_by_title_and_dom(spark):
    story = "<div class='article-content'><p>How a captcha works: access denied</div>"
    urls = "<?xml version='1.0'?><!-- captcha --> <urlset><url><loc>http://a.b/captcha</loc></url></urlset>"
    cases = [
        (200, story, "valid"), (200, "<script>var captcha = 1</script><p>hi", "valid"), (200, urls, "valid"), (503, urls, "server_error"), (206, "<p>hi", "valid"), (204, "", "empty"),
        (404, "<title>Just a moment...</title>", "anti_bot"), (429, "<form id='challenge-form'></form>" + story, "anti_bot"), (500, "<div class='h-captcha'></div>", "anti_bot"), (403, "<p>Access denied", "anti_bot"),
        (403, "<p>Access denied" + " word" * 700, "http_error"),
    ]
    assert values(spark, [c[:2] for c in cases], "s int, b string", web.response_class(F.col("s"), F.col("b"))) == [c[2] for c in cases]


def test_response_classes_and_retry(spark):
    cases = [(200, "<p>hi", "valid"), (200, " \n", "empty"), (200, "please solve the CAPTCHA", "anti_bot"), (404, "", "not_found"), (410, "", "not_found"), (429, "", "rate_limited"), (503, "", "server_error"), (302, "", "redirect"), (401, "", "http_error"), (None, None, "http_error")]
    assert values(spark, [c[:2] for c in cases], "s int, b string", web.response_class(F.col("s"), F.col("b"))) == [c[2] for c in cases]
    now = 1_700_000_000
    heads = [("120",), ("5",), ("Tue, 14 Nov 2023 22:23:20 GMT",), ("soon",), (None,)]
    assert values(spark, heads, "h string", web.retry_delay(F.col("h"), F.lit(now))) == [120, 60, 600, 60, 60]


PAGE = """<html><head><title>A &amp; B</title><meta property="og:title" content="Meta T"><script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "headline": "H", "author": [{"name": "Ann"}, {"name": "Bob"}], "datePublished": "2024-01-02", "articleSection": "News", "keywords": "x, y,x"}]}</script>
<script>var hidden = 1;</script></head><body><nav>menu</nav><article><h1>Head</h1><p>%s</p></article><aside>ad</aside><p>tail<br>end</p></body></html>""" % " ".join(["word"] * 40)


def test_parse_page(spark):
    title, text, body, author, published, section, keywords = web.parse_page(PAGE)
    assert (title, author, published, section, keywords) == ("A & B", "Ann, Bob", "2024-01-02", "News", ["x", "y"])
    assert "hidden" not in text and "menu" not in text and "ad" not in text.split() and text.endswith("tail\nend")
    assert body == "Head\n\n" + " ".join(["word"] * 40) or body == "Head\n" + " ".join(["word"] * 40)
    assert web.parse_page(None)[0] is None and web.parse_page("<p>unclosed <b>x")[1] == "unclosed x"
    assert web.parse_page("<script type='application/ld+json'>{broken</script>")[3] is None
    df = spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")
    got = {r.id: r for r in df.select("id", web.parse_html("html").alias("p"), web.meta_content(F.col("html"), "og:title").alias("m"), web.visible_text("html").alias("v")).collect()}
    assert got[1].p.title == "A & B" and got[1].m == "Meta T" and got[2].p.text == "" and got[2].m is None and got[1].v == text


def test_corpus_sources(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Title\nbody\nmore"), (2, "one line"), (3, None), (4, "")], "doc_id long, text string")
    assert [(r.title, r.body) for r in so.corpus_of(docs).orderBy("doc_id").collect()] == [("Title", "body\nmore"), ("one line", ""), ("", ""), ("", "")]
    assert so.text_source(spark, "hello").first().source == "stdin"
    parsed = spark.createDataFrame([(True, None, "t", ""), (False, None, "t", "x"), (None, "bad", "t", "x"), (None, None, " ", ""), (None, None, "", "x")], "indexable boolean, parse_error string, title string, text string")
    assert so.indexable(parsed).count() == 2
    pages = spark.createDataFrame([(f"http://x/{i:03d}", f"t{i}") for i in range(50)], "url string, title string")
    out = so.publish(pages.repartition(7), str(tmp_path / "c"))
    assert [(r.url, r.doc_id) for r in out.orderBy("url").collect()] == [(f"http://x/{i:03d}", i + 1) for i in range(50)]
    assert so.load_corpus(spark, str(tmp_path / "c")).count() == 50 and spark.read.json(str(tmp_path / "c/manifest")).first().documents == 50
    with pytest.raises(Exception):
        so.publish(pages, str(tmp_path / "c"))
    with pytest.raises(Exception):
        so.publish(pages.where("false"), str(tmp_path / "e"))


def record(i, source, title, text):
    s, t, x = source.encode(), title.encode(), text.encode()
    return struct.pack("<QI", i, len(s)) + s + struct.pack("<Q", len(t)) + t + struct.pack("<Q", len(x)) + x


def test_binary_records(spark, tmp_path):
    magic = b"SNAPSHT1"
    good = magic + record(1, "src", "Ti", "текст") + record(9, "b_2", "", "")
    (tmp_path / "good").write_bytes(good)
    assert [tuple(r) for r in so.read_records(spark, str(tmp_path / "good"), magic).collect()] == [(1, "src", "Ti", "текст"), (9, "b_2", "", "")]
    bad = {"magic": b"X" + good, "cut": good[:-3], "order": good + record(9, "src", "", ""), "source": magic + record(1, "Bad", "", ""), "long": magic + struct.pack("<QI", 1, 1 << 30)}
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception):
            so.read_records(spark, str(tmp_path / name), magic).collect()


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "inv.tsv").write_text("source\tcategory\turl\tsitemap_url\na\tnews\thttps://a.com/news/1\tm\na\tnews\thttps://a.com/news\tm\na\tnews\thttps://evil.com/x/1\tm\nb\tnews\tftp://b.com/x/1\tm\nb\tnews\thttp://www.b.com/x/1\tm\n")
    assert sorted(r.url for r in so.read_inventory(spark, str(tmp_path / "inv.tsv"), {"a": "a.com", "b": "b.com"}).collect()) == ["http://www.b.com/x/1", "https://a.com/news/1"]
    (tmp_path / "urls.txt").write_text("# list\na\thttp://a/1\n\nb\thttp://b/2\n")
    assert so.read_urls(spark, str(tmp_path / "urls.txt")).count() == 2
    (tmp_path / "map.xml").write_text('<?xml version="1.0"?><urlset><url><loc> http://a/?x=1&amp;y=2 </loc><lastmod>2024-01-01</lastmod></url><url><loc><![CDATA[http://b]]></loc></url></urlset>')
    assert [tuple(r) for r in so.read_sitemap(spark, str(tmp_path / "map.xml")).collect()] == [("url", "http://a/?x=1&y=2", "2024-01-01"), ("url", "http://b", None)]
    (tmp_path / "q.tsv").write_text('q1\ta AND "b c"\nq-2\tx\n')
    assert {r.query_id: r.query for r in so.read_queries(spark, str(tmp_path / "q.tsv")).collect()} == {"q1": 'a AND "b c"', "q-2": "x"}
    so.write_tsv(spark.createDataFrame([(1, ["a", "b"])], "i int, l array<string>"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first().l == "a|b"
    (tmp_path / "j/x").mkdir(parents=True)
    (tmp_path / "j/x/1.json").write_text(json.dumps({"url": "u", "text": "t"}, indent=1))
    assert so.read_json_documents(spark, str(tmp_path / "j"), "url string, text string").first().text == "t"
    pages = spark.createDataFrame([("http://a", "<p>"), ("http://b", None)], "url string, html string")
    assert tuple(so.write_archive(pages, str(tmp_path / "arch")).first()) == (2, 0)
    assert so.archived_page(spark, str(tmp_path / "arch"), "http://a").first().html == "<p>"


def test_inventories(spark):
    schema = "source string, category string, url string"
    a = spark.createDataFrame([("s", "news", "u1"), ("s", "news", "u2"), ("s", "news", "u1")], schema)
    b = spark.createDataFrame([("s", "blog", "u2"), ("t", "blog", "u3")], schema)
    merged = co.merge_inventories(a, b)
    assert sorted((r.url, r.category, r.origin) for r in merged.collect()) == [("u1", "news", 0), ("u2", "news", 0), ("u3", "blog", 1)]
    assert sorted(map(tuple, co.merge_report(merged, a, b).collect())) == [(0, 3, 2, 1), (1, 2, 1, 1)]
    many = spark.createDataFrame([("s", "n", f"u{i}") for i in range(100)] + [("t", "n", "v")], schema)
    first, again = (sorted(r.url for r in co.sample_inventory(df, 5, "1").collect()) for df in (many, many.repartition(9)))
    assert first == again and len(first) == 6
    links = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "c")], "parent string, url string")
    spark.sparkContext.setCheckpointDir("/tmp/quarry-test-checkpoints")
    assert sorted(map(tuple, co.expand_sitemaps(spark.createDataFrame([("r",)], "url string"), links).collect())) == [("a", 1), ("b", 2), ("c", 3), ("r", 0)]


def test_frontier_batches(spark):
    f = spark.createDataFrame([(f"u{i}", f"s{i % 2}", "pending" if i < 6 else "in_progress", i, i, "t") for i in range(9)], "url string, source string, state string, available_at long, queue_order long, lease_token string")
    assert sorted((r.url, r.turn) for r in co.claim(f, 100, 2).collect()) == [("u0", 1), ("u1", 1), ("u2", 2), ("u3", 2)]
    back = {r.url: (r.state, r.lease_token) for r in co.recover(f, 7).collect()}
    assert back["u6"] == ("retry", None) and back["u8"] == ("in_progress", "t") and back["u0"] == ("pending", "t")
    runs = spark.createDataFrame([("a", 10, "ok"), ("a", 20, "failed"), ("b", 20, "ok")], "source string, finished_at long, status string")
    assert {r.source: r.is_due for r in co.refresh_due(runs, 40, 100, 15).collect()} == {"a": True, "b": False}
    ch = co.changes(spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b")], "url string, at int, h string"), "url", F.col("h"), "at").orderBy("at").collect()
    assert [(r.change, r.generation) for r in ch] == [("new", 1), ("unchanged", 1), ("changed", 2)]


def test_metrics(spark):
    r = spark.createDataFrame([("q", i + 1, d) for i, d in enumerate([1, 2, 3, 4, 5])] + [("z", 1, 9)], "query_id string, rank int, doc_id long")
    j = spark.createDataFrame([("q", 2, 2), ("q", 7, 1), ("none", 1, 0)], "query_id string, doc_id long, grade int")
    got = {x.query_id: x for x in st.relevance(r, j).collect()}
    import math

    ideal = 3 + 1 / math.log2(3)
    assert got["q"].precision == 0.2 and got["q"].recall == 0.5 and abs(got["q"].ndcg - 3 / math.log2(3) / ideal) < 1e-12
    assert (got["none"].precision, got["none"].recall, got["none"].ndcg) == (0.0, 0.0, 0.0) and st.macro(st.relevance(r, j)).first().queries == 2


def test_streams(spark, tmp_path):
    src, schema = tmp_path / "in", "url string, at long, response string, digest string"
    rows = [("a", 1, "valid", "x"), ("a", 2, "valid", "x"), ("a", 3, "valid", "y"), ("b", 1, "server_error", None), ("b", 2, "server_error", None), ("c", 1, "not_found", None), ("c", 2, "valid", "z")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    stream = fr.frontier_states(spark.readStream.schema(schema).parquet(str(src)), max_attempts=2, retry_after=10)
    q = stream.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.url, r.at): (r.state, r.changed, r.generation) for r in spark.table("states").collect()}
    assert got == {("a", 1): ("done", True, 1), ("a", 2): ("done", False, 1), ("a", 3): ("done", True, 2), ("b", 1): ("retry", False, 0), ("b", 2): ("blocked", False, 0), ("c", 1): ("gone", False, 0), ("c", 2): ("gone", False, 0)}
    fr.follow(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "cp2"), lambda b: b.where("response = 'valid'"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
