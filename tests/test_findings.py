"""Cases that larger tables and odd inputs brought up."""

import duckdb
from pyspark.sql import functions as F

import quarry.queries_io  # noqa: F401  registers its queries
from quarry import queries as q
from quarry.functions import text as tx
from quarry.operators import collection as co
from quarry.operators import index as ix


def by_sql(sf: str, name: str, tables: dict[str, str]) -> list[tuple]:
    """The rows of a query's SQL over Parquet tables of ``sf``."""
    c = duckdb.connect()
    for table, path in tables.items():
        c.execute(f"create view {table} as select * from read_parquet('{sf}/{path}')")
    return sorted(map(tuple, c.execute(q.QUERIES[name][1]).fetchall()), key=repr)


def by_spark(spark, sf: str, name: str) -> list[tuple]:
    return sorted(map(tuple, q.QUERIES[name][0](spark, sf).collect()), key=repr)


def write_documents(spark, sf, texts: list) -> str:
    """A ``documents`` table of these texts in ``sf``."""
    rows = [(i, t, ("en", "de")[i % 2], f"src{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    return str(sf)


def test_url_repair_keeps_one_row_a_page(spark, tmp_path):
    urls = ["h/a/", "h/a/", "h/a.html", "h/b.html", "h/b.html", "h/b.html", "h/c", "h/c", "h/c", None, None]
    pages = spark.createDataFrame([(2 * i, u) for i, u in enumerate(urls)], "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    want = by_sql(str(tmp_path), "c19_url_repair", {"pages": "pages.parquet/*.parquet"})
    assert len(want) == len(urls) and by_spark(spark, str(tmp_path), "c19_url_repair") == want


def test_url_repair_breaks_ties_by_state(spark):
    f = spark.createDataFrame([("h/b.html", "pending"), ("h/b.html", "done")], "url string, state string")
    for rows in (f, f.orderBy("state")):
        assert sorted(map(tuple, co.repair_urls(rows, F.regexp_replace("url", "\\.html$", "/"))[0].collect())) == [("h/b.html", "excluded"), ("h/b/", "done")]


def test_text_functions_of_odd_blanks(spark, tmp_path):
    sf = write_documents(spark, tmp_path, ["  a \t b ", "\n\n\n\na\n \n\t\nb\n", "a\r\n\r\n\r\nb\r", "a  b  ", " ", "", None, "a b"])
    assert by_spark(spark, sf, "f2_text_functions") == by_sql(sf, "f2_text_functions", {"documents": "documents.parquet/*.parquet"})


WORDS = ["rewh", "thatin", "The", "of", "the", "er", "erer", "thes", "things", "ser", "U.S.A.", "a.b", "C++17", "c#", "v1.2.3", "don’t", "ſa‐b", "İİ", "ÄÖ", "Ёж", "x́y", "1.5", "a.b.c.", "x-y'z", "--", "was", "has", "ha", "ing"]


def odd_texts(n: int, seed: int) -> list[str]:
    import random

    rnd = random.Random(seed)
    return [rnd.choice([" ", "\n", ".", ". ", ""]).join(rnd.choices([*WORDS, "".join(rnd.choices("aЖé́.-'’+#cv19İſʼ ", k=6))], k=rnd.randint(1, 40))) for _ in range(n)]


def test_java_pattern_and_folds_equal_the_drivers(spark):
    texts = odd_texts(400, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, title string").withColumn("body", F.lit(""))
    found: dict[int, list] = {}
    for r in sorted(tx.tokens(df).collect(), key=lambda r: r.pos):
        found.setdefault(r.doc_id, []).append(r.term)
    assert [found.get(i, []) for i in range(len(texts))] == [tx.tokens_of(t) for t in texts]


def test_plain_tokens_skip_the_folds(spark):
    """A text is asked once whether its tokens need more than lower case."""
    flags = spark.createDataFrame([("Plain text. No.",), ("U.S.A.",), ("a’b",), ("İ",), (None,)], "t string").select(tx.is_odd(F.col("t")).alias("o")).collect()
    assert [r.o for r in flags] == [False, True, True, True, None]


def test_lemma_map_equals_lemmatizing_every_word(spark):
    d = ix.dictionary(spark.createDataFrame([*q.PAIRS, ("ru:игры", "игра"), ("n:box", "box"), ("n:man", "man"), ("v:try", "try"), ("a:late", "late"), ("n:s", "s")], "key string, lemma string"))
    stems = ["er", "th", "thing", "ha", "on", "re", "st", "in", "an", "was", "wa", "thes", "box", "man", "m", "tr", "try", "lat", "late", "s", "игры", "Игры", "x1"]
    words = {a + b for a in stems for b in ("", "s", "es", "ses", "xes", "men", "ies", "ed", "ing", "er", "est", "e")}
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    rows = lambda df: sorted((r.term, list(r.lemmas), r.known) for r in df.collect())
    want = rows(ix.lemmatize(terms, d))
    assert rows(ix.lemmas_of(terms, ix.lemma_map(d))) == want and sum(k for _, _, k in want) > 30
    assert len(ix.lemma_map(d).columns) == 2


def test_index_parts_are_built_alone_and_without_a_shuffle_of_tokens(spark, tmp_path, monkeypatch):
    sf = write_documents(spark, tmp_path, odd_texts(30, 2))
    built = []
    once = q.built_once
    monkeypatch.setattr(q, "built_once", lambda spark, name, build: built.append(name) or once(spark, name, build))
    q.QUERIES["q13_search_statistics"][0](spark, sf).collect()
    assert [n.split("-")[2] for n in built] == ["postings"]
    plan = ix.postings(q.tokens(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of the texts


def test_shares_of_the_corpus_follow_its_size(spark, tmp_path):
    sf = write_documents(spark, tmp_path, odd_texts(200, 3))
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))
    assert q.by_document(spark, sf, share=size // 16).rdd.getNumPartitions() >= 16
    assert q.by_document(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_search_of_the_lemma_space_agrees_with_sql(spark, tmp_path):
    # The SQL's pattern knows no acronyms and C languages.
    import random

    rnd = random.Random(4)
    plain = ["rewh", "thatin", "of", "the", "th", "er", "erer", "ers", "thes", "things", "thing", "was", "ha", "has", "in"]
    sf = write_documents(spark, tmp_path, [" ".join(rnd.choices(plain, k=rnd.randint(1, 12))) + "\n" + " ".join(rnd.choices(plain, k=rnd.randint(0, 30))) for _ in range(60)])
    for name in ("l2_lemma_statistics", "l3_lemma_zipf", "l4_reduction", "l5_lemma_phrase", "l6_diagnostic", "l7_lemma_tfidf", "l9_lemma_boolean", "q5_phrase", "x7_verify"):
        assert by_spark(spark, sf, name) == by_sql(sf, name, {"documents": "documents.parquet/*.parquet"}), name


def test_spans_need_no_sort_of_tokens(spark):
    texts = [*odd_texts(120, 5), None, "", "...", "É"]
    df = spark.createDataFrame([(i, t, "" if t is None else t[::-1]) for i, t in enumerate(texts)], "doc_id long, title string, body string").repartition(3)
    spans = tx.token_spans(df)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    terms = {(r.doc_id, r.field, r.pos): r.term for r in tx.tokens(df).collect()}
    rows = spans.collect()
    assert len(rows) == len(terms)
    for r in rows:
        text = texts[r.doc_id] if r.field == 0 else texts[r.doc_id][::-1]
        raw = text.encode()[r.begin_byte : r.end_byte].decode()
        assert tx.tokens_of(raw) == [r.term] == [terms[r.doc_id, r.field, r.pos]] and len(raw) == r.n_chars


def test_running_sums_of_sliced_lists():
    import pyarrow as pa

    lists = pa.array([[9], [1, 2], [], [3], [4, 5, 6]], pa.list_(pa.int64()))
    assert tx.running_sums.func(lists.slice(1)).to_pylist() == [[1, 3], [], [3], [4, 9, 15]]
    assert tx.running_sums.func(lists.slice(2, 1)).to_pylist() == [[]] and tx.running_sums.func(lists.slice(0, 0)).to_pylist() == []


def test_pages_are_parsed_a_few_at_a_time():
    import pyarrow as pa

    from quarry.functions import web

    pages = ["<title>t%d</title><p>%d</p>" % (i, i) if i % 7 else None for i in range(3 * web.PAGES + 5)]
    parts = list(web.parse_html.func(iter([pa.array(pages), pa.array([], pa.string())])))
    assert max(map(len, parts)) == web.PAGES and len(parts) >= 4
    assert [tuple(r.values()) for part in parts for r in part.to_pylist()] == [web.parse_page(p) for p in pages]


def test_checks_take_documents_and_pairs_apart(spark):
    """Documents meet the postings by one row each; pairs are counted only after the shuffle by id."""
    p = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("a", 1, 1), ("a", 2, 0), ("c", 3, 1), ("d", 3, 1)], "term string, doc_id long, tf long")
    docs, norms = spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([(1, 1.0), (3, 0.0)], "doc_id long, norm double")
    checks = ix.verify(p, ix.vocabulary(p), docs, norms)
    assert {r.check: r.violations for r in checks.collect()} == {
        "duplicate postings": 1, "unknown documents": 2, "postings without frequency": 1, "wrong document frequency": 0, "norms missing": 1, "norms not positive": 1,
    }
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan


def test_first_hits_do_not_move_the_texts(spark, tmp_path):
    sf = write_documents(spark, tmp_path, odd_texts(30, 6))
    plan = q.QUERIES["q6_first_hits"][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
