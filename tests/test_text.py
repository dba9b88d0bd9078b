"""Tokenizer, folds and scalars; golden values and an independent state machine."""

import random

from pyspark.sql import functions as F

from quarry.functions import text as tx

CASES = {
    "S.T.A.L.K.E.R: Shadow of Chernobyl": ["stalker", "shadow", "of", "chernobyl"],
    "C and C++ (along with C#": ["c", "and", "c++", "along", "with", "c#"],
    "новый патч 3.0.1": ["новый", "патч", "3.0.1"],
    "Half-Life": ["half-life"],
    "Pokémon": ["pokémon"],
    "C++17 c#x c++a C+": ["c++17", "c", "x", "c", "a", "c"],
    "rock’n’roll donʼt -x- a--b": ["rock'n'roll", "don't", "x", "a", "b"],
    "ſ İ ÀÉ×÷ Ёж éte": ["s", "İ", "àé", "ёж", "éte"],
    "U.S. a.b.c. x.y.zz v1.2.3 1.2. 7": ["u", "s", "abc", "x", "y", "zz", "v1.2.3", "1.2", "7"],
    "_under_score_": ["under", "score"],
    "": [],
}


def test_golden_tokens(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string")
    for r in df.select("t", tx.tokenize(F.col("t")).alias("a")).collect():
        assert list(r.a) == CASES[r.t], r.t


def test_long_chains_do_not_exhaust_the_stack(spark):
    rows = [("a-" * 50_000 + "b",), ("1." * 50_000 + "1",), ("a." * 50_000,), ("x" * 100_000,), ("a'" * 50_000,)]
    got = spark.createDataFrame(rows, "t string").select(F.size(tx.tokenize(F.col("t"))).alias("n"), "t").collect()
    assert {r.t[:2]: r.n for r in got} == {"a-": 1, "1.": 1, "a.": 1, "xx": 1, "a'": 1}


def test_spans_point_at_the_tokens(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "Ж", "ё", "İ", "ſ", "1", "v2", ".", "-", "’", "́", " ", "\n", "C", "+", "#", "🙂", "_", "×"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(texts)], "doc_id long, title string, body string")
    terms = {(r.doc_id, r.field, r.pos): r.term for r in tx.tokens(df).collect()}
    spans = tx.token_spans(df).collect()
    assert len(spans) == len(terms)
    for r in spans:
        raw = (texts[r.doc_id] if r.field == 0 else texts[r.doc_id][::-1]).encode()[r.begin_byte : r.end_byte].decode()
        assert len(raw) == r.n_chars and terms[r.doc_id, r.field, r.pos] == r.term
        assert tx.normalise is not None and raw.replace(".", "").lower()[:1] in ("", *r.term[:1].lower(), "ſ", "i") or r.term[0] == "İ"


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(tx.clean_text(F.lit("  a \t b c\r\n\r\n\r\n\r\n d  "))) == "a b c\n\nd"
    assert [value(tx.variable_byte_length(F.lit(n).cast("long"))) for n in (0, 127, 128, 16383, 16384)] == [1, 1, 2, 2, 3]
    assert [value(tx.publication_year(F.lit(d))) for d in ("2020-01-02", "1899-01-01", "2100", "2101-01-01", "20", "", "19991")] == [2020, 0, 2100, 0, 0, 0, 0]
    assert value(tx.publication_year(F.lit(None).cast("string"))) == 0
    assert value(tx.log_tf(F.lit(0))) == 0 and abs(value(tx.log_tf(F.lit(100))) - 3) < 1e-12
    import hashlib

    assert value(tx.queue_order(F.lit("http://x/"))) == int(hashlib.sha256(b"http://x/").hexdigest()[:16], 16) & (1 << 63) - 1
    assert value(tx.word_count(F.lit("don't stop - well-known _x_ é"))) == 5
