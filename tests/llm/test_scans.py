"""Secret scans and personal data against plain Python."""

import random

from pyspark.sql import functions as F

from quarry.llm import pii, secrets
from quarry.llm.spans import disjoint, replaced

from . import brute

DATA = "/root/testdata/sf0.01"


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["token", "Secret", "api_key", "APIKEY", "passwd", "password", "=", ":", " ", "  ", '"', "'", "abcdefgh", "x", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "f" * 31, "ß", "🙂", "\n",
             "joe", "@", "mail", ".", "example.org", "a.b@c.d", "%", "+", "1.2.3.4", "256", ".7", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-9999", "-", "0004", "(", ")", "12", "9", "é", "K"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 24))) for _ in range(n)]


def frame(spark, texts):
    rows = [(i, t, f"o{i % 3}", t, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, version string, start int")


EDGE = [None, "", " ", "token=" + "a1" * 9000, "+1" + " " * 4000 + "5", "5 " * 9000, "a" * 50_000, "1" * 30_000, "a@b.cc " * 800, "1.1.1.1.1.1.1.1", "x.y@z.w%v@u.t@s.r"]


def test_secrets_equal_plain_scan(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    for df in (frame(spark, odd_texts(1500, 1) + EDGE), docs):
        got = {r.doc_id: r for r in secrets.report(secrets.find(df, owner=F.col("source"))).collect()}
        rows = df.select("doc_id", "text").collect()
        assert len(got) == len(rows)
        for r in rows:
            want = brute.secret_spans(r.text or "")
            g = got[r.doc_id]
            assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(s[0] == k for s in want) for k in brute.KINDS5), r
            assert g.base_sha256 == brute.digest(want), (r, want, g)
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(g.spans.split(","))


def test_ownership_separates_copied_from_live(spark):
    copied, live = "ghp_abcdefghij0123456789XYZ", "ghp_qwertyuiop9876543210ABC"
    rows = [(i, f"see {copied} in sample {i}", f"owner{i}") for i in range(6)] + [(10, f"mine is {live} ok", "owner1"), (11, f"mine is {live} again", "owner1"), (None, f"x {copied}", None)]
    got = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string"), owner=F.col("source")).collect()}
    assert [tuple(s) for s in got[0].copied] == [(4, 4 + len(copied))] and not got[0].live
    assert [tuple(s) for s in got[10].live] == [(8, 8 + len(live))] and not got[11].copied
    assert len(got[None].copied) == 1


def test_ownership_counts_repeated_rows_once(spark):
    rows = [(1, "ghp_abcdefghij0123456789XYZ", "a")] * 50
    got = secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string"), owner=F.col("source")).collect()
    assert len(got) == 50 and all(len(r.live) == 1 and not r.copied for r in got)


def test_pii_equals_plain_scan(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for df in (frame(spark, odd_texts(2500, 2) + EDGE), docs):
        got = {r.doc_id: r for r in pii.report(pii.find(df)).collect()}
        rows = df.select("doc_id", "text").collect()
        assert len(got) == len(rows)
        for r in rows:
            want = brute.pii_spans(r.text or "")
            g = got[r.doc_id]
            assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(s[0] == k for s in want) for k in brute.KINDS10), (r, want)
            assert g.base_sha256 == brute.digest(want), (r, want, g)
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(g.spans.split(","))


def test_terms_that_give_an_entity_away(spark):
    common = "these words stand everywhere around every text"
    rows = [(i, f"{common} number {i} plain") for i in range(200)]
    rows += [(300, f"{common} Zanzibarite writes joe@example.org first"), (301, f"{common} the zanzibarite joe@example.org again there"), (302, f"{common} lonely ann@example.org"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    t = rows[200][1]
    assert [t[s.start : s.end] for s in got[300].remove] == ["Zanzibarite"]
    assert not got[302].remove and not got[302].generalise and not any(got[i].remove for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[300] == f"{common} [TERM] writes [EMAIL] first" and clean[5] == rows[5][1] and clean[None] is None


def test_terms_beside_an_entity_of_a_single_text(spark):
    common = "these words stand everywhere around every text"
    rows = [(i, f"{common} plain") for i in range(20_000)] + [(30_000, f"{common} Zanzibarite joe@example.org {common}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find(df).where("size(remove) + size(generalise) > 0").collect()
    assert [(r.doc_id, [rows[-1][1][s.start : s.end] for s in r.remove], r.generalise) for r in got] == [(30_000, ["Zanzibarite"], [])]
    assert pii.sanitise(df).where("doc_id = 30000").first().text == f"{common} [TERM] [EMAIL] {common}"


def test_terms_far_from_their_entity(spark):
    common = "these words stand everywhere around every text "
    rows = [(i, common + "plain") for i in range(20_000)] + [(30_000, f"Zanzibarite Bo and X-77 {common * 10}joe@example.org {common * 10} zanzibarite, bo +49 30 123456 x-77 plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = pii.sanitise(df).where("doc_id = 30000").first().text
    assert text == f"[TERM] [TERM] [TERM] [TERM] {common * 10}[EMAIL] {common * 10} [TERM], [TERM] [PHONE] [TERM] plain"


def test_sanitise_overlaps_repeats_and_extra_columns(spark):
    rows = [(1, "mail 1.2.3.4@ex.com +1 555 010 9999 x", "a")] * 3 + [(2, "", "b"), (None, "a@b.cc", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, email string")
    got = sorted(((r.doc_id, r.text, r.email) for r in pii.sanitise(df).collect()), key=str)
    assert got == sorted([(1, "mail [EMAIL] [PHONE] x", "a")] * 3 + [(2, "", "b"), (None, "[EMAIL]", "c")], key=str)


def test_spans_are_merged_and_replaced_like_plain_ones(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        text = "".join(rng.choice("abc é🙂\n") for _ in range(rng.choice([0, 5, 63, 64, 65, 200, 3000])))
        marks = sorted({(a, min(len(text), a + rng.randrange(1, rng.choice([2, 9, 200])))) for a in (rng.randrange(len(text)) for _ in range(rng.choice([0, 1, 3, 40, 700]) if text else 0))}, key=lambda m: (m[0], -m[1]))
        rows.append((i, text, marks))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:int,end:int>>")
    fill = lambda s, part: F.concat(F.lit("<"), part(s["start"], F.least(s["start"] + 2, s["end"])), F.lit(">"))
    got = {r.i: (r.d, r.o) for r in df.select("i", disjoint(F.col("s")).alias("d"), replaced(F.col("t"), disjoint(F.col("s")), fill).alias("o")).collect()}
    for i, text, marks in rows:
        merged = []
        for a, b in marks:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out, at = [], 0
        for a, b in merged:
            out += [text[at:a], f"<{text[a : min(a + 2, b)]}>"]
            at = b
        assert [list(x) for x in got[i][0]] == merged and got[i][1] == "".join(out) + text[at:]


def test_a_text_of_many_spans(spark):
    text = " ".join(f"user{i}@mail{i % 7}.org und +49 30 {i:06d}" for i in range(25_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.report(pii.find(df)).first()
    want = brute.pii_spans(text)
    assert got.n_email == 25_000 and got.n_phone == 25_000 and got.base_sha256 == brute.digest(want)
    assert pii.sanitise(df).first().text == " ".join(["[EMAIL] und [PHONE]"] * 25_000)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert secrets.report(secrets.find(none)).collect() == [] and pii.report(pii.find(none)).collect() == [] and pii.sanitise(none).collect() == []
