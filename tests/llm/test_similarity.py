"""Near copies by Jaccard similarity, against all pairs."""

import random

import pytest

from quarry.llm import simhash

from . import brute

DATA = "/root/testdata/sf0.01"


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def expected(texts):
    """Component of each different shingle set, by all pairs that share a shingle."""
    sets = list({shingles(t) for t in texts})
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = brute.components(range(len(sets)), near)
    return {s: root[i] for i, s in enumerate(sets)}


def classes(pairs):
    """A labelling as a set of groups."""
    out = {}
    for k, v in pairs:
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_components_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = expected([r.text for r in rows])
    got = [(r.doc_id, r.component) for r in simhash.near_copies(docs).collect()]
    assert classes(got) == classes([(r.doc_id, want[shingles(r.text)]) for r in rows])


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(300)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"w{rng.randrange(4000)}" for _ in range(50))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected([t for _, t in rows])
    assert classes([(r.doc_id, r.component) for r in simhash.near_copies(docs).collect()]) == classes([(i, want[shingles(t)]) for i, t in rows])
    kept = {r.doc_id for r in simhash.distinct_documents(docs).collect()}
    assert 0 in kept and {1000 + i for i in range(50)} <= kept


@pytest.mark.parametrize("hot", [2000, 40, 5])
def test_boilerplate_that_many_texts_share(spark, hot):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    own = [" ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randrange(10, 40))) for _ in range(120)]
    rows = [(i, f"{passage} {t}") for i, t in enumerate(own)]
    rows += [(500 + i, f"{passage} {t} and a few") for i, t in enumerate(own[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected([t for _, t in rows])
    assert classes([(r.doc_id, r.component) for r in simhash.near_copies(docs, hot=hot).collect()]) == classes([(i, want[shingles(t)]) for i, t in rows])


@pytest.mark.parametrize("hot", [2000, 2, 1])
def test_similar_texts_that_share_a_single_large_cell(spark, hot):
    rng = random.Random(7643)
    a = [f"w{rng.randrange(99999)}" for _ in range(96)]
    b = [*a[:30], "x", *a[31:70], "y", *a[71:]]
    rng = random.Random(131)
    own = [f"z{rng.randrange(99999)}" for _ in range(rng.randrange(5, 60))]
    c = [*a[:30], *own, *a[31:70], *own[:4], *a[71:]]
    rows = [(i, " ".join(w)) for i, w in enumerate((a, b, c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # The third text, similar to neither, is the smallest node of the only cell that the first two share.
    one, two, hub = ({(i, x) for i, x in enumerate(r.samples)} for r in simhash.sketches(docs).orderBy("doc_id").collect())
    assert len(one & two) == 1 and one & two <= hub
    want = expected([t for _, t in rows])
    got = [(r.doc_id, r.component) for r in simhash.near_copies(docs, hot=hot).collect()]
    assert classes(got) == classes([(i, want[shingles(t)]) for i, t in rows]) == [[0, 1], [2]]


def test_one_row_stays_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text, "a"), (2, text.upper(), "b"), (2, text.upper(), "b"), (None, text, "c"), (7, None, "d"), (8, "", "e"), (9, " \n", "f"), (None, None, "g"), (5, "other words here", "h"), (5, "quite different text", "i"), (4, text + " more", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted(((r.doc_id, r.component) for r in simhash.distinct_documents(docs).collect()), key=str)
    assert got == [(2, "b"), (5, "h"), (5, "i"), (7, "d")]
    assert simhash.distinct_documents(docs.where("false")).collect() == []
