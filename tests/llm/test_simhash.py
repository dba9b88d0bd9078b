import random

import pytest

from quarry.llm import simhash
from quarry.llm.common import connected_components

from . import brute

DATA = "/root/testdata/sf0.01"


def expected(rows):
    prints = {}
    for doc_id, text in rows:
        prints.setdefault(brute.fingerprint(text), []).append(doc_id)
    keys = list(prints)
    near = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (a ^ b).bit_count() <= 4]
    root = brute.components(keys, near)
    least = {}
    for k, ids in prints.items():
        known = [i for i in ids if i is not None]
        least[root[k]] = min([*known, *([least[root[k]]] if least.get(root[k]) is not None else [])], default=None)
    return sorted(((i, f"{k:016x}", least[root[k]]) for k, ids in prints.items() for i in ids), key=str)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma", "δέλτα"]) for _ in range(30_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "one two"), (7, "ONE two"), (7, "ONE two"), (None, "one two"), (11, long), (12, long + " omega"), (None, "all alone here"), (2, " nbsp is no blank")]
    docs = spark.createDataFrame([(a, b, b, "x") for a, b in rows], "doc_id long, text string, fp string, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == expected(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def near(prints, bits):
    return {(min(a, b), max(a, b)) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}


def signed(prints):
    return [p - (1 << 64) if p >> 63 else p for p in prints]


@pytest.mark.parametrize("bits,hot", [(4, 2000), (4, 3), (0, 2000), (1, 2000), (2, 2000), (3, 2000), (5, 2000), (8, 2000)])
def test_links_are_complete_for_any_distance(spark, bits, hot):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = signed({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(bits + 3))) for b in base for _ in range(12)})
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), len(prints), bits, hot)
    assert {(r.u, r.v) for r in got.collect()} == near(prints, bits) and got.count() == len(near(prints, bits))


@pytest.mark.parametrize("hot", [100, 2])
def test_links_of_equal_points(spark, hot):
    """Segments 01 and 10 have one count each: many fingerprints, one point."""
    rng = random.Random(4)
    prints = signed({sum(rng.choice((1, 2)) << (2 * s) for s in range(32)) for _ in range(150)} | {sum((1 + (k >> s & 1)) << (2 * s) for s in range(32)) for k in range(64)})
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), len(prints), 4, hot)
    want = near(prints, 4)
    assert len(want) > 500 and {(r.u, r.v) for r in got.collect()} == want and got.count() == len(want)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(200, 260)] + [(7, 7), (300, 301), (301, 300), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e if None not in e}
    assert got == brute.components(nodes, [e for e in edges if None not in e])
