"""BPE, word-piece counts and media columns against plain versions and exact round trips."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import bpe, media, wordpiece

from . import brute

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "naïve Übung — 東京 🙂 don't  stop"), (4, "naïve Übung — 東京 🙂 don't  stop"), (None, "no id"), (6, "x" * 5000), (7, "a b" * 60_000 + " " * 300 + "end's"), (8, "<|endoftext|> is text")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(a, b, b, 1) for a, b in ODD], "doc_id long, text string, ids string, n_tokens int")


def test_bpe_matches_the_library(spark, odd):
    c = bpe.codec(bpe.rank_file(), bpe.split_pattern())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = c.encoding.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(tuple, bpe.round_trip(df).collect()), key=str) == sorted(want, key=str)


def test_bpe_pieces_do_not_change_ids():
    c = bpe.codec(bpe.rank_file(), bpe.split_pattern())
    text = "It's   a\n\n test, 42 times  of\tthe 'll pieces don't  matter " * 40
    whole = c.encoding.encode_ordinary(text)
    for size in (1, 7, 50, 333):
        parts = bpe.pieces(text, size)
        assert "".join(parts) == text and [i for p in parts for i in c.encoding.encode_ordinary(p)] == whole
    assert bpe.pieces("y" * 900, 10) == ["y" * 900]


def plain_ids(c, text):
    """The split pattern by another engine, and the library's merges match by match."""
    import regex

    return [i for m in regex.finditer(bpe.split_pattern(), text) for i in c.encoding._core_bpe.encode_single_piece(m[0].encode())]


def test_bpe_white_space_runs_of_any_length():
    c = bpe.codec(bpe.rank_file(), bpe.split_pattern())
    for n in (bpe.RUN - 1, bpe.RUN, bpe.RUN + 1, 70_000):
        for gap in (" ", "\t", "\n", "\u3000", "\r\n", " \n", "\n ", "\x1c", " \x1c"):
            run = (gap * n)[:n]
            for text in (run, run + "x", "x" + run, f"a b{run}word{run}don't", f"{run}!{run} 7", f"x {run[:3]}y{run}"):
                assert c.encode(text) == plain_ids(c, text), (n, gap, text[:9])


@pytest.mark.parametrize("n", [10**6, 10**7])
def test_bpe_very_long_runs(spark, n):
    c = bpe.codec(bpe.rank_file(), bpe.split_pattern())
    texts = [" " * n, " " * n + "x", "x" + "\n" * n, "a" + "\t" * n + " b"]
    texts += ["x" * n, "9" * n, "!" * n] if n == 10**6 else []
    want = {i: [t for p in parts for t in c.encoding._core_bpe.encode_single_piece(p)] for i, parts in enumerate([[b" " * n], [b" " * (n - 1), b" x"], [b"x", b"\n" * n], [b"a", b"\t" * n, b" b"]])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.round_trip(docs).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        if r.doc_id in want:
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()


def test_bpe_decode_gives_raw_bytes(spark, odd):
    got = sorted(((r.doc_id, bytes(r.bytes)) for r in bpe.decode(bpe.encode(odd)).collect()), key=str)
    assert got == sorted(((i, (t or "").encode()) for i, t in ODD), key=str)
    split = spark.createDataFrame([(1, [c]) for c in bpe.codec(bpe.rank_file(), bpe.split_pattern()).encoding.encode_ordinary("🙂")] + [(2, None)], "doc_id long, ids array<int>")
    assert [None if r.bytes is None else bytes(r.bytes) for r in bpe.decode(split).collect()][-1] is None


def test_wordpiece_counts_equal_greedy_matching(spark, odd):
    first, inner = map(set, wordpiece.vocabulary(wordpiece.model_file()))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 150")
    for df in (docs, odd):
        want = []
        for r in df.select("doc_id", "text").collect():
            words = [w for w in (r.text or "").split() if len(w) < 4000]
            if len(words) == len((r.text or "").split()):
                want.append((r.doc_id, len(words), sum(brute.word_pieces(w, first, inner) for w in words)))
        got = {tuple(r) for r in wordpiece.token_counts(df).collect()}
        assert set(want) <= got and wordpiece.token_counts(df).count() == df.count()


def test_wordpiece_automaton_on_all_short_strings():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(30):
        pool = ["".join(p) for n in (1, 2, 3, 4) for p in product("abc", repeat=n)]
        first = set(rng.choice(pool, 12)) | {"a"}
        inner = set(rng.choice(pool, 12)) | {"b"}
        c = wordpiece.Counter(sorted(first), sorted(inner))
        for n in range(1, 7):
            for w in map("".join, product("abcd" if n < 5 else "abc", repeat=n)):
                assert c.count(w) == brute.word_pieces(w, first, inner), (w, first, inner)


def plain_hash(rows):
    """Difference hash of rows of RGB pixels: means over exact areas, luma, neighbours compared."""
    h, w = len(rows), 64
    image = np.frombuffer(b"".join(rows), np.uint8).reshape(h, w, 3).astype(object)

    def weights(n, parts):
        out = []
        for k in range(parts):
            a, b = Fraction(k * n, parts), Fraction((k + 1) * n, parts)
            out.append([(i, min(b, i + 1) - max(a, i)) for i in range(int(a), min(n, math.ceil(b)))])
        return out

    columns = [[sum(image[:, i, :] * f for i, f in part) for part in weights(w, 9)]][0]
    bits = ""
    for part in weights(h, 8):
        line = []
        for col in columns:
            sums = sum(col[i] * f for i, f in part)
            r, g, b = (int((2 * s * 72 + h * w) // (2 * h * w)) for s in sums)
            line.append((299 * r + 587 * g + 114 * b + 500) // 1000)
        bits += "".join("1" if b > a else "0" for a, b in zip(line, line[1:]))
    return f"{int(bits, 2):016x}"


def test_text_media(spark, odd):
    small = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for df in (odd, small):
        rows = df.select("doc_id", "text").collect()
        got = sorted(map(tuple, media.text_media_digest(df).collect()), key=str)
        want = []
        for r in rows:
            raw = (r.text or "").encode()
            pad = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
            lines = [pad[i : i + 192] for i in range(0, len(pad), 192)]
            parts = [lines[i : i + 64] for i in range(0, len(lines), 64)]
            stored = b""
            for part in parts:
                head = b"{'descr': '|u1', 'fortran_order': False, 'shape': (%d, 64, 3), }" % len(part)
                head += b" " * (-(len(head) + 11) % 64) + b"\n"
                stored += b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head + b"".join(part)
            exact = len(lines) <= 70
            feature = ":".join(["dhash", plain_hash(lines), *map(plain_hash, parts)]) if exact else None
            want.append((r.doc_id, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(parts)))
        for g, w in zip(got, sorted(want, key=lambda w: str(w[:7])), strict=True):
            assert g[:7] == w[:7] and len(g[7].split(":")) == 2 + w[8] and g[7] == (w[7] or g[7])
        assert sum(w[7] is not None for w in want) > 5


def test_area_resize_is_the_mean_over_areas():
    rng = np.random.default_rng(5)
    for h, w, c, th, tw in ((7, 5, 3, 3, 2), (9, 8, 1, 9, 8), (3, 4, 3, 8, 9), (1, 64, 3, 8, 9), (9000, 6, 1, 8, 9)):
        image = rng.integers(0, 256, (h, w, c), dtype=np.uint8)
        small = image.repeat(th, 0).repeat(tw, 1).reshape(th, h, tw, w, c).astype(np.int64)
        mean = small.sum((1, 3))
        assert (media.area_resize(image, th, tw) == (2 * mean + h * w) // (2 * h * w)).all()


def test_image_formats_round_trip(spark):
    rng = np.random.default_rng(6)
    rgb, one = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8), rng.integers(0, 256, (4, 9, 1), dtype=np.uint8)
    assert (media.decode_image(media.encode_ppm(rgb)) == rgb).all()
    assert (media.decode_image(media.encode_ppm(one)) == one).all()
    assert (media.decode_image(media.encode_bmp(rgb)) == rgb).all()
    text = b"P3 # note\n2 1\n255\n1 2 3 4 5 6\n"
    assert media.decode_image(text).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert media.decode_image(b"P1\n3 1\n1 0 1").tolist() == [[[0], [255 // 255], [0]]] or media.decode_image(b"P1\n3 1\n1 0 1").shape == (1, 3, 1)
    assert media.decode_image(b"P4\n3 1\n\xa0").shape == (1, 3, 1)
    df = spark.createDataFrame([(1, media.encode_bmp(rgb)), (2, b"junk"), (3, None), (4, b"P6\n9 9\n255\nxx")], "id long, m binary")
    got = {r.id: r for r in media.describe(df, "id", "m").collect()}
    assert got[1].height == 5 and got[2].dhash is None and got[3].dhash is None and got[4].dhash is None
    parts = media.tile_rows(df, "id", "m", 4).collect()
    assert len(parts) == 4
    import io

    whole = {(p.tile_row, p.tile_col): np.load(io.BytesIO(bytes(p.npy))) for p in parts}
    assert (np.vstack([np.hstack([whole[y, 0], whole[y, 1]]) for y in (0, 1)]) == rgb).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (bpe.round_trip, bpe.encode, wordpiece.token_counts, media.text_media_digest):
        assert f(none).collect() == []
