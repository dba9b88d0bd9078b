"""The pipeline's stages and their result, against plain versions of what each stage promises."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, quality
from quarry.llm.common import table

from . import brute
from .test_similarity import expected, shingles

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(table(stage(spark, out[-1], DATA), "test"))
    return [df.toPandas() for df in out], docs.columns


def test_stages(spark, steps):
    (raw, good, single, clean, mixed, ids), columns = steps
    assert all(list(df.columns) == columns for df in (good, single, clean, mixed))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = set(good.doc_id)
    wrong = [i for i in raw.doc_id if i in labels and (i in kept) != (labels[i] == 1)]
    assert len(wrong) <= 0.05 * len(labels)
    component = expected(list(good.text))
    least = {}
    for i, t in zip(good.doc_id, good.text):
        c = component[shingles(t)]
        least[c] = min(i, least.get(c, i))
    assert set(single.doc_id) == set(least.values()) and len(single) == len(least)
    assert set(clean.doc_id) == set(single.doc_id)
    before = dict(zip(single.doc_id, single.text))
    for i, t, n in zip(clean.doc_id, clean.text, clean.n_chars):
        assert n == len(t) and not brute.pii_spans(t)
        if not brute.pii_spans(before[i]):
            assert t == before[i]
    assert set(mixed.doc_id) <= set(clean.doc_id) and len(mixed) >= 0.5 * len(clean)
    assert sorted(ids.doc_id) == sorted(mixed.doc_id)
    c = bpe.codec(bpe.rank_file(), bpe.split_pattern())
    text = dict(zip(mixed.doc_id, mixed.text))
    for r in ids.itertuples():
        assert list(r.ids) == c.encoding.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_odd_documents_pass_all_stages(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, "word " * 100_000, None, "s", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, version string")
    for df in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            df = table(stage(spark, df, DATA), "test")
        df.collect()
