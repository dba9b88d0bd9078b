"""Readers and writers: corpora, snapshots, inventories, sitemaps, query files, archives."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import numbered

CORPUS = "doc_id long, source string, title string, body string"
INVENTORY = "source string, category string, url string, sitemap_url string"
MAX_FIELD = 64 << 20
SOURCE = "^[a-z][a-z0-9_]{0,63}$"


def corpus_of(documents: DataFrame) -> DataFrame:
    """Documents of one text column as a corpus: the first line is the title, the rest the body; other columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    title = F.substring_index(text, "\n", 1)
    return documents.select(*documents.columns, title.alias("title"), F.expr("substring(coalesce(text, ''), length(substring_index(coalesce(text, ''), '\\n', 1)) + 2)").alias("body"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus written by ``publish``."""
    return spark.read.parquet(f"{path}/corpus")


def text_source(spark: SparkSession, text: str) -> DataFrame:
    """One text as document 1 of source ``stdin``."""
    return spark.createDataFrame([(1, "stdin", "", text)], CORPUS)


def indexable(documents: DataFrame) -> DataFrame:
    """Documents that are not excluded, had no parse error and have a title or a text."""
    full = (F.trim(F.coalesce("title", F.lit(""))) != "") | (F.trim(F.coalesce("text", F.lit(""))) != "")
    return documents.where(F.coalesce("indexable", F.lit(True)) & F.col("parse_error").isNull() & full)


def publication_type(category) -> F.Column:
    low = F.lower(category)
    return F.when(low.isin("news", "article", "review", "blog"), low).otherwise("unknown")


def publish(documents: DataFrame, path: str) -> DataFrame:
    """Write an immutable corpus with dense ids in URL order and a manifest row; fails if it exists or is empty.

    Ids come from ``numbered``, so that no task sees the whole corpus.
    """
    spark = documents.sparkSession
    every = numbered(documents, ["url"], "doc_id").withColumn("doc_id", F.col("doc_id") + 1)
    every.write.mode("errorifexists").parquet(f"{path}/corpus")
    corpus = spark.read.parquet(f"{path}/corpus")
    manifest = corpus.agg(F.count("*").alias("documents"), F.bit_xor(F.xxhash64(*[c for c in corpus.columns if c != "metadata"])).alias("fingerprint"))
    manifest = manifest.withColumn("documents", F.when(F.col("documents") > 0, F.col("documents")).otherwise(F.raise_error(F.lit("nothing to publish")).cast("long")))
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return corpus


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of that content, wherever the path points."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    stream.write(data)
    stream.close()


def read_records(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """A binary snapshot: ``magic``, then records of little-endian u64 id, u32 + source, u64 + title, u64 + text.

    Strict: ids rise from 1 on, sources are identifiers, fields at most 64 MiB, valid UTF-8, nothing left over. One file
    is one task; the result should be published as a corpus.
    """

    def parse(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content):
                data, at, last, rows = bytes(data), len(magic), 0, []
                if data[:at] != magic:
                    raise ValueError(f"{name}: not a snapshot")
                while at < len(data):
                    try:
                        (doc_id,) = struct.unpack_from("<Q", data, at)
                        fields, at = [], at + 8
                        for kind in ("<I", "<Q", "<Q"):
                            (n,) = struct.unpack_from(kind, data, at)
                            at += struct.calcsize(kind)
                            if n > MAX_FIELD or at + n > len(data):
                                raise ValueError(f"{name}: a field is too long")
                            fields.append(data[at : at + n].decode())
                            at += n
                    except struct.error as e:
                        raise ValueError(f"{name}: cut off") from e
                    if not last < doc_id < 1 << 63 or not re.match(SOURCE, fields[0]):
                        raise ValueError(f"{name}: bad record after id {last}")
                    last = doc_id
                    rows.append((doc_id, *fields))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["doc_id", "source", "title", "body"])
                        rows = []
                yield pd.DataFrame(rows, columns=["doc_id", "source", "title", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, CORPUS)


def read_json_documents(spark: SparkSession, root: str, schema: str | T.StructType) -> DataFrame:
    """All JSON files below ``root``, one document each."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(root)


def read_inventory(spark: SparkSession, path: str, hosts: dict[str, str]) -> DataFrame:
    """Inventory rows (source, category, url, sitemap_url) of known sources on their hosts, listing pages left out."""
    from ..functions.web import host, is_listing

    rows = spark.read.csv(path, sep="\t", header=True, schema=INVENTORY)
    allowed = F.create_map(*(F.lit(x) for kv in hosts.items() for x in kv))[F.col("source")]
    on_host = (host(F.col("url")) == allowed) | F.endswith(host(F.col("url")), F.concat(F.lit("."), allowed))
    return rows.where(F.col("url").rlike("^https?://") & on_host & ~is_listing(F.col("url")))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """``source<TAB>url`` lines, ``#`` begins a comment."""
    return spark.read.csv(path, sep="\t", comment="#", schema="source string, url string").where("url is not null")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, loc, lastmod)`` of sitemap files: ``url`` for documents, ``sitemap`` for nested maps.

    Line by line reading can't do here, since maps are often a single line; a file is one row of text.
    """
    files = spark.read.text(path, wholetext=True)
    entry = r"(?s)<(?:\w+:)?(url|sitemap)>(.*?)</(?:\w+:)?(?:url|sitemap)>"
    e = files.select(F.explode_outer(F.regexp_extract_all("value", F.lit(entry), F.lit(0))).alias("e")).where("e is not null")
    part = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?s)<(?:\w+:)?{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{tag}>", 1)), F.lit(""))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return e.select(F.regexp_extract("e", entry, 1).alias("kind"), plain(part("loc")).alias("loc"), part("lastmod").alias("lastmod")).where("loc is not null")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``id<TAB>query`` lines; malformed ids raise."""
    rows = spark.read.csv(path, sep="\t", schema="query_id string, query string", quote="").where("query_id is not null")
    return rows.withColumn("query_id", F.when(F.col("query_id").rlike("^[A-Za-z0-9_-]+$"), F.col("query_id")).otherwise(F.raise_error(F.concat(F.lit("bad query id: "), "query_id"))))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; arrays joined by ``|``; fails if the folder exists."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").csv(path, sep="\t", header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_archive(pages: DataFrame, path: str, records_per_file: int = 50_000) -> DataFrame:
    """Raw pages as sorted, compressed Parquet with a digest each; returns what was written, read back and verified."""
    out = pages.withColumn("archive_sha256", F.sha2(F.col("html").cast("binary"), 256)).repartitionByRange("url").sortWithinPartitions("url")
    out.write.mode("errorifexists").option("maxRecordsPerFile", records_per_file).option("compression", "zstd").parquet(path)
    return verify_archive(pages.sparkSession, path)


def verify_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(pages, broken)``: archived pages, and those whose content does not have its digest."""
    ok = F.sha2(F.col("html").cast("binary"), 256) == F.col("archive_sha256")
    return spark.read.parquet(path).agg(F.count("*").alias("pages"), F.count_if(~F.coalesce(ok, F.col("html").isNull())).alias("broken"))


def archived_page(spark: SparkSession, path: str, url: str) -> DataFrame:
    """One archived page; the files are sorted by URL, so that the scan reads few row groups."""
    return spark.read.parquet(path).where(F.col("url") == url)


def valid_text(column: str) -> F.Column:
    """The text if its bytes are UTF-8; an error with the column's name otherwise."""
    return F.when(F.is_valid_utf8(F.col(column)), F.col(column)).otherwise(F.raise_error(F.lit(f"column {column} is not UTF-8")))


def valid_source(column: str) -> F.Column:
    """Is it an identifier of a source?"""
    return F.coalesce(F.col(column).rlike(SOURCE), F.lit(False))


def latest_snapshot(manifests: DataFrame) -> DataFrame:
    """The path of the newest of ``manifests(path, created_at)``."""
    return manifests.agg(F.max_by("path", F.struct("created_at", "path")).alias("path"))


def read_wordnet_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, lemma)`` from a WordNet database folder: ``index.<pos>`` lines give base forms, ``<pos>.exc`` exceptions."""
    names = {"noun": "n", "verb": "v", "adj": "a", "adv": "r"}
    out = None
    for name, pos in names.items():
        base = spark.read.text(f"{folder}/index.{name}").where(~F.col("value").startswith(" ")).select(F.split("value", " ")[0].alias("w")).where(F.col("w").rlike("^[a-z]+$"))
        base = base.select(F.concat(F.lit(f"{pos}:"), "w").alias("key"), F.col("w").alias("lemma"))
        words = spark.read.text(f"{folder}/{name}.exc").select(F.split(F.trim("value"), " +").alias("w")).where((F.size("w") > 1) & F.col("w")[0].rlike("^[a-z]+$"))
        exc = words.select(F.concat(F.lit(f"x:{pos}:"), F.col("w")[0]).alias("key"), F.explode(F.slice("w", 2, 64)).alias("lemma"))
        both = base.unionByName(exc)
        out = both if out is None else out.unionByName(both)
    return out


def read_lexicon_xml(spark: SparkSession, path: str) -> DataFrame:
    """``(key, lemma)`` from a lexicon in XML: ``<lemma><l t="base"/><f t="form"/>...</lemma>`` entries of Cyrillic words."""
    rows = spark.read.format("xml").option("rowTag", "lemma").schema("l struct<_t:string>, f array<struct<_t:string>>").load(path)
    forms = rows.select(F.lower("l._t").alias("lemma"), F.explode(F.transform("f", lambda x: F.lower(x["_t"]))).alias("form"))
    return forms.where(F.col("form").rlike("^[а-яё]+$") & F.col("lemma").rlike("^[а-яё]+$")).select(F.concat(F.lit("ru:"), "form").alias("key"), "lemma").distinct()
