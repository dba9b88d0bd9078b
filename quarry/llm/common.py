"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import ship, table

#: Rows of an Arrow batch that are worked on at once; bounds the Python objects alive in a worker.
ROWS_AT_ONCE = 256


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: T.StructType, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """``df.mapInArrow`` with small slices: ``fn`` gets a record batch and returns the arrays of ``schema``, in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                columns = fn(batch.slice(lo, at_once))
                arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def field(df: DataFrame, name: str, to: str | None = None) -> T.StructField:
    """The field of ``df``, under another name."""
    return T.StructField(to or name, df.schema[name].dataType, True)


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow column's strings; null as none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for the nodes of the undirected ``edges(u, v)``; root is the smallest node reachable.

    Alternating large-star and small-star steps on DataFrames: every step is a grouped minimum (combined before the
    shuffle) and an equi-join that adaptive execution can split, so that a hub with a large share of all edges is no
    bottleneck. Each round is written to the shared folder; only two numbers per round come to the driver. Nulls in
    either end are ignored; so are loops, but their node is returned. Empty edges give an empty result.
    """
    raw = edges.select(F.col("u"), F.col("v")).where("u is not null and v is not null")
    nodes = raw.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = table(raw.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        e = table(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(),
            "edges",
        )
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(e, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("root"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_of(value: Column) -> Column:
    """16 lower-case hex digits of a BIGINT's 64 bits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
