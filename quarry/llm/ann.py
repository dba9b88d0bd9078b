"""Approximate nearest neighbours by collision counting (query-aware hashing).

Each of ``HASHES`` directions gives one array of the vectors' projections, sorted; directions come in orthonormal
sets, as many as the dimension allows in each, which makes the number of collisions depend on the distance more
sharply than independent ones. A query's windows are centred on its own projections; virtual rehashing widens all
windows by the factor ``RATIO`` from level to level. A vector that falls into a window collides once for that
direction; vectors with at least ``THRESHOLD`` of all possible collisions are verified by their exact distance. A search
ends when ``k`` verified vectors lie within the level's radius or when the windows hold everything, so there is no cap
on candidates.

Distribution: the stated queries are held against all rows in blocks. Vectors are spread over blocks of about
``BLOCK`` rows by a hash, queries over blocks of ``QUERY_BLOCK``, larger than most query sets, so that vectors are
rarely copied; every pair of blocks is one bounded task that builds its sorted arrays once, searches and returns k rows
per query, and a grouped minimum of k merges them. Nothing but the number of rows reaches the driver.

Defined results: vectors that are null, all zero or hold null or non-finite components are neither queries nor
candidates; only vectors of a query's own length are its candidates. Every different row is a candidate of all queries
but those of its own id, so that an id with two vectors can be found twice; an equal row counts once. Of a query id's
vectors the smallest (in array order) is searched. A query has fewer than k rows if there are fewer candidates; ties
go to the smaller id; null ids take no part; an empty table gives an empty result; columns other than id and vector
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

HASHES, RATIO = 128, 1.1
#: Share of the hashes that have to collide, and the window's half-width per unit of radius and square root of the
#: vectors' length: a gap of that radius projects to that many standard deviations.
THRESHOLD, WIDTH = 0.77, 1.25
#: Share of a block that the first windows hold.
START = 0.3
BLOCK, QUERY_BLOCK, SEED = 32768, 65536, 20240
_ROW = "query_id long, vec_id long, score double"


def directions(hashes: int, size: int, seed: int = SEED) -> np.ndarray:
    """Unit vectors in orthonormal sets of at most ``size``."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-hashes // size))] if size <= hashes else [np.linalg.qr(rng.standard_normal((size, hashes)))[0].T]
    return np.concatenate(sets)[:hashes]


class Index:
    """Sorted projection arrays over one block of vectors, all of the same length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hashes: int = HASHES, seed: int = SEED):
        self.ids, self.vectors = ids, vectors
        self.directions = directions(hashes, vectors.shape[1], seed)
        projected = self.directions @ vectors.T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def search(self, query: np.ndarray, k: int, own: int | None = None, threshold: float = THRESHOLD, width: float = WIDTH, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and exact distances of the ``k`` nearest vectors found, ties to the smaller id; how many were verified."""
        n, m = len(self.ids), len(self.directions)
        at = self.directions @ query
        need = int(np.ceil(threshold * m))
        width = width / np.sqrt(self.vectors.shape[1])
        counts = np.zeros(n, np.int64)
        done = np.zeros(n, bool)
        if own is not None:
            done[self.ids == own] = True
        lo = np.array([s.searchsorted(a) for s, a in zip(self.sorted, at)])
        hi = lo.copy()
        reach = max(1, int(START * n) // 2)
        every = np.arange(m)
        gaps = np.minimum(np.abs(self.sorted[every, np.minimum(lo + reach, n - 1)] - at), np.abs(self.sorted[every, np.maximum(lo - reach, 0)] - at))
        radius = max(float(np.median(gaps)) / width, float(np.linalg.norm(query)) * 1e-6, 1e-300)
        ids, distances = self.ids[:0], np.zeros(0)
        while True:
            half = radius * width
            fresh = []
            for j, (row, centre) in enumerate(zip(self.sorted, at)):
                a, b = min(row.searchsorted(centre - half, "left"), lo[j]), max(row.searchsorted(centre + half, "right"), hi[j])
                fresh += [self.order[j, a : lo[j]], self.order[j, hi[j] : b]]
                lo[j], hi[j] = a, b
            counts += np.bincount(np.concatenate(fresh), minlength=n)
            hit = np.flatnonzero((counts >= need) & ~done)
            if len(hit):
                done[hit] = True
                ids = np.concatenate([ids, self.ids[hit]])
                gap = self.vectors[hit] - query
                distances = np.concatenate([distances, np.sqrt(np.einsum("ij,ij->i", gap, gap))])
            full = (lo == 0).all() and (hi == n).all()
            if full or (len(ids) >= k and np.partition(distances, k - 1)[k - 1] <= radius):
                best = np.lexsort((ids, distances))[:k]
                return ids[best], distances[best], len(ids)
            radius *= ratio


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("_v")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v")).where("vec_id is not null and _v is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return kept.where(F.coalesce(fine, F.lit(False)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK, threshold: float = THRESHOLD, width: float = WIDTH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of ``vectors`` found for each row of ``queries``.

    Both have ``id_col`` and ``vec_col``; rows with a query's own id are no candidates of it.
    """
    ship(vectors.sparkSession)
    rows, asked = _usable(vectors, id_col, vec_col), _usable(queries, id_col, vec_col)
    blocks = max(1, -(-vectors.count() // block))
    query_blocks = max(1, -(-queries.count() // query_block))
    size = F.size("_v")
    here = rows.withColumn("b", F.pmod(F.xxhash64("vec_id", "_v"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("d", size)
    # A query id's vectors are put into one block, where the smallest is chosen.
    there = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("d", size)

    def each(pdf: pd.DataFrame, one: bool) -> pd.DataFrame:
        """Different rows by id and vector; only the first of an id if ``one``."""
        if pdf.vec_id.duplicated().any():
            pdf = pdf.assign(t=[tuple(v) for v in pdf._v]).sort_values(["vec_id", "t"], kind="stable").drop_duplicates(["vec_id"] if one else ["vec_id", "t"])
        return pdf.sort_values("vec_id", kind="stable")

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            q, v = each(q, True), each(v, False)
            index = Index(v.vec_id.to_numpy(), np.stack(v._v.to_list()).astype(np.float64))
            for own, vector in zip(q.vec_id, q._v):
                ids, scores, _ = index.search(np.asarray(vector, dtype=np.float64), k, own, threshold, width)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ("q", "b", "d")
    found = there.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInPandas(search, _ROW)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast(T.IntegerType())
    # Queries of one id but different lengths are searches of their own; the id keeps its k nearest.
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
