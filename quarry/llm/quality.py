"""Quality classifier: regularised quadratic discriminant over document statistics.

A text's statistics (lengths, repetition, character classes, compressibility) are transformed to near-normal scale and
standardised. Each class has a mean and a covariance, shrunk first towards the covariance pooled over both classes and
then towards a multiple of the identity; the score is the logistic of the difference of the two Gaussian log-densities
(Mahalanobis distance by a cached Cholesky factor, plus log-determinant and log-prior), tempered by one factor fitted
on the training rows. Labels, language, source and id are no inputs.

Fit: on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id, so that the sample is the same on
every run; rows held out by ``crc32(id) mod 5 = 0`` are never learnt from. Scoring covers every whole text.

Defined results: a null text scores as the empty one; null ids are scored (held_out false) and never learnt from;
repeated rows are scored row by row; an id is learnt from once for each of its labels, however many rows it has; an
empty table gives an empty result; without two labelled rows of each class every score is 0.5; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, field, texts

#: Labelled rows that the fit uses at most.
SAMPLE = 8000
THRESHOLD = 0.3
SHRINK_POOLED, SHRINK_IDENTITY = 0.2, 0.02
_END = re.compile(r"[.,;:!?…]+$")
_KINDS = np.zeros(256, np.int64)  # by byte: 1 upper, 2 lower, 3 digit, 4 blank, 5 new line, 6 sentence mark, 7 other ASCII, 0 not ASCII
for _b in range(128):
    _c = chr(_b)
    _KINDS[_b] = 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".,;:'\"-()?" else 7


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; finite for every text."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=8)
    letters = kinds[0] + kinds[1] + kinds[2] + 1
    words = text.split()
    m = len(words)
    lines = text.split("\n")
    different = len(set(words))
    again = sum(map(str.__eq__, words, words[1:])) if m > 1 else 0
    pairs = len(set(zip(words, words[1:], words[2:]))) if m > 2 else 0
    lengths = np.fromiter(map(len, words), np.float64, m) if m else np.zeros(1)
    root = lambda x: float(np.sqrt(max(0.0, x)))
    log = lambda x: float(np.log1p(x))
    return [
        log(m),
        different / (m + 1.0) + 0.1 * log(m),
        root(again / (m + 1.0)),
        root(1 - (pairs + 2.0) / (m + 2.0)),
        root(kinds[1] / letters),
        root(kinds[7] / (n + 1.0)),
        root(kinds[3] / (n + 1.0)),
        root(kinds[6] / (m + 1.0)),
        root(kinds[0] / letters),
        root(kinds[5] / (m + 1.0)),
        root(1 - len(set(lines)) / (len(lines) + 0.0)),
        log(float(lengths.mean())),
        log(float(lengths.std())),
        log(float(lengths.max())),
        len(zlib.compress(raw, 1)) / (n + 20.0),
    ]


@dataclass
class Model:
    """Everything a score needs; ``factors`` are inverses of the Cholesky factors of the class covariances."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    offset: float
    temper: float
    bias: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        d0, d1 = (np.einsum("ij,ij->i", y, y) for y in ((z - m) @ f.T for m, f in zip(self.means, self.factors)))
        return 0.5 * (d0 - d1) + self.offset

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.temper * self.margins(x) + self.bias, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, shrink_pooled: float = SHRINK_POOLED, shrink_identity: float = SHRINK_IDENTITY) -> Model | None:
    """None if a class has fewer than two rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / scale, -12, 12)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    share = np.array([(y == k).mean() for k in (0, 1)])
    pooled = share[0] * own[0] + share[1] * own[1]
    means, factors, logdet = [], [], []
    for k in (0, 1):
        c = (1 - shrink_pooled) * own[k] + shrink_pooled * pooled
        c = (1 - shrink_identity) * c + shrink_identity * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
        chol = np.linalg.cholesky(c)
        means.append(z[y == k].mean(0))
        factors.append(np.linalg.inv(chol))
        logdet.append(2 * np.log(np.diag(chol)).sum())
    offset = 0.5 * (logdet[0] - logdet[1]) + float(np.log(share[1] / share[0]))
    model = Model(centre, scale, tuple(means), tuple(factors), offset, 1.0, 0.0)
    m = np.clip(model.margins(x), -200, 200)
    a, b = 0.2, 0.0
    for _ in range(100):  # Newton steps of a two-parameter logistic fit, with a small ridge
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * m).sum() - 1e-2 * a, (y - p).sum() - 1e-2 * b])
        h = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 0.5 / (np.abs(step).max() + 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.temper, model.bias = (float(max(a, 1e-3)), float(b)) if np.isfinite([a, b]).all() else (0.2, 0.0)
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on the ``sample`` labelled rows, not held out, whose hashed ids are smallest.

    The ids are chosen from the labels alone, and only their rows' texts are turned into statistics, on the executors:
    what reaches the driver is one row of numbers for each chosen id and label. Of an id with several texts, the one
    with the smallest hash is learnt from.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))
    rows = rows.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))).alias("r")).select("_y", "r.t")
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = arrow_map(rows, lambda b: [b.column(0), [statistics(t) for t in texts(b.column(1))]], schema).orderBy("y", "x").toPandas()
    if not len(got):
        return None
    return fit(np.array(got.x.tolist(), dtype=np.float64), got.y.to_numpy())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score``; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kB, whatever the input
    kept = [c for c in docs.columns if c != "score"]
    at = kept.index(text_col)

    def fn(batch: pa.RecordBatch) -> list:
        m = sent.value
        if m is None:
            values = [0.5] * batch.num_rows
        else:
            values = m.scores(np.array([statistics(t) for t in texts(batch.column(at))], dtype=np.float64))
        return [*batch.columns, pa.array(values, pa.float64())]

    return arrow_map(docs.select(*kept), fn, T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))
