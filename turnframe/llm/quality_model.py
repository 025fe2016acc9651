"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A labelled document's grade is 0 if toxic, 1 if of low quality, else 2.  The
model has one weight for every hashed text feature, shared by all grades, and
two ordered thresholds: P(grade <= k) = sigmoid(theta_k - w.x).  It gives the
expected grade and the tail probability P(grade >= 2), on which documents are
selected.

Features are presence of lower-cased words, of word shapes (letters as ``a``
or ``A``, digits as ``0``: the first two and last three of a word) and of a
word repeated at once;
shapes and repeats count in logarithmic shares of the text.  Only features of
at least ``MIN_DOCS`` training documents whose presence departs from some grade's share
by ``MIN_Z`` standard errors get a weight, so the many words of a long text
that tell nothing add nothing.

The model is fitted in numpy on the driver, on at most ``TRAIN_ROWS`` labelled
documents, those with the smallest hash of their id (only feature numbers are
collected, not texts).  Null labels and ids are left out of training; a table
without two grades gives a model that keeps everything.  Null or empty texts
have no features and are scored by the thresholds alone; very long texts are
scored whole; repeated rows are each scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import texts
from .text import ALNUM, U64, Words, mix, pieces

BITS = 20
TRAIN_ROWS = 20_000
MIN_DOCS = 4
MIN_Z = 4.0
GRADES = 3
SHARES = 6

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A] = ord("0")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")


def _shape_hashes(w: Words) -> np.ndarray:
    """Hash of every word's shape: the set of character kinds it starts
    and ends with, its symbols and whether it is long."""
    kinds = _SHAPE[w.buf]
    n = len(w)
    if not n:
        return np.zeros(0, U64)
    length = w.ends - w.starts
    code = np.zeros(n, U64)
    last = w.ends - 1
    for back in range(3):  # the last three characters tell added symbols
        at = np.maximum(last - back, w.starts)
        code = code * U64(257) + kinds[at].astype(U64) * (length > back)
    code = code * U64(257) + kinds[w.starts]
    second = np.minimum(w.starts + 1, last)
    code = code * U64(257) + kinds[second]
    return mix(code * U64(3) + U64(1))


def features(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature number), each pair once."""
    mask = U64((1 << bits) - 1)
    bare = Words(col, ALNUM, lower=True)
    pairs = [(bare.doc_of().astype(U64) << U64(bits)) | (bare.hashes() & mask)]
    w = Words(col)
    doc, h = w.doc_of(), w.hashes()
    n = np.maximum(w.counts, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    for salt, marks in ((1, _shape_hashes(w)), (2, np.where(again, U64(0x51), U64(0x52)))):
        key = (doc.astype(U64) << U64(bits)) | (mix(marks + U64(salt)) & mask)
        uniq, count = np.unique(key, return_counts=True)
        d = (uniq >> U64(bits)).astype(np.int64)
        # share of the words: 0 for up to 1/32, then doubling
        level = np.clip(np.floor(np.log2(32 * count / n[d])) + 1, 0, SHARES).astype(U64)
        for k in range(SHARES):  # a share also sets all smaller ones
            on = level > k
            f = mix((uniq[on] & mask) * U64(64) + U64(k + 1 + 8 * salt)) & mask
            pairs.append((uniq[on] & ~mask) | f)
    all_ = np.unique(np.concatenate(pairs))
    return (all_ >> U64(bits)).astype(np.int64), (all_ & mask).astype(np.int64)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    """Weights of the used features and the ordered thresholds."""

    used: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self, bits: int = BITS) -> np.ndarray:
        out = np.zeros(1 << bits, np.float64)
        out[self.used] = self.weights
        return out

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade, one row a score."""
        below = np.stack([_sigmoid(t - score) for t in self.thresholds], 1)
        below = np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))])
        return np.diff(below, axis=1)


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, bits: int = BITS, min_docs: int = MIN_DOCS,
        min_z: float = MIN_Z, steps: int = 300, rate: float = 0.1, l2: float = 2e-4) -> OrdinalModel:
    """Maximum likelihood with a small L2 penalty by Adam on all rows;
    grades weigh alike.  doc: row of each (row, feature) pair."""
    n = len(grade)
    freq = np.bincount(feature, minlength=1 << bits)
    if not n or len(np.unique(grade)) < 2:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.array([-4.0, -2.0]))
    share = np.bincount(grade, minlength=GRADES)
    telling = np.zeros(1 << bits, bool)
    for k in range(GRADES):
        q = share[k] / n
        seen = np.bincount(feature[(grade == k)[doc]], minlength=1 << bits)
        telling |= np.abs(seen - q * freq) >= min_z * np.sqrt(freq * q * (1 - q)) + 1e-9
    used = np.flatnonzero((freq >= min_docs) & (freq < n) & telling)
    number = np.full(1 << bits, -1)
    number[used] = np.arange(len(used))
    col = number[feature]
    doc, col = doc[col >= 0], col[col >= 0]
    weigh = (1 / np.sqrt(np.maximum(share, 1)))[grade]
    weigh /= weigh.sum()
    p = np.zeros(len(used) + 2)
    p[-2:] = -2.0, 0.0  # first threshold, log of the step to the second
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        th = np.array([p[-2], p[-2] + np.exp(p[-1])])
        s = np.bincount(doc, weights=p[col], minlength=n)
        edge = np.hstack([np.full((n, 1), -1e9), th[None, :] - s[:, None], np.full((n, 1), 1e9)])
        cdf = _sigmoid(edge)
        slope = cdf * (1 - cdf)
        i = np.arange(n)
        prob = np.maximum(cdf[i, grade + 1] - cdf[i, grade], 1e-12)
        up, low = slope[i, grade + 1] / prob, slope[i, grade] / prob
        g = np.empty_like(p)
        ds = weigh * (up - low)  # derivative of -log p by the score
        g[:-2] = np.bincount(col, weights=ds[doc], minlength=len(used)) + l2 * p[:-2]
        by_edge = [-(weigh * up * (grade == k)).sum() + (weigh * low * (grade == k + 1)).sum() for k in range(2)]
        g[-2], g[-1] = sum(by_edge), by_edge[1] * np.exp(p[-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-10) * min(1.0, 3 * (1 - t / (steps + 1)))
    return OrdinalModel(used, p[:-2], np.array([p[-2], p[-2] + np.exp(p[-1])]))


def _featurize(batches):
    for b in pieces(batches, 1):
        doc, feature = features(b.column(1))
        edges = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(feature.astype(np.int32)))],
            names=["grade", "features"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fits the model on labelled documents (doc_id, quality, toxic)."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select(F.col("doc_id").cast("long").alias("l_id"), grade.cast("long").alias("grade")) \
        .where("l_id is not null and grade is not null").groupBy("l_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("l_id"), "l_id").limit(train_rows)
    rows = texts(docs, "doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")) \
        .select("grade", "text").mapInArrow(_featurize, "grade long, features array<int>").toArrow()
    lists = rows.column("features").combine_chunks()
    grades = rows.column("grade").to_numpy().astype(np.int64)
    lengths = np.array([len(x) for x in lists], np.int64) if len(lists) else np.zeros(0, np.int64)
    feature = lists.flatten().to_numpy().astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(grades)), lengths)
    return fit(doc, feature, grades)


def _score(shared):
    def run(batches):
        model = shared.value
        dense = model.dense()
        for b in pieces(batches, 1):
            doc, feature = features(b.column(1))
            p = model.grades(np.bincount(doc, weights=dense[feature], minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p @ np.arange(GRADES)), pa.array(p[:, 2]), pa.array(p[:, 2] >= KEEP)],
                names=["doc_id", "expected_grade", "tail_probability", "kept"])
    return run


KEEP = 0.5
SCHEMA = "doc_id long, expected_grade double, tail_probability double, kept boolean"


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs, "doc_id", "text").mapInArrow(_score(shared), SCHEMA)


def keep_good(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents that the model keeps, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        dense = shared.value.dense()
        for b in pieces(batches, at):
            doc, feature = features(b.column(at))
            p = shared.value.grades(np.bincount(doc, weights=dense[feature], minlength=b.num_rows))
            yield b.filter(pa.array(p[:, 2] >= KEEP))

    return docs.mapInArrow(run, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
