"""Operator 10: quality by nearest-neighbour voting on latent-semantic vectors.

Terms of a text are hashed into fixed blocks: the shape of its characters
(letters collapse to one class each, punctuation stays; trigrams of the
collapsed run), words that repeat their predecessor or the line before, and
the words themselves. Log term frequencies times inverse document frequencies
are projected on the leading right singular vectors of a bounded labelled
sample. The sample's own vectors are broadcast, and every document is compared
with all of them by exact blocked cosine products; the labels of its nearest
neighbours vote, weighted by a power of similarity.

Fit: at most ``sample`` rows of either label, the first by a hash of the id,
among labelled rows that are not held out (crc32 of the id as text, mod 3, is
1). Everything else covers all rows. Scores read the text alone.

Behaviour: null, empty and blank texts have no terms and score 0; labels that
are null, repeated or of unknown documents are ignored; if one label (or both)
has no rows, every text with terms scores the label's value (or 1); repeated
rows get equal scores; of a doc_id that repeats, the fit reads the smallest
text; rows without doc_id are scored like all others; very long texts are read
whole; an empty table gives no rows; columns named ``score`` or ``predicted``
are replaced by ``score_quality``, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.scratch import bounded
from corpusloom.llm.textcore import Hasher, ascii_space, encode, mix

SHAPES, WORDS, MARKS = 1024, 448, 64
TERMS = SHAPES + WORDS + MARKS
RANK = 64
#: Labelled rows of either label that are fitted on and broadcast (2 x 2048 x 64 floats: 1 MB).
SAMPLE = 2048
NEIGHBOURS, POWER = 24, 8

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[[9, 11, 12, 13]] = 32
_CLASS[128:] = ord("a")


def _per_text(owner: np.ndarray, term: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.bincount(owner * width + term, minlength=n * width).reshape(n, width).astype(np.float32)


def term_counts(texts: list[bytes], hasher: Hasher) -> np.ndarray:
    """Counts of all hashed terms, a row per text."""
    n = len(texts)
    out = np.zeros((n, TERMS), np.float32)
    words, begin = hasher.words(texts)
    owner = np.repeat(np.arange(n), np.diff(begin))
    if len(words):
        out[:, SHAPES : SHAPES + WORDS] = _per_text(owner, (words % np.uint64(WORDS)).astype(np.int64), n, WORDS)
        # how often a word equals the one 1, 2, 3... places before, in levels of its share
        for lag in range(1, 5):
            same = np.zeros(len(words), bool)
            same[lag:] = (words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])
            out[:, SHAPES + WORDS + lag] = np.bincount(owner[same], minlength=n)
    at, size = 0, 0
    for k in range(n + 1):  # shapes in pieces that stay in cache
        if k == n or size > 1 << 20:
            group = texts[at:k]
            if group:
                buf = _CLASS[np.frombuffer(b"".join(group), np.uint8)]
                own = np.repeat(np.arange(at, k), [len(t) for t in group])
                keep = np.ones(len(buf), bool)
                keep[1:] = (buf[1:] != buf[:-1]) | (own[1:] != own[:-1])
                buf, own = buf[keep].astype(np.uint64), own[keep]
                if len(buf) > 2:
                    inside = own[2:] == own[:-2]
                    tri = mix((buf[:-2] << np.uint64(16) | buf[1:-1] << np.uint64(8) | buf[2:])[inside]) % np.uint64(SHAPES)
                    out[at:k, :SHAPES] += _per_text(own[2:][inside] - at, tri.astype(np.int64), k - at, SHAPES)
            at, size = k, 0
        if k < n:
            size += len(texts[k])
    return out


class Model:
    """Projection and labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray) -> None:
        n = max(1, len(labels))
        self.idf = np.log1p(n / (1.0 + (counts > 0).sum(axis=0))).astype(np.float32)
        w = self._weigh(counts)
        _, vectors = np.linalg.eigh((w.T @ w).astype(np.float64))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :RANK]).astype(np.float32)
        self.vectors = self._unit(w @ self.basis)
        self.labels = labels.astype(np.float32)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        """Unit rows in each block: shares of terms, so that length plays no part."""
        w = np.empty_like(counts)
        blocks = ((0, SHAPES, 1.0), (SHAPES, SHAPES + WORDS, 0.3))
        for a, b, scale in blocks:
            part = np.sqrt(counts[:, a:b]) * self.idf[a:b]
            norm = np.linalg.norm(part, axis=1, keepdims=True)
            w[:, a:b] = scale * part / np.where(norm > 0, norm, 1)
        total = counts[:, SHAPES : SHAPES + WORDS].sum(axis=1, keepdims=True)
        w[:, SHAPES + WORDS :] = 2 * np.sqrt(counts[:, SHAPES + WORDS :] / np.maximum(total, 1))
        return w

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(norm > 0, norm, 1)).astype(np.float32)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(counts))
        full = np.flatnonzero(counts.any(axis=1))
        if not len(full):
            return out
        if len(set(self.labels.tolist())) < 2:
            out[full] = self.labels[0] if len(self.labels) else 1.0
            return out
        cosine = self._unit(self._weigh(counts[full]) @ self.basis) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3).astype(np.float64) ** POWER
        out[full] = np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)
        return out


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    bounded(spark)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    picked = None
    for label in (0, 1):
        own = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = own if picked is None else picked.unionAll(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(ascii_space())
        for b in batches:
            rows = term_counts([encode(t) for t in b.column(2).to_pylist()], hasher)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.astype(np.float32).tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "counts"])

    # bounded: 2 x sample ids are broadcast, as many rows of counts collected
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a document that repeats counts once
    rows = sorted(once.mapInArrow(run, "doc_id long, quality int, counts binary").collect())
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), np.float32).reshape(-1, TERMS)
    return Model(counts, np.array([r["quality"] for r in rows]))


def score_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a text, as a column."""
    bounded(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(ascii_space())
        for b in batches:
            yield pd.Series(shared.value.scores(term_counts([encode(t) for t in b.astype(object).where(b.notna(), None)], hasher)), dtype="float64")

    return F.pandas_udf(run, "double")(text.cast("string"))


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    return docs.withColumn("score", score_of(F.col(text), model, docs.sparkSession)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
