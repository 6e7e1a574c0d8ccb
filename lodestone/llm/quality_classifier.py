"""Quality classifier: nearest neighbours vote among labelled latent-semantic vectors.

Terms are hashed byte trigrams, hashed words, and shape terms: a text's statistics (repetition, symbols, capitals and so
on) in bins between quantiles of the sample. Logarithmic counts are weighted by inverse document frequency, normalised,
and projected to latent axes by a truncated singular value decomposition. Axes and labelled vectors come from a bounded
sample (``per_class`` labelled rows of each class outside the held-out fold), so what is broadcast has a fixed size. Each
document's cosines with all labelled vectors are computed exactly, block by block; the ``neighbours`` nearest vote with
their similarity to the power ``sharpness``.

One pass over the texts without a shuffle; memory follows a block of about 1 MB or the longest document. Defined results:
a null or empty text has shape terms only and is scored by them; repeated rows get one result row each; without labelled
rows every score is 0.5; of labelled vectors that tie for the last place among the neighbours any may vote; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import held_out, labelled_sample, table
from ._text import LOWER, Block, Hasher, U, blocks
from .quality_rules import FEATURES, statistics

GRAMS, WORDS, BINS = 2048, 2048, 8
TERMS = GRAMS + WORDS + len(FEATURES) * (BINS + 1)


def raw_counts(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed trigrams and words (n x 4096), and the shape statistics."""
    n = b.n
    owner = np.repeat(np.arange(n), np.diff(b.at))
    x = b.data.astype(np.uint32)
    out = np.zeros((n, GRAMS + WORDS), np.float32)
    if len(x) > 2:
        code = ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)).astype(np.int64)
        inside = owner[2:] == owner[:-2]
        out[:, :GRAMS] = np.bincount((owner[:-2] * GRAMS + code)[inside], minlength=n * GRAMS).reshape(n, GRAMS)
    start, end, at = b.words()
    word = (Hasher(LOWER[b.data])(start, end) % U(WORDS)).astype(np.int64)
    out[:, GRAMS:] = np.bincount(np.repeat(np.arange(n), np.diff(at)) * WORDS + word, minlength=n * WORDS).reshape(n, WORDS)
    return out, statistics(b)[1]


@dataclass
class Space:
    """The latent space with the labelled vectors in it."""

    edges: np.ndarray  # len(FEATURES) x BINS
    weight: np.ndarray  # of each term
    axes: np.ndarray  # TERMS x rank
    vectors: np.ndarray  # labelled rows x rank, unit length
    labels: np.ndarray
    vote: np.ndarray  # a labelled row's weight, for its class's share

    def terms(self, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        x = np.zeros((len(counts), TERMS), np.float32)
        np.log1p(counts, out=x[:, : GRAMS + WORDS])
        row = np.arange(len(counts))
        for j in range(shape.shape[1]):
            x[row, GRAMS + WORDS + j * (BINS + 1) + np.searchsorted(self.edges[j], shape[:, j])] = 1
        x *= self.weight
        # text and shape terms count equally, whatever the length
        for part in (slice(0, GRAMS + WORDS), slice(GRAMS + WORDS, TERMS)):
            x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, shape: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        out = np.empty(len(counts))
        k = min(neighbours, len(self.labels))
        for i in range(0, len(counts), 512):
            near = self.project(self.terms(counts[i : i + 512], shape[i : i + 512])) @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** sharpness * self.vote[best]
            out[i : i + 512] = (w * self.labels[best]).sum(1) / w.sum(1)
        return np.clip(out, 0.0, 1.0)


def train(documents: DataFrame, labels: DataFrame, per_class: int = 2000, rank: int = 64, seed: int = 7) -> Space:
    """The space from at most ``per_class`` labelled documents of each class, taken in hash order."""
    sample = labelled_sample(documents, labels, "quality", per_class)

    def rows(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                counts, shape = raw_counts(b)
                part = batch.slice(b.first, b.n)
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([i.astype(np.int16).tobytes() for i in at], pa.binary()), pa.array([c[i].astype(np.float32).tobytes() for c, i in zip(counts, at)], pa.binary()), pa.array([s.tobytes() for s in shape], pa.binary())], names=["doc_id", "label", "at", "n", "shape"])

    got = sorted(sample.mapInArrow(rows, "doc_id long, label int, at binary, n binary, shape binary").collect(), key=lambda r: r["doc_id"])
    shape = np.array([np.frombuffer(r["shape"], np.float64) for r in got]).reshape(len(got), len(FEATURES))
    y = np.array([r["label"] for r in got], np.float64)
    known = {r["label"]: r["n"] for r in labels.where(~held_out()).groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n")).collect()}
    edges = np.quantile(shape, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T if len(got) else np.zeros((len(FEATURES), BINS))
    share = {c: known.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    space = Space(edges, np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, np.array([share[int(c)] for c in y]))
    if not len(got):
        return space
    counts = np.zeros((len(got), GRAMS + WORDS), np.float32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["n"], np.float32)
    del got
    holders = np.concatenate([(counts > 0).sum(0), (space.terms(np.zeros((len(y), GRAMS + WORDS), np.float32), shape) > 0).sum(0)[GRAMS + WORDS :]])
    space.weight = np.log((1 + len(y)) / (1 + holders)).astype(np.float32) + np.float32(0.1)
    x = space.terms(counts, shape)
    del counts
    # randomised subspace iteration for the leading right singular vectors
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    space.axes = np.ascontiguousarray((q @ vt.T)[:, :rank])
    space.vectors = space.project(x)
    return space


def assess(documents: DataFrame, space: Space, neighbours: int = 15, sharpness: float = 8.0, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; needs columns doc_id and text."""
    sent = documents.sparkSession.sparkContext.broadcast(space)

    def rows(batches):
        for batch in batches:
            ids, fold = batch.column("doc_id"), batch.column("held_out")
            for b in blocks(batch.column("text")):
                score = sent.value.score(*raw_counts(b), neighbours, sharpness)
                yield pa.RecordBatch.from_arrays([ids.slice(b.first, b.n), fold.slice(b.first, b.n), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ready = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return ready.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the quality score of every document."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return assess(documents, train(documents, table(spark, sf_dir, "labels", "doc_id", "quality")))
