"""An inverted file of vectors: lists around centroids, of which a search reads those nearest to its queries.

Centroids are fitted on the driver by spherical k-means on a sample of at most ``SAMPLE`` vectors, taken in the order of a hash
of the id; then every row is put into the list of its nearest centroid in one scan and written to that list's partition. A
search takes, for each query, the ``probes`` nearest lists, prunes the table to their partitions, and scores each row of a list
against the queries that probe it, by exact cosine. Rows of a list that are many are spread over files and tasks. More probes
mean more recall; with all lists the result is that of the exact search. How much recall so many probes give is measured on
the sample when the index is written, and ``probes_for`` tells how many a wanted recall takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import _rows, top_per_query

#: Vectors that centroids are fitted on, and queries in one pass, at most; vectors of the sample that recall is measured with.
SAMPLE, QUERIES, TRIED = 20_000, 4096, 400


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit vectors of at most ``lists`` clusters; an empty cluster takes a vector that lies far from its own."""
    x = _unit(sample[np.linalg.norm(sample, axis=1) > 0])
    x = np.unique(x, axis=0)
    lists = min(lists, len(x))
    if not lists:
        return np.zeros((0, sample.shape[1]))
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = x[near.max(1).argsort(kind="stable")[: len(empty)]]
        c = _unit(sums)
    return c


def recall_curve(sample: np.ndarray, book: np.ndarray, k: int) -> np.ndarray:
    """The share of the sample's first k of some of its own vectors that the nearest 1, 2, … lists hold."""
    x = np.unique(_unit(sample), axis=0)
    asked = x[np.random.default_rng(9).permutation(len(x))[:TRIED]]
    own = (x @ book.T).argmax(1)
    place = np.argsort(np.argsort(-(asked @ book.T), 1, kind="stable"), 1)
    first = np.argsort(-(asked @ x.T), 1, kind="stable")[:, :k]
    needed = np.take_along_axis(place, own[first], 1)
    return np.array([(needed < p).mean() for p in range(1, len(book) + 1)]) if len(x) else np.ones(len(book))


class VectorIndex:
    """Vectors of one length under ``path``: ``lists`` by centroid, and the centroids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        self.centroids, self.recall = np.array([r["c"] for r in rows], float), np.array([r["recall"] for r in rows])

    @classmethod
    def write(cls, df: DataFrame, path: str, lists: int, id_: str = "id", column: str = "embedding", k: int = 10) -> VectorIndex:
        """Indexes the rows that have a vector; their columns ``id_`` and ``column`` are kept as id and v. Recall is that of the first ``k``."""
        spark = df.sparkSession
        rows = df.where(F.size(column) > 0).select(F.col(id_).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        sample = _rows(picked["v"].combine_chunks()) if picked.num_rows else np.zeros((0, 1))
        book = centroids(sample, lists)
        book = book if len(book) else np.zeros((1, sample.shape[1]))
        sent = spark.sparkContext.broadcast(book)

        def assigned(batches):
            for batch in batches:
                if batch.num_rows:
                    own = (_unit(_rows(batch.column("v"), sent.value.shape[1])) @ sent.value.T).argmax(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["id", "v", "list"])

        # ranges of (list, id): a file has few lists, a long list has several files
        rows.mapInArrow(assigned, "id long, v array<double>, list int").repartitionByRange("list", "id").write.partitionBy("list").parquet(f"{path}/lists")
        curve = recall_curve(sample, book, k)
        spark.createDataFrame([(i, c.tolist(), float(r)) for i, (c, r) in enumerate(zip(book, curve))], "list int, c array<double>, recall double").coalesce(1).write.parquet(f"{path}/centroids")
        return cls(spark, path)

    def probes_for(self, recall: float) -> int:
        """The least number of probes that had such a recall on the sample; all lists, where none had."""
        good = np.flatnonzero(self.recall >= recall)
        return int(good[0]) + 1 if len(good) else len(self.centroids)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, list int").parquet(f"{self.path}/lists")

    def top(self, queries: DataFrame, k: int, probes: int, digits: int = 6) -> DataFrame:
        """(query_id, id, score, rank) of the first k rows in the lists that each query (query_id, vector) probes, ties by id."""
        given = queries.where(F.size("vector") > 0).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        n = -(-given.count() // QUERIES)
        out = None
        for p in range(max(n, 1)):
            block = given.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == p) if n > 1 else given
            found = self._part(block.toArrow(), k, probes, digits)
            out = found if out is None else out.unionByName(found)
        return top_per_query(out, k)

    def _part(self, block: pa.Table, k: int, probes: int, digits: int) -> DataFrame:
        names = block["query_id"].to_pylist()
        vectors = _unit(_rows(block["vector"].combine_chunks(), self.centroids.shape[1])) if names else np.zeros((0, self.centroids.shape[1]))
        near = vectors @ self.centroids.T
        probed = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        asks: dict[int, np.ndarray] = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}
        sent = self.spark.sparkContext.broadcast((names, vectors, asks))

        def best(batches):
            names, vectors, asks = sent.value
            held_s = np.full((len(names), 0), -np.inf)
            held_i = np.zeros((len(names), 0), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "list"))
                x = _unit(_rows(batch.column("v"), vectors.shape[1]))
                s = np.full((len(names), len(ids)), -np.inf)
                for c in np.unique(own):
                    rows, q = np.flatnonzero(own == c), asks[int(c)]
                    s[np.ix_(q, rows)] = np.round(vectors[q] @ x[rows].T, digits)
                s, i = np.concatenate([held_s, s], 1), np.concatenate([held_i, np.broadcast_to(ids, s.shape)], 1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                held_s, held_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            some = np.isfinite(held_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), some.sum(1)) if names else [], pa.int64()), pa.array(held_i[some], pa.int64()), pa.array(held_s[some], pa.float64())], names=["query_id", "id", "score"])

        rows = self.rows().where(F.col("list").isin(sorted(asks)) if asks else F.lit(False))
        return rows.mapInArrow(best, "query_id long, id long, score double")
