"""Search over an index: hybrid or dense, with filters, and hits as rows or as lines of text."""

from __future__ import annotations

import zlib
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from ..functions.ids import point_id
from ..operators import filters, retrieval

class Profile(Enum):
    HYBRID = "hybrid_rrf"
    DENSE = "dense_clamped"


class HashedEmbedder:
    """Unit vectors of hashed word counts: deterministic, for use without a model; they know no meaning.

    Any object like it serves as an embedder: picklable, with ``dimension`` and ``embed``, from a list of texts to one of
    vectors. A worker keeps one copy, so a model that it loads when first used is loaded once a worker.
    """

    name = "hashed words"

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dimension] += 1 if h >> 31 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)).tolist()


def embedded(chunks: DataFrame, embedder=HashedEmbedder(), column: str = "embed_text", batch: int = 256) -> DataFrame:
    """``chunks`` with dense: an embedder's vectors, ``batch`` texts a call."""
    sent = chunks.sparkSession.sparkContext.broadcast(embedder)

    @pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        own = sent.value  # one copy a worker
        given = texts.fillna("").tolist()
        return pd.Series([v for i in range(0, len(given), batch) for v in own.embed(given[i : i + batch])], dtype=object)

    return chunks.withColumn("dense", vectors(F.col(column)))


def weighted(chunks: DataFrame, model: retrieval.BM25 = retrieval.BM25()) -> DataFrame:
    """``chunks`` with sparse: their terms' weights, which searches read in place of the text."""
    return chunks.withColumn("sparse", F.map_from_entries(retrieval.sparse_vector(F.coalesce("embed_text", "content"), model)))


class Search:
    """Queries against a DataFrame of chunks (columns of the ingestion's table)."""

    def __init__(self, chunks: DataFrame, embedder=HashedEmbedder(), profile: Profile = Profile.HYBRID, fusion: retrieval.Fusion = retrieval.WRITTEN, on_error: str = "raise", model: retrieval.BM25 = retrieval.BM25()):
        """``model`` is that of the chunks' sparse weights; chunks without them are weighed from their texts."""
        self.chunks, self.embedder, self.profile, self.fusion, self.on_error, self.model = chunks, embedder, profile, fusion, on_error, model

    def hits(self, query: str, limit: int = 5, doc_type: str | None = None, repo: str | None = None, language: str | None = None, category: str | None = None, tag: str | None = None) -> DataFrame:
        """Columns of the chunks and score, best first. A blank query has no hits; ``on_error='empty'`` makes failures such too."""
        nothing = self.chunks.limit(0).withColumn("score", F.lit(0.0))
        if not (query or "").strip():
            return nothing
        try:
            return self._hits(query.strip(), limit, filters.metadata(tag=tag, doc_type=doc_type, repo=repo, language=language, category=category))
        except Exception:
            if self.on_error == "empty":
                return nothing
            raise

    def _hits(self, query: str, limit: int, where) -> DataFrame:
        rows, vector = self.chunks.where(where), self.embedder.embed([query])[0]
        one = rows.sparkSession.createDataFrame([(0, query)], "query_id long, text string")
        terms = [(r["term"], r["q"]) for r in retrieval.query_weights(one, model=self.model).collect()]
        alone = self.profile is Profile.DENSE or not terms
        dense = retrieval.dense_top_k(rows.where(F.col("dense").isNotNull()), vector, limit if alone else 2 * limit, column="dense", clamp=self.profile is Profile.DENSE)
        if alone:
            return dense.orderBy(F.desc("score"), "id")
        weighed = rows if "sparse" in rows.columns else weighted(rows, self.model)
        sparse = retrieval.sparse_top_k(weighed.select("id", "sparse"), terms, 2 * limit)
        numbered = [retrieval.top_per_query(x.select(F.lit(0).alias("query_id"), "id", "score"), 2 * limit) for x in (dense, sparse)]
        best = retrieval.fuse(numbered, limit, self.fusion).select("id", "score")
        return rows.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")

    def search_test(self, query: str, doc_type: str | None = None, repo: str | None = None) -> DataFrame:
        """Six hits, with scores of four digits."""
        return self.hits(query, 6, doc_type=doc_type, repo=repo).withColumn("score", F.round("score", 4))

    def _text(self, query: str, limit: int, code: bool, **given: str | None) -> str:
        if not (query or "").strip():
            return "Nothing to search for."
        rows = self.hits(query, limit, doc_type="code" if code else "doc", **given).select(hit_lines().alias("lines")).collect()
        return "\n\n".join(r["lines"] for r in rows) or "No hits."

    def search_code(self, query: str, repo: str | None = None, language: str | None = None, limit: int = 5) -> str:
        return self._text(query, limit, True, repo=repo, language=language)

    def search_docs(self, query: str, repo: str | None = None, category: str | None = None, tag: str | None = None, limit: int = 5) -> str:
        return self._text(query, limit, False, repo=repo, category=category, tag=tag)


def hit_lines() -> Column:
    """A hit (columns of a chunk and score) as lines: its place, name, labels and score, where to read it, and its text, indented."""
    place = F.concat("repo", F.lit("/"), "rel_path", F.coalesce(F.format_string(":%d-%d", "start_line", "end_line"), F.lit("")))
    name = F.coalesce(F.nullif("symbol", F.lit("")), F.nullif("heading", F.lit("Root")))
    labels = F.when(F.size(F.coalesce("tags", F.array())) > 0, F.concat(F.lit("#"), F.array_join("tags", " #")))
    first = F.concat_ws("  ", place, name, labels, F.format_string("%.4f", "score"))
    return F.concat_ws("\n", first, F.col("permalink_url"), F.regexp_replace(F.coalesce("content", F.lit("")), r"(?m)^", "    "))


def points(documents: DataFrame, id_: str = "id") -> DataFrame:
    """``documents`` with ids that are UUIDs."""
    return documents.withColumn(id_, point_id(F.col(id_)))


def sanitized(metadata: DataFrame, column: str = "metadata") -> DataFrame:
    """Without null and empty values of a map of texts."""
    return metadata.withColumn(column, F.map_filter(column, lambda k, v: v.isNotNull() & (v != "") & (v != "[]")))


def predicted(chunks: DataFrame, make, dimension: int, column: str = "embed_text", out: str = "dense", rows: int = 512, characters: int = 200_000) -> DataFrame:
    """``chunks`` with the vectors of a model that ``make()`` loads once in each worker.

    ``make`` gives a function from a list of texts to a list of vectors of ``dimension``. It is called with at most ``rows`` texts
    of together at most ``characters``, or with one longer text. Null texts count as empty. A call that fails is repeated text by
    text; a text whose own call fails, or gives other than ``dimension`` finite numbers, has a null vector and its row stays.
    """
    from pyspark.ml.functions import predict_batch_udf

    def loaded():
        model = make()

        def one(texts: list[str]) -> list:
            got = model(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
            return [np.asarray(v, np.float32) for v in got]

        def predict(texts: np.ndarray) -> np.ndarray:
            given = ["" if t is None else str(t) for t in texts]
            out = np.full((len(given), dimension), np.nan, np.float32)
            i = 0
            while i < len(given):
                j, size = i + 1, len(given[i])
                while j < len(given) and size + len(given[j]) <= characters:
                    size += len(given[j])
                    j += 1
                try:
                    found = one(given[i:j])
                except Exception:  # noqa: BLE001  one text may spoil a call
                    found = []
                    for t in given[i:j]:
                        try:
                            found += one([t])
                        except Exception:  # noqa: BLE001  that text has no vector
                            found.append(None)
                for k, v in enumerate(found):
                    if v is not None and v.shape == (dimension,) and np.isfinite(v).all():
                        out[i + k] = v
                i = j
            return out

        return predict

    vectors = predict_batch_udf(loaded, return_type=ArrayType(FloatType()), batch_size=rows)
    found = chunks.withColumn(out, vectors(F.coalesce(F.col(column), F.lit(""))))
    return found.withColumn(out, F.when(~F.isnan(F.get(out, F.lit(0))), F.col(out)))
