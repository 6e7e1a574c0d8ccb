"""Vector code compression: product codes of integer vectors, their codebooks kept by delta-maintained Lloyd rounds.

A vector's components become integers, its four parts a byte each: the index of the nearest entry in that part's codebook.
Codebooks start as the parts of the rows with the smallest ids. The table of vectors with their last assignments and the
entries' running sums (a count and an integer for each component) are written each round. A round assigns every part anew in
one scan and then shuffles only contributions of parts whose assignment changed: minus for the old entry, plus for the new
one, added up inside each task, so at most a row an entry leaves it. Sums of integers are exact, so they equal those of a
full pass. The driver holds the codebooks, ``PARTS * ENTRIES`` entries, never vectors of the corpus beyond the first ones.

Distances are integers: by products of doubles where these are exact for the block's largest component, else of longs.

Defined results: rows are dropped whose vector is null, empty, of a length that four does not divide, or of another length
than the kept row with the smallest id, or that hold null or non-finite components. Components whose integer is beyond
2^26 either way are held there, so that errors stay exact. Null ids come last among the first entries, rows of equal ids
go by their vectors. Repeated rows get a result each. With fewer than 256 kept rows there are as many entries. An empty table
gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import new_path, remove, written
from ._tables import table

PARTS, ENTRIES, SCALE, ROUNDS = 4, 256, 1024, 4
_MOST = 1 << 26


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of one width as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows whose vectors can be coded: floor(1024 x) of each component."""

    def rows(batches):
        for batch in batches:
            column = batch.column("embedding")
            n = len(column)
            length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = column.flatten()
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(n), length)
            good = (length > 0) & (length % PARTS == 0) & (np.bincount(owner, ~np.isfinite(x), n) == 0)
            taken = good[owner]
            v = np.clip(np.floor(x[taken] * SCALE), -_MOST, _MOST).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(length[good])]).astype(np.int32)
            pick = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pick), batch.column("label").filter(pick), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v))], names=["vec_id", "label", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>")).mapInArrow(rows, "vec_id long, label int, v array<int>")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``x``: the index of the nearest row of ``book``, the lower one of equals, and the squared distance."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    far = (b * b).sum(1) - 2 * (a @ b.T)
    at = far.argmin(1)
    return at, (far[np.arange(len(x)), at] + (a * a).sum(1)).astype(np.int64)


def _assigned(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vectors`` with ``was`` from ``now``, the nearest entries as ``now`` and the ``error``."""
    parts, _, width = books.shape

    def rows(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), parts * width)
            now, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for k in range(parts):
                at, far = nearest(x[:, k * width : (k + 1) * width], books[k])
                now[:, k] = at
                error += far
            codes = pa.array([c.tobytes() for c in now], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), batch.column("now"), codes, pa.array(error)], names=["vec_id", "label", "v", "was", "now", "error"])

    return vectors.select("vec_id", "label", "v", "now").mapInArrow(rows, "vec_id long, label int, v array<int>, was binary, now binary, error long")


def changes(assigned: DataFrame, entries: int, width: int) -> DataFrame:
    """(part, entry, n, sums): for each task, what changed assignments add to and take from an entry's count and sums."""

    def rows(batches):
        total = np.zeros((PARTS * entries, width + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), PARTS * width)
            now = np.frombuffer(b"".join(batch.column("now").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
            first = batch.column("was").is_null().to_numpy(zero_copy_only=False)
            was = np.frombuffer(b"".join(w or bytes(PARTS) for w in batch.column("was").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
            for k in range(PARTS):
                part = np.column_stack([np.ones(len(x), np.int64), x[:, k * width : (k + 1) * width]])
                moved = first | (now[:, k] != was[:, k])
                np.add.at(total, k * entries + now[moved, k], part[moved])
                left = moved & ~first
                np.subtract.at(total, k * entries + was[left, k], part[left])
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array((some // entries).astype(np.int32)), pa.array((some % entries).astype(np.int32)), pa.array(total[some, 0]), pa.array(list(total[some, 1:]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    moved = assigned.where("was IS NULL OR was <> now").select("v", "was", "now")
    return moved.mapInArrow(rows, "part int, entry int, n long, sums array<long>")


def _added(key, rows):
    sums = np.array(rows["sums"].to_pylist(), np.int64).sum(0)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "entry": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([sum(rows["n"].to_pylist())], pa.int64()), "sums": pa.array([sums.tolist()], pa.list_(pa.int64()))})


def code(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each row that can be coded, and the codebooks (parts x entries x width).

    Needs columns vec_id, embedding and label. Vectors are kept once a round; a round's table replaces the one before.
    """
    spark = vectors.sparkSession
    whole = written(integers(vectors), "integers")
    first = [list(r["v"]) for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()]
    size = len(first[0]) if first else PARTS
    alike = whole.where(F.size("v") == size)
    seeds = np.array([list(r["v"]) for r in alike.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()], np.int64).reshape(-1, size)
    width, entries = size // PARTS, max(1, len(seeds))
    books = np.zeros((PARTS, entries, width), np.int64)
    for k in range(PARTS):
        books[k, : len(seeds)] = seeds[:, k * width : (k + 1) * width]

    shape = "part int, entry int, n long, sums array<long>"
    sums = spark.createDataFrame([], shape)
    last, path = alike.withColumn("now", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        assigned = _assigned(last, books)
        before, path = path, new_path(spark, "assigned")
        assigned.write.parquet(path)
        last = spark.read.schema(assigned.schema).parquet(path)
        if before:
            remove(spark, before)
        sums = written(sums.unionByName(changes(last, entries, width)).groupBy("part", "entry").applyInArrow(_added, shape), "sums")
        for r in sums.where("n > 0").collect():  # at most PARTS * ENTRIES rows
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    out = _assigned(last, books).select("vec_id", "label", F.lower(F.hex("now")).alias("code"), "error")
    return out, books[:, : len(seeds)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every vector's code and error, its label's error, and the digest of the codebooks."""
    coded, books = code(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    coded = written(coded, "codes")
    # written, so that its size is known: small it is broadcast, else both sides meet by label and skewed labels are split
    by_label = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
  SELECT x.id, x.p, min(((x.xx - 2 * list_inner_product(x.v, c.v) + c.cc)::BIGINT) * {ENTRIES} + c.e) AS best FROM parts x JOIN book{r} c ON c.p = x.p GROUP BY x.id, x.p
)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""means{r} AS (
  SELECT p, e, list(floor(s / n) ORDER BY i) AS v FROM (
    SELECT a.p, a.best % {ENTRIES} AS e, u.i, sum(x.v[u.i]) AS s, count(*) AS n
    FROM near{r} a JOIN parts x ON x.id = a.id AND x.p = a.p, LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS i) u GROUP BY a.p, a.best % {ENTRIES}, u.i
  ) GROUP BY p, e
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v, list_inner_product(coalesce(m.v, b.v), coalesce(m.v, b.v)) AS cc FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e
)"""
            )
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS id, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
), parts AS MATERIALIZED (
  SELECT id, p, v, list_inner_product(v, v) AS xx FROM (
    SELECT id, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS v FROM kept, range({PARTS}) r(p)
  )
), book0 AS MATERIALIZED (SELECT p, id AS e, v, xx AS cc FROM parts WHERE id < {ENTRIES}),
{", ".join(steps)},
coded AS (
  SELECT k.vec_id, k.label, string_agg(lower(lpad(to_hex(a.best % {ENTRIES}), 2, '0')), '' ORDER BY a.p) AS code, sum(a.best // {ENTRIES})::BIGINT AS error
  FROM kept k JOIN near{ROUNDS} a ON a.id = k.id GROUP BY k.id, k.vec_id, k.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS i, unnest(v)::BIGINT AS c FROM book{ROUNDS})) AS codebooks_sha256
FROM coded
"""


#: Four rounds unrolled.
ORACLE_SQL = _oracle()
