"""Best-fit packing of documents into training sequences, with tokens, documents and attention cost as capacities.

Three steps. (1) One pass tokenises whole texts, cuts long documents into pieces and writes a row a piece to the shared
folder. (2) Pieces of one length are interchangeable, so the driver gets the histogram of lengths alone, at most one row
a token of the capacity, and plans by vector best-fit decreasing: lengths from long to short; bins with equal contents
are one group with a multiplicity; of all groups in which the piece fits under every capacity, the one with the least
weighted residual norm (or the greatest weighted dot product of piece and residual) takes it. The plan's size depends on
the capacities, not on the corpus. (3) Pieces are ranked within their length, by salted parts so that a length which a
third of all pieces share is spread over tasks, and a rank finds its place in the plan.

Ids are those of the tokenizers library. Texts whose characters that library and tiktoken class alike, and that hold no
special string, go through tiktoken with the same vocabulary, which gives the same ids several times faster; the rest go
through the library itself.

Null texts count as empty: one piece that is the closing id alone. Repeated rows are packed as often as they occur. An
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import written
from ._tables import table
from ._text import blocks
from .token_counts import Vocabulary

#: Characters that both libraries class alike (a test compares them); any other sends its text to the slower one.
_ODD = re.compile(r"[^\x00-՗ -⁯]")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(content.decode())
        self.fast, self.special = None, [t["content"] for t in json.loads(content)["added_tokens"]]
        try:
            v = Vocabulary(content)
        except (ValueError, KeyError):
            return
        # tiktoken takes an id as its rank, so ids must rise with the ranks of their merges
        if all(out == 256 + rank for rank, out in v.rank.values()):
            import tiktoken

            self.fast = tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=v.id_of, special_tokens={})

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.fast is not None and not _ODD.search(t) and not any(s in t for s in self.special) for t in texts]
        rest = iter(self.slow.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.fast.encode_to_numpy(t, disallowed_special=()) if p else np.array(next(rest).ids, np.uint32) for t, p in zip(texts, plain)]


_READY: dict[int, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    key = zlib.crc32(content)
    if key not in _READY:
        _READY[key] = Encoder(content)
    return _READY[key]


def pieces(documents: DataFrame, path: str, capacity: int = 2048, close: int = 0, salts: int = 64, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt[, ids]): a document's ids and ``close``, cut where longer than ``capacity``.

    Only the first piece of a longer document may be shorter than ``capacity``. ``salt`` deals rows out evenly.
    """
    with open(path, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", *["ids"] * with_ids]

    def rows(batches):
        encoder, salt = _encoder(sent.value), (TaskContext.get().partitionId() * 7919) % salts
        for batch in batches:
            text = batch.column("text").fill_null("")
            ids = batch.column("doc_id").to_pylist()
            for b in blocks(text):
                out = [[] for _ in names]
                for d, own in enumerate(encoder(text.slice(b.first, b.n).to_pylist())):
                    own = np.append(own, close).astype("<u4")
                    cuts = [0, *range(len(own) - capacity * ((len(own) - 1) // capacity), len(own) + 1, capacity)]
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        salt = (salt + 1) % salts
                        row = [ids[b.first + d], k, i, j - i, zlib.crc32(own[i:j].tobytes()), salt, own[i:j].tolist() if with_ids else None]
                        for column, x in zip(out, row):
                            column.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)


def plan(lengths: dict[int, int], capacity: int = 2048, documents: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, int]:
    """Vector best-fit decreasing over a histogram {length: pieces}.

    Returns rows (length, first rank, first sequence, offset) — pieces of that length from the first rank on, up to the
    next row's, go to successive sequences at the offset — and the number of sequences. ``documents`` and ``cost`` (sum of
    squared lengths) are capacities of a sequence; None: as much as ``capacity`` tokens can hold, so never short.
    """
    full = np.array([capacity, documents or capacity, cost or capacity**2], float)
    scaled = np.array(weights) / full**2
    left, count, base = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, sequences = [], 0
    for length in sorted(lengths, reverse=True):
        item = np.array([length, 1, length * length], float)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        todo, rank = int(lengths[length]), 0
        fresh: list[tuple[np.ndarray, int, int]] = []
        while todo:
            fits = np.flatnonzero((left >= item).all(1))
            if len(fits):
                rest = left[fits]
                best = fits[int(np.argmin(((rest - item) ** 2 * scaled).sum(1)) if rule == "norm" else np.argmax((rest * item * scaled).sum(1)))]
                room, have, first = left[best].copy(), int(count[best]), int(base[best])
            else:
                room = full.copy()
                each = int((room // item).min())
                best, have, first = -1, -(-todo // each), sequences
                sequences += have
            each = int((room // item).min())
            whole = min(have, todo // each)
            parts = [(whole, each), (min(1, have - whole), min(each, todo - whole * each))]
            at = first
            for bins, n in parts:
                if bins and n:
                    for k in range(n):
                        rows.append((length, rank, at, int(capacity - room[0]) + k * length))
                        rank += bins
                    todo -= bins * n
                    fresh.append((room - n * item, bins, at))
                    at += bins
            if best >= 0:  # the group keeps the bins that took nothing
                base[best], count[best] = at, first + have - at
                if not count[best]:
                    left[best] = -1
        open_ = left[:, 0] > 0
        more = [f for f in fresh if f[0].min() > 0]
        left = np.vstack([left[open_], *[f[0][None] for f in more]])
        count, base = np.append(count[open_], [f[1] for f in more]).astype(np.int64), np.append(base[open_], [f[2] for f in more]).astype(np.int64)
    return np.array(rows, np.int64).reshape(-1, 4), sequences


def tightest(lengths: dict[int, int], capacity: int = 2048, rule: str = "norm") -> tuple[int, int]:
    """Capacities of documents and cost under which the plan needs no more sequences than with tokens alone.

    Documents: the token capacity, halved while that holds. Cost: the square of the token capacity, less a sixteenth of it
    while that holds; a piece that fills a sequence leaves it at the square.
    """
    documents, cost, least = capacity, capacity**2, max(lengths, default=0) ** 2
    _, need = plan(lengths, capacity, rule=rule)
    while documents > 1 and plan(lengths, capacity, documents // 2, rule=rule)[1] <= need:
        documents //= 2
    while (less := cost - capacity**2 // 16) >= max(least, 1) and plan(lengths, capacity, documents, less, rule=rule)[1] <= need:
        cost = less
    return documents, cost


def pack(documents: DataFrame, path: str, capacity: int = 2048, max_documents: int | None = None, max_cost: int | None = None, close: int = 0, rule: str = "norm", with_ids: bool = False, tight: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece; needs columns doc_id and text.

    ``tight`` sets the capacities of documents and cost by ``tightest``, so they bind as far as they cost no sequence.
    """
    spark = documents.sparkSession
    salts = min(1024, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cut = written(pieces(documents, path, capacity, close, salts, with_ids), "pieces")
    parts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    lengths = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if tight:
        max_documents, max_cost = tightest(lengths, capacity, rule)
    rows, _ = plan(lengths, capacity, max_documents, max_cost, rule=rule)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(within)).join(start, ["length", "salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_first"))
    sent = spark.sparkContext.broadcast(rows)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def placed(batches):
        table_ = sent.value
        wide = np.int64(1) << 42
        key = table_[:, 0] * wide + table_[:, 1]
        order = np.argsort(key)
        key, first, sequence, offset = key[order], table_[order, 1], table_[order, 2], table_[order, 3]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, length * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(placed, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document in sequences of at most 2048 tokens, of as few documents and as little cost as cost no sequence."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), tight=True)
