"""Byte spans of documents to remove: packed rows between tasks, and the cut itself."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._scratch import written
from ._text import U, blocks

_NO_ID = (1 << 63) - 1
#: Words of 64 bits in the bitmap of ``parted``: 32 million bits.
_WORDS = 1 << 19


def later(key: np.ndarray, k: np.ndarray, low: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and rank; and, in that order, which items rank after the first of their key.

    Keys that differ in ``also``, a second hash, are different.
    """
    order = np.lexsort((low, k, key))
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    if also is not None:
        apart = also[order][1:] != also[order][:-1]
        if (apart & ~new[1:]).any():
            order = np.lexsort((low, k, also, key))
            new[1:] = (key[order][1:] != key[order][:-1]) | (also[order][1:] != also[order][:-1])
    key, k, low = key[order], k[order], low[order]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
    return order, (k != k[first]) | (low != low[first])


def merged(k: np.ndarray, fp: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each document, touching ones joined."""
    order = np.lexsort((low, fp, k))
    k, fp, low, high = k[order], fp[order], low[order], high[order]
    new = np.ones(len(k), bool)
    other = (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])
    group = np.concatenate([[0], np.cumsum(other)]) if len(k) else np.zeros(0, np.int64)
    wide = np.int64(1) << 33
    top = np.maximum.accumulate(high + group * wide) - group * wide if len(k) else high
    new[1:] = other | (low[1:] > top[:-1])
    first = np.flatnonzero(new)
    return k[first], fp[first], low[first], np.append(top[first[1:] - 1], top[-1:])


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The slices of ``values`` between cuts, as binary values."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


ROW = ["bucket", "kind", "k", "fp", "low", "count", "key", "own", "text"]
ROW_SCHEMA = "bucket int, kind int, k binary, fp binary, low binary, count binary, key binary, own binary, text binary"


def rows_of(kind: int, bucket: np.ndarray, k, fp, low, count, key, own, texts: list[bytes] | None = None) -> pa.RecordBatch | None:
    """Items as one packed row a bucket."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    cuts = np.append(first, len(bucket))
    packs = [packed(a[order].astype(t), cuts) for a, t in ((k, np.int64), (fp, np.int64), (low, np.int64), (count, np.int32), (key, U), (own, U))]
    text = pa.nulls(len(first), pa.binary()) if texts is None else pa.array([b"".join(texts[i] for i in order[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), *packs, text], names=ROW)


def spans_of(k, fp, low, high, kind=0, key=None) -> pa.RecordBatch:
    key = np.zeros(len(k), np.int64) if key is None else key.astype(np.int64)
    kinds = kind if isinstance(kind, np.ndarray) else np.full(len(k), kind)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp), pa.array(low), pa.array(high), pa.array(kinds.astype(np.int32)), pa.array(key)], names=["k", "fp", "low", "high", "kind", "key"])


SPAN_SCHEMA = "k long, fp long, low long, high long, kind int, key long"
FLUSH = 8 << 20


def ranked(documents: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, k, fp, text, and the columns carried): k ranks rows, those without an id last; k and fp, a hash of the text, identify a row's document."""
    ready = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried)
    return ready.withColumn("fp", F.xxhash64("text"))


def parted(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``ranked`` documents that may be among ``ids`` (k, fp), and those that are not.

    A bitmap of fixed size is sent to all tasks, so texts without a partner need no shuffle. Hashes that meet in it send
    some texts to the first part needlessly. Where the ids fill it, all do, and there is no second part.
    """
    word = F.pmod(F.xxhash64("k", "fp"), F.lit(_WORDS))
    bit = F.expr("shiftleft(1L, int(pmod(shiftright(xxhash64(k, fp), 32), 64)))")
    seen = written(ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "bitmap")
    if (seen.agg(F.sum(F.bit_count("bits"))).first()[0] or 0) > 48 * _WORDS:
        return documents, None
    flagged = documents.withColumn("_word", word).join(F.broadcast(seen), F.col("_word") == F.col("word"), "left")
    among = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    return flagged.where(among).select(documents.columns), flagged.where(~among).select(documents.columns)


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with one bucket a partition, so that a task holds one bucket."""
    return rows.repartitionById(buckets, "bucket")


def held(batches, kinds: int, columns):
    """Of a bucket's batches: the rows of ``kind`` 0 batch by batch, as (0, arrays); then those of each other kind below ``kinds`` at once.

    ``columns``: names with their types; a column without a type comes as bytes.
    """
    kept: dict[int, list[list]] = {k: [[] for _ in columns] for k in range(1, kinds)}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        for k in np.unique(kind).tolist():
            part = batch.filter(pa.array(kind == k))
            own = [part.column(c).to_pylist() for c, _ in columns]
            if k == 0:
                yield 0, [np.frombuffer(b"".join(x for x in o if x is not None), t) for o, (_, t) in zip(own, columns)]
            else:
                for into, o in zip(kept[k], own):
                    into += o
    for k in sorted(kept):
        if kept[k][0]:
            yield k, [np.frombuffer(b"".join(x for x in o if x is not None), t) for o, (_, t) in zip(kept.pop(k), columns)]


def cut(touched: DataFrame, rest: DataFrame | None, spans: DataFrame, kept: str | None = None, carried: tuple[str, ...] = (), digest: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) of every row of ``ranked`` documents.

    ``spans``: rows (k, fp, low, high). ``touched`` documents, which may have some, meet them in a join; ``rest`` have none
    (``parted``). In the result they are maximal and in order. ``kept``: the type, string or
    binary, in which to return the remaining bytes. ``carried`` columns pass through; without ``digest`` the hash is empty.
    """
    spans = spans.groupBy("k", "fp").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low: long, high: long>>" + (f", kept {kept}" if kept else ""))
    for c in carried:
        schema = schema.add(c, touched.schema[c].dataType)

    def cutting(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                own = batch.column("spans").slice(b.first, b.n).to_pylist()
                out = [[] for _ in range(6)]
                for d in range(b.n):
                    raw = b.data[b.at[d] : b.at[d + 1]].tobytes()
                    joined, rest, at = [], [], 0
                    for s in sorted((s["low"], s["high"]) for s in own[d] or []):
                        if joined and s[0] <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], s[1])
                        else:
                            joined.append(list(s))
                    for low, high in joined:
                        rest.append(raw[at:low])
                        at = high
                    left = b"".join([*rest, raw[at:]])
                    for column, x in zip(out, (len(raw), len(raw) - len(left), len(joined), hashlib.sha256(left).hexdigest() if digest else "", [{"low": i, "high": j} for i, j in joined], left)):
                        column.append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))]
                columns = [pa.array(c, t) for c, t in zip(out, kinds)]
                if kept:
                    columns.append(pa.array(out[5], pa.binary()).cast(pa.string() if kept == "string" else pa.binary()))
                columns += [batch.column(c).slice(b.first, b.n) for c in carried]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.first, b.n), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * bool(kept), *carried])

    out = touched.join(spans, ["k", "fp"], "left").select("doc_id", "text", "spans", *carried).mapInArrow(cutting, schema)
    if rest is None:
        return out
    none = F.lit(None).cast("array<struct<low: long, high: long>>").alias("spans")
    return out.unionByName(rest.select("doc_id", "text", none, *carried).mapInArrow(cutting, schema))
