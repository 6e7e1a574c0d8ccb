"""Exact removal of repeated byte strings by a prefix-free parse of the corpus.

Parse: the rolling hash of every 32-byte string is a trigger value; of each 100-byte string the leftmost string of least
hash is its trigger, so equal 100-byte strings have their trigger at the same place, in whichever document. Successive
starts with one trigger form a phrase: all 100-byte strings around that trigger, about 33 of them. Phrases overlap by 99
bytes and none is a prefix of another that starts at the same trigger, so a document is its list of phrases, and every
100-byte string is in exactly one.

Dictionary: phrases group by trigger and phrase hash, 128 bits. Every occurrence but the earliest goes as a whole; of the
earliest ones, only phrases whose trigger occurs in another phrase too can hold a string that is elsewhere. Their texts
are the dictionary, and ``suffix_order`` sorts its suffixes of at least 100 bytes by their bytes. Parse and dictionary
combine: the order's intervals with a common prefix of 100 bytes are the equal strings of the corpus, each suffix stands
for the earliest occurrence of its phrase in the parse, and of each interval the earliest start stays. The parse's own
suffixes would order equal strings by what follows them, on which the result does not depend, so they are not sorted.

Data flow: phrases leave a task as packed arrays in buckets of the trigger, with the repeats inside the task already
taken out, so a group of copies sends one row a task; the number of buckets follows the input's size, and a task holds one
at a time. Triggers that a sample finds in over 0.5 % of documents, or in over ``MOST_ROWS``, are dealt by phrase and by
string instead, which changes where they are compared but no result; strings dealt so are compared by 64-bit hash. Phrase
texts are fetched for contested phrases alone.

Defined results: a null text is empty; texts under 100 bytes are never cut; rows without an id rank last; rows that share
an id are one document in rank, so equal rows of one id do not remove each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import written
from ._spans import FLUSH, ROW_SCHEMA, SPAN_SCHEMA, cut, dealt, held, later, merged, parted, ranked, rows_of, spans_of
from ._tables import buckets_of, table
from ._text import Block, Hasher, U, blocks

TRIGGER = 32
#: Documents that a trigger may be in before its phrases are dealt out, and triggers that are dealt so at most.
MOST_ROWS, MOST_HOT = 1 << 16, 1 << 20


def phrases(b: Block, length: int = 100, trigger: int = TRIGGER):
    """Of a block: its hasher, and each phrase's document, first start, number of starts, trigger hash and own hash."""
    n, span = len(b.data), length - trigger + 1
    hasher = Hasher(b.data)
    at = np.arange(max(n - trigger + 1, 0))
    h = hasher(at, at + trigger)
    # the leftmost least: 32 bits of hash above 32 bits of place
    keys = np.full(-(-len(h) // span) * span, U(2**64 - 1))
    keys[: len(h)] = (h & U(0xFFFFFFFF00000000)) | at.astype(U)
    rows = keys.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    start = np.arange(max(n - length + 1, 0))
    least = np.minimum(behind[start], ahead[start + span - 1])
    doc = np.repeat(np.arange(b.n), np.diff(b.at))[: len(start)]
    inside = start + length <= b.at[1:][doc]
    start, doc, where = start[inside], doc[inside], (least[inside] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    low, where = start[first], where[first]
    return hasher, doc[first], low, count, h[where], hasher(low, low + count + length - 1)


def suffix_order(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``start`` sorted by their first ``length`` bytes, and the interval of equal ones of each in that order.

    Eight bytes at a time, big-endian; only suffixes that still agree are sorted further. All have ``length`` bytes.
    """
    window = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    word = lambda at: window[at].view(">u8").ravel().astype(U)
    order = np.argsort(first := word(start), kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = first[order][1:] != first[order][:-1]
    for at in (*range(8, length - 7, 8), length - 8):
        group = np.cumsum(new)
        open_ = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(open_):
            break
        own = word(start[order[open_]] + at)
        again = np.lexsort((own, group[open_]))
        order[open_] = order[open_][again]
        own = own[again]
        new[open_[1:]] |= own[1:] != own[:-1]
    return order, np.cumsum(new) - 1


def _hot(documents: DataFrame, length: int, sample: int = 20_000, share: float = 0.005) -> np.ndarray:
    """Triggers in over ``share`` of the documents or over ``MOST_ROWS`` of them, by a sample that is taken by hash.

    A trigger of ``MOST_ROWS`` documents is in at least 20 of the sample. They only decide on routing. Where more than
    ``MOST_HOT`` are found, the most frequent are taken.
    """
    n = max(documents.count(), 1)
    sample = min(n, max(sample, 20 * n // MOST_ROWS))
    some = documents.where(F.pmod(F.xxhash64("k", "fp"), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def keys(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                _, doc, _, _, key, _ = phrases(b, length)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.stack([doc.astype(U), key]), axis=1)[1].astype(np.int64))], names=["key"])

    least = max(20, int(min(share * sample, MOST_ROWS * sample / n)))
    counted = some.select("text").mapInArrow(keys, "key long").groupBy("key").count().where(F.col("count") >= least)
    rows = counted.orderBy(F.desc("count"), "key").limit(MOST_HOT).select("key").toArrow().column("key")
    return np.sort(rows.to_numpy().astype(np.int64).astype(U))


def repeated_spans(documents: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """``ranked`` documents that may have removed byte spans, those that have none, and the spans (k, fp, low, high)."""
    spark = documents.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = U(buckets_of(documents, parts))
    hot = spark.sparkContext.broadcast(_hot(documents, length))

    def is_hot(key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hot.value, key)
        return (hot.value[np.minimum(at, len(hot.value) - 1)] == key) if len(hot.value) else np.zeros(len(key), bool)

    def parse(batches):
        ready, size = [], 0

        def flush():
            k, fp, low, count, key, own = (np.concatenate(c) for c in zip(*ready))
            order, late = later(own, k, low, key)
            gone, stay = order[late], order[~late]
            out = []
            if len(gone):
                gk, gf, gl, gh = merged(k[gone], fp[gone], low[gone], low[gone] + count[gone] + length - 1)
                zero = np.zeros(len(gk), U)
                out.append(rows_of(0, (gk.astype(U) * U(0x9E3779B97F4A7C15) >> U(40)) % buckets, gk, gf, gl, gh - gl, zero, zero))
            k, fp, low, count, key, own = (a[stay] for a in (k, fp, low, count, key, own))
            warm = is_hot(key)
            out.append(rows_of(1, (np.where(warm, own, key) >> U(20)) % buckets, k, fp, low, count, key, own))
            return [r for r in out if r is not None]

        for batch in batches:
            ids, prints = (batch.column(c).to_numpy() for c in ("k", "fp"))
            for b in blocks(batch.column("text")):
                _, doc, low, count, key, own = phrases(b, length)
                ready.append((ids[b.first + doc], prints[b.first + doc], low - b.at[doc], count, key, own))
                size += len(b.data)
                if size >= FLUSH:
                    yield from flush()
                    ready, size = [], 0
        if ready:
            yield from flush()

    def settle(batches):
        columns = (("k", np.int64), ("fp", np.int64), ("low", np.int64), ("count", np.int32), ("key", U), ("own", U))
        for kind, (k, fp, low, count, key, own) in held(batches, 2, columns):
            if kind == 0:
                yield spans_of(k, fp, low, low + count)
                continue
            order, late = later(own, k, low, key)
            gone = order[late]
            yield spans_of(k[gone], fp[gone], low[gone], low[gone] + count[gone] + length - 1)
            stay = order[~late]
            k, fp, low, count, key, own = (a[stay] for a in (k, fp, low, count, key, own))
            # a phrase is contested if its trigger is in another one
            order = np.argsort(key, kind="stable")
            first = np.ones(len(key), bool)
            first[1:] = key[order][1:] != key[order][:-1]
            group = np.cumsum(first) - 1
            contested = np.zeros(len(key), bool)
            contested[order] = np.bincount(group)[group] > 1
            warm = is_hot(key)
            contested |= warm
            yield spans_of(k[contested], fp[contested], low[contested], low[contested] + count[contested], 1 + warm[contested], key[contested])

    found = written(dealt(documents.select("k", "fp", "text").mapInArrow(parse, ROW_SCHEMA), int(buckets)).mapInArrow(settle, SPAN_SCHEMA), "phrases")
    asked = found.where("kind > 0").groupBy("k", "fp").agg(F.collect_list(F.struct("low", "high", "kind", "key")).alias("asked"))
    # texts are shuffled once: this join and that of the cut deal out the same columns, so Spark reuses the exchange
    touched, rest = parted(documents, found)
    with_text = touched.join(asked, ["k", "fp"]).select("doc_id", "k", "fp", "text", "asked")

    def fetch(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                hasher = Hasher(b.data)
                lists = batch.column("asked").slice(b.first, b.n)
                item = lists.flatten()
                doc = np.repeat(np.arange(b.n), np.diff(lists.offsets.to_numpy()))
                low, high, kind, key = (item.field(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "kind", "key"))
                key = key.astype(U)
                k, fp = (batch.column(c).to_numpy()[b.first + doc] for c in ("k", "fp"))
                cold, base = kind == 1, b.at[doc]
                raw = b.data.tobytes()
                texts = [raw[i:j] for i, j in zip((base + low)[cold].tolist(), (base + high + length - 1)[cold].tolist())]
                if out := rows_of(1, (key[cold] >> U(20)) % buckets, k[cold], fp[cold], low[cold], (high - low)[cold], key[cold], key[cold], texts):
                    yield out
                n = (high - low)[~cold]
                if len(n):
                    start = np.repeat((base + low)[~cold] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    own = hasher(start, start + length)
                    wk, wf, wl = np.repeat(k[~cold], n), np.repeat(fp[~cold], n), start - np.repeat(base[~cold], n)
                    order, late = later(own, wk, wl)
                    gone, stay = order[late], order[~late]
                    if len(gone):
                        gk, gf, gl, gh = merged(wk[gone], wf[gone], wl[gone], wl[gone] + length)
                        zero = np.zeros(len(gk), U)
                        yield rows_of(0, (gk.astype(U) * U(0x9E3779B97F4A7C15) >> U(40)) % buckets, gk, gf, gl, gh - gl, zero, zero)
                    yield rows_of(2, (own[stay] >> U(20)) % buckets, wk[stay], wf[stay], wl[stay], np.ones(len(stay)), own[stay], own[stay])

    def classes(batches):
        columns = (("k", np.int64), ("fp", np.int64), ("low", np.int64), ("count", np.int32), ("own", U), ("text", np.uint8))
        for kind, (k, fp, low, count, own, data) in held(batches, 3, columns):
            if kind == 0:
                yield spans_of(k, fp, low, low + count)
                continue
            if kind == 1:
                whole = count.astype(np.int64) + length - 1
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = np.repeat(np.cumsum(whole) - whole, count) + inner
                k, fp, low = np.repeat(k, count), np.repeat(fp, count), np.repeat(low, count) + inner
                order, own = suffix_order(data, start, length)
                k, fp, low = k[order], fp[order], low[order]
            order, late = later(own, k, low)
            gone = order[late]
            if len(gone):
                yield spans_of(*merged(k[gone], fp[gone], low[gone], low[gone] + length))

    more = dealt(with_text.mapInArrow(fetch, ROW_SCHEMA), int(buckets)).mapInArrow(classes, SPAN_SCHEMA)
    return touched, rest, found.where("kind = 0").unionByName(more).select("k", "fp", "low", "high")


def remove_repeats(documents: DataFrame, length: int = 100, kept: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) of every row; needs columns doc_id and text.

    ``spans`` holds the maximal removed byte spans; ``kept="binary"`` adds the remaining bytes, which may break characters.
    """
    ready = ranked(documents)
    return cut(*repeated_spans(ready, length), kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what remains of every document without 100-byte strings that start earlier too."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
