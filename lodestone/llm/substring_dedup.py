"""Substring dedup by hashing lines, and the sentences within them.

A unit ends at a newline, or after a full stop, question or exclamation mark that a space follows, so passages that stand
inside longer lines are found by their sentences. Units are normalised: words lower-cased (A-Z) and white space collapsed.
Units group globally by the digest of their words; the occurrence that ranks first by (doc_id, place) stays, all others
go, with their original byte offsets retained. Units of fewer than ``min_words`` words stay, but with ``lines``, as in
``clean``, each line is a unit as a whole too, of however few words, so a repeated line goes with its short sentences.

One pass over the texts takes repeats inside a task out at once, so a unit that every document holds sends one row a task,
and sends the rest as packed arrays in buckets of the digest, as many as the input's size asks for; a task holds one bucket
at a time and finds its first occurrences; the spans then meet the texts that have any by document, and the other texts
stay where they are. Digests are 64-bit.

Defined results: a null text is empty and has no units; rows without an id rank last; rows that share an id are one
document in rank, so equal rows of one id do not remove each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import written
from ._spans import FLUSH, ROW_SCHEMA, SPAN_SCHEMA, cut, dealt, held, later, merged, parted, ranked, rows_of, spans_of
from ._tables import buckets_of, table
from ._text import LOWER, Block, Hasher, U, blocks

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def units(b: Block, min_words: int, sentences: bool = True, lines: bool = False):
    """Each unit's document, start, end and digest; units of fewer words than ``min_words`` are left out.

    With ``lines``, whole lines of a word or more are units beside them.
    """
    data = b.data
    begins = np.zeros(len(data) + 1, bool)
    begins[1:] = data == 10
    begins[b.at] = True
    line = np.flatnonzero(begins[:-1])
    if sentences:
        begins[2:] |= (data[1:] == 32) & _STOP[data[:-1]]
    start = np.flatnonzero(begins[:-1])
    end = np.append(start[1:], len(data)) if len(start) else start
    ws, we, _ = b.words()
    words = Hasher(LOWER[data])(ws, we)
    first, last = np.searchsorted(ws, start), np.searchsorted(ws, end)
    some = last - first >= min_words
    if lines:
        stop = np.append(line[1:], len(data)) if len(line) else line
        own, past = np.searchsorted(ws, line), np.searchsorted(ws, stop)
        # a line that is one sentence of enough words is there already
        again = some[at := np.searchsorted(start, line)] & (end[at] == stop)
        some = np.append(some, (past > own) & ~again)
        start, end, first, last = (np.append(x, y) for x, y in ((start, line), (end, stop), (first, own), (last, past)))
    start, end, first, last = start[some], end[some], first[some], last[some]
    return np.searchsorted(b.at, start, side="right") - 1, start, end, Hasher(words)(first, last)


def repeated_units(documents: DataFrame, min_words: int = 4, sentences: bool = True, lines: bool = False) -> DataFrame:
    """(k, fp, low, high): byte spans of units that another document or place has earlier; needs ``ranked`` documents."""
    parts = max(8, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = U(buckets_of(documents, parts))

    def parse(batches):
        ready, size = [], 0

        def flush():
            k, fp, low, count, own = (np.concatenate(c) for c in zip(*ready))
            order, late = later(own, k, low)
            gone, stay = order[late], order[~late]
            out = []
            if len(gone):
                gk, gf, gl, gh = merged(k[gone], fp[gone], low[gone], low[gone] + count[gone])
                zero = np.zeros(len(gk), U)
                out.append(rows_of(0, (gk.astype(U) * U(0x9E3779B97F4A7C15) >> U(40)) % buckets, gk, gf, gl, gh - gl, zero, zero))
            k, fp, low, count, own = (a[stay] for a in (k, fp, low, count, own))
            out.append(rows_of(1, (own >> U(20)) % buckets, k, fp, low, count, np.zeros(len(k), U), own))
            return [r for r in out if r is not None]

        for batch in batches:
            ids, prints = (batch.column(c).to_numpy() for c in ("k", "fp"))
            for b in blocks(batch.column("text")):
                doc, start, end, own = units(b, min_words, sentences, lines)
                ready.append((ids[b.first + doc], prints[b.first + doc], start - b.at[doc], end - start, own))
                size += len(b.data)
                if size >= FLUSH:
                    yield from flush()
                    ready, size = [], 0
        if ready:
            yield from flush()

    def settle(batches):
        columns = (("k", np.int64), ("fp", np.int64), ("low", np.int64), ("count", np.int32), ("own", U))
        for kind, (k, fp, low, count, own) in held(batches, 2, columns):
            if kind == 0:
                yield spans_of(k, fp, low, low + count)
                continue
            order, late = later(own, k, low)
            gone = order[late]
            if len(gone):
                yield spans_of(*merged(k[gone], fp[gone], low[gone], low[gone] + count[gone]))

    found = dealt(documents.select("k", "fp", "text").mapInArrow(parse, ROW_SCHEMA), int(buckets)).mapInArrow(settle, SPAN_SCHEMA)
    return found.select("k", "fp", "low", "high")


def remove_units(documents: DataFrame, min_words: int = 4, sentences: bool = True, kept: str | None = "string", lines: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of every row; needs columns doc_id and text."""
    ready = ranked(documents)
    spans = written(repeated_units(ready, min_words, sentences, lines), "spans")
    return cut(*parted(ready, spans), spans, kept)


def clean(documents: DataFrame, min_words: int = 4, sentences: bool = True, lines: bool = True) -> DataFrame:
    """The rows of ``documents``, with all columns, without units, lines among them, that occur earlier in ``text``.

    A row of which nothing but white space remains goes; one that had nothing else before stays, and so does a null text.
    """
    rest = [c for c in documents.columns if c != "text"]
    row = F.struct(F.col("text").isNull().alias("none"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)))
    ready = ranked(documents.select("doc_id", "text", row.alias("row")), "row")
    spans = written(repeated_units(ready, min_words, sentences, lines), "spans")
    out = cut(*parted(ready, spans), spans, "string", ("row",), digest=False)
    left = F.col("kept").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_removed") == 0)
    columns = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | {"text": F.when(~F.col("row.none"), F.col("kept"))}
    return out.where(left).select(*(columns[c].alias(c) for c in documents.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document without the lines and sentences that occur earlier."""
    return remove_units(table(spark, sf_dir, "documents", "doc_id", "text"), lines=True).withColumnRenamed("kept", "text")
