"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased (A-Z) runs between white space and ASCII punctuation. A first pass over the texts counts how often
the three-word seeds of the test items occur in the corpus; rare ones, of at most ``RARE`` places or ``RARE_SHARE`` of all places,
stay, and of each item its ``LEAST_SEEDS`` rarest that occur at all, so an item of frequent words keeps seeds too. A second pass looks the kept seeds up in the texts, lays a window of the item's length and half as much on either side
around each hit's diagonal, joins windows that overlap, and aligns item and window. The score is the local alignment's
(match 2, mismatch -1, gap -1) share of a full match's. A window with fewer of the item's words than ``threshold`` of the
item's length can't reach it, since only matches add to a score, and is left out before the alignment. Both passes are scans;
counts are added up in each task before they are shuffled, and what reaches the driver is a number a seed of the items. A copy
that keeps no three words in a row of its item's rarer ones is not sought.

Test items are sent to all tasks in blocks of at most ``block_chars`` characters; a larger benchmark takes several blocks,
each of them against all documents. Defined results: null texts match nothing; items under ``least_words`` words, which
parts of clean texts resemble, match only as a whole: those of three or more words where they stand word for word, those of
fewer where they are all the words of a text; items without words match nothing; repeated rows and items give a row each; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._tables import table
from ._text import LOWER, SPACE, Block, Hasher, U, blocks, runs, window_hash

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: A seed is rare at so many places of the corpus, or at this share of all places; an item keeps at least so many seeds.
RARE, RARE_SHARE, LEAST_SEEDS = 1000, 1e-5, 16
_APART = SPACE.copy()
_APART[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _words(b: Block):
    start, end, at = b.words(_APART)
    return start, end, at, Hasher(LOWER[b.data])(start, end)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and the end of its words in ``window`` (the earliest)."""
    slope = -GAP * np.arange(len(window) + 1)
    before, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in item:
        now = np.zeros(len(window) + 1, np.int64)
        np.maximum(before[:-1] + np.where(window == word, MATCH, MISMATCH), before[1:] + GAP, out=now[1:])
        np.maximum(now, 0, out=now)
        before = np.maximum.accumulate(now + slope) - slope  # gaps along the window
        top = int(before.argmax())
        if before[top] > best or before[top] == best and best and top < end:
            best, end = int(before[top]), top
    return best, end


class Items:
    """Words of test items and the places of their seeds."""

    def __init__(self, ids: list, texts: list[str | None], least_words: int):
        self.ids, self.words, self.least_words = [], [], least_words
        #: Items that are too short for a seed, by their words.
        self.short: dict[bytes, list[int]] = {}
        for b in blocks(pa.array(texts, pa.string())):
            _, _, at, word = _words(b)
            for d in range(b.n):
                own = word[at[d] : at[d + 1]]
                if len(own):
                    if len(own) < SEED:
                        self.short.setdefault(own.tobytes(), []).append(len(self.ids))
                    self.ids.append(ids[b.first + d])
                    self.words.append(own)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        at, owner = runs(bounds, SEED) if self.words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        own = window_hash(np.concatenate(self.words), at, SEED) if self.words else np.zeros(0, U)
        order = np.argsort(own, kind="stable")
        self.seeds, self.seed = np.unique(own[order], return_inverse=True)
        self.item, self.place = owner[order], (at - bounds[owner])[order]

    def keep_rare(self, counts: np.ndarray, places: int) -> Items:
        """Leaves each item its rare seeds, and its rarest, by how often the corpus of so many places holds each of ``seeds``."""
        n = counts[self.seed]
        order = np.lexsort((self.place, n, n == 0, self.item))
        total = np.bincount(self.item, minlength=len(self.ids))
        nth = np.empty(len(n), np.int64)
        nth[order] = np.arange(len(n)) - (np.cumsum(total) - total)[self.item[order]]
        kept = (n > 0) & ((n <= max(RARE, RARE_SHARE * places)) | (nth < LEAST_SEEDS))
        own, self.seed = np.unique(self.seed[kept], return_inverse=True)
        self.item, self.place, self.seeds = self.item[kept], self.place[kept], self.seeds[own]
        return self

    def threshold(self, item: int, threshold: float) -> float:
        """The share of a full score that an item asks for: all of it, where the item is short."""
        return threshold if len(self.words[item]) >= self.least_words else 1.0

    def lookup(self):
        """A function from hashes to the positions that are seeds, and the seeds."""
        bits = np.zeros(1 << 20, bool)
        bits[(self.seeds >> U(44)).astype(np.int64)] = True

        def find(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(bits[(own >> U(44)).astype(np.int64)])
            if not len(at) or not len(self.seeds):
                return at[:0], at[:0]
            k = np.minimum(np.searchsorted(self.seeds, own[at]), len(self.seeds) - 1)
            hit = self.seeds[k] == own[at]
            return at[hit], k[hit]

        return find


def _hits(b: Block, find):
    """Words of a block, and the seeds found: first word, document, seed."""
    start, end, at, word = _words(b)
    first, owner = runs(at, SEED)
    i, seed = find(window_hash(word, first, SEED))
    return start, end, at, word, first[i], owner[i], seed


def _matches(b: Block, items: Items, find, threshold: float):
    """(document, item, score, first byte, last byte + 1) of items found in a block, one a document and item: the best."""
    start, end, at, word, first, owner, seed = _hits(b, find)
    for d in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < SEED)) if items.short else ():
        for i in items.short.get(word[at[d] : at[d + 1]].tobytes(), ()):
            yield int(d), i, 1.0, int(start[at[d]] - b.at[d]), int(end[at[d + 1] - 1] - b.at[d])
    if not len(first):
        return
    low, high = np.searchsorted(items.seed, seed), np.searchsorted(items.seed, seed, side="right")
    n = high - low
    each = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    doc, item = np.repeat(owner, n), items.item[each]
    diagonal = np.repeat(first, n) - items.place[each]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    for i, j in zip(edge, np.append(edge[1:], len(doc))):
        d, own = int(doc[i]), items.words[int(item[i])]
        m, pad, wanted = len(own), len(own) // 2, items.threshold(int(item[i]), threshold)
        windows: list[list[int]] = []
        for x in diagonal[i:j].tolist():
            a, z = max(int(at[d]), x - pad), min(int(at[d + 1]), x + m + pad)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(z, windows[-1][1])
            else:
                windows.append([a, z])
        best = (0, 0, 0)
        for a, z in windows:
            if np.isin(word[a:z], own).sum() / m < wanted:  # an alignment has no more matches
                continue
            score, stop = align(own, word[a:z])
            if score > best[0]:
                best = (score, a, a + stop)
        share = best[0] / (MATCH * m)
        if share >= wanted:
            back, length = align(own[::-1], word[best[1] : best[2]][::-1])
            yield d, int(item[i]), share, int(start[best[2] - length] - b.at[d]), int(end[best[2] - 1] - b.at[d])


def _blocks_of(benchmark: DataFrame, block_chars: int, least_words: int):
    """Test items in blocks, each of about ``block_chars`` characters."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark
        rows = part.select("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows], least_words)


def seed_counts(documents: DataFrame, sent) -> DataFrame:
    """(seed, n): how often the texts hold each seed of the items, and as the seed after the last the number of places; added up in each task first."""

    def counted(batches):
        items = sent.value
        find, total = items.lookup(), np.zeros(len(items.seeds) + 1, np.int64)
        for batch in batches:
            for b in blocks(batch.column("text")):
                _, _, at, _, _, _, seed = _hits(b, find)
                total += np.bincount(seed, minlength=len(total))
                total[-1] += np.maximum(np.diff(at) - SEED + 1, 0).sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["seed", "n"])

    return documents.select(F.col("text").cast("string")).mapInArrow(counted, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def _prepared(documents: DataFrame, benchmark: DataFrame, block_chars: int, least_words: int):
    """Blocks of items with their rare seeds, sent to the tasks."""
    context = documents.sparkSession.sparkContext
    for items in _blocks_of(benchmark, block_chars, least_words):
        every, counts = context.broadcast(items), np.zeros(len(items.seeds) + 1, np.int64)
        for seed, n in seed_counts(documents, every).collect() if len(items.seeds) else ():
            counts[seed] = n
        every.unpersist()
        yield context.broadcast(items.keep_rare(counts[:-1], int(counts[-1])))


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = 8_000_000, least_words: int = 5) -> DataFrame:
    """(doc_id, item_id, score, first_byte, end_byte) of each document and test item whose alignment reaches ``threshold``.

    Needs columns doc_id and text, and item_id and text. The bytes are the aligned passage in the document.
    """
    item = benchmark.schema["item_id"].dataType
    kind = to_arrow_type(item)
    schema = f"doc_id long, item_id {item.simpleString()}, score double, first_byte long, end_byte long"
    out = None
    for sent in _prepared(documents, benchmark, block_chars, least_words):

        def found(batches, sent=sent):
            items = sent.value
            find = items.lookup()
            for batch in batches:
                ids = batch.column("doc_id")
                for b in blocks(batch.column("text")):
                    rows = list(_matches(b, items, find, threshold))
                    if rows:
                        doc, which, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([b.first + d for d in doc])), pa.array([items.ids[i] for i in which], kind), *(pa.array(c) for c in rest)], names=["doc_id", "item_id", "score", "first_byte", "end_byte"])

        part = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(found, schema)
        out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = 8_000_000, least_words: int = 5) -> DataFrame:
    """The rows of ``documents``, with all columns, in which no test item reaches ``threshold``; a filter inside the scan."""
    for sent in _prepared(documents, benchmark, block_chars, least_words):

        def clean(batches, sent=sent):
            items = sent.value
            find = items.lookup()
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                for b in blocks(batch.column("text")):
                    for d, *_ in _matches(b, items, find, threshold):
                        stay[b.first + d] = False
                yield batch.filter(pa.array(stay))

        documents = documents.mapInArrow(clean, documents.schema)
    return documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document and test item that align."""
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
