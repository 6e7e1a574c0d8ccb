"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct shingles of five lower-cased words. Per side, left and right, ``tables`` hashes of
``rows`` minima each are computed; the key tables are all pairs of a left and a right hash, so ``tables ** 2`` tables cost
``2 * tables * rows`` minima. A pair of similarity s shares a key with probability (1 - (1 - s ** rows) ** tables) ** 2,
0.9991 at s = 0.75 for the first level's 3 rows and 14 tables.

Stages: (1) one pass over the texts gives set sizes, digests of whole sets and the two sides' hashes. (2) Equal sets
collapse to their smallest id. (3) Only hashes that several sets share can make a shared key, so the rest goes before
keys are formed. (4) In each key's bucket every member is compared with the bucket's
centre, the one whose hashes most others hold, on full sets. (5) Where
a comparison failed, the bucket's components are formed, and all members outside the largest component meet all members
of other components. What two texts can share is bounded: shingles that no other text of such buckets has are never
shared, and pairs that share a rare one are found by it; so most texts and pairs drop out before they meet, none of them a
link, and the rest are compared on full sets. Buckets with many such members go to
a next level with longer keys and more tables at the same recall, and the last level compares whatever is left; nothing is
capped. (6) Components of the links.

Every aggregate combines before its shuffle, and equal sets never meet in pairs. A set, hash, bucket or centre that very many
texts have is met by a broadcast of such keys or by salt (``_skew``), not in one task; no other
join sends a table through the driver, however small its files. Defined results: a text without words, empty or null, has an empty set and links with
nothing; a row without an id takes no part (component null, kept); repeated ids are one node that has the links of all
its rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import written
from ._skew import apart, met, salted
from ._tables import table
from ._text import LOWER, Block, Hasher, U, blocks, mix, runs, window_hash
from .components import stars

#: (rows, tables) of each level.
LEVELS = ((3, 14), (5, 30), (8, 75))
#: Members outside a bucket's largest component that meet all its other members at once; with more, the next level.
FEW = 512
#: A shingle in no more than so many of the texts that step 5 compares is rare.
RARE = 16
WORDS = 5


def shingles(b: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's shingles and their bounds (n + 1); fewer words than ``words`` are one shingle."""
    data = LOWER[b.data]
    start, end, at = b.words()
    word = Hasher(data)(start, end)
    count = np.diff(at)
    first, owner = runs(at, words)
    x = window_hash(word, first, words)
    for k in range(1, words):
        short = np.flatnonzero(count == k)
        if len(short):
            x = np.concatenate([x, window_hash(word, at[short], k) + U(k)])
            owner = np.concatenate([owner, short])
    if len(owner) and (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        x, owner = x[order], owner[order]
    return x, np.searchsorted(owner, np.arange(b.n + 1))


def _minima(x: np.ndarray, at: np.ndarray, rows: int, tables: int, seed: int) -> np.ndarray:
    """Both sides' hashes, a row a document with shingles: columns 0 to tables - 1 left, then right."""
    full = np.flatnonzero(np.diff(at))
    starts = at[:-1][full]
    factor = np.random.default_rng(seed).integers(0, 1 << 63, 2 * tables * rows, dtype=np.uint64) * U(2) + U(1)
    out = np.empty((2 * tables, len(full)), U)
    for t in range(2 * tables):
        key = np.full(len(full), U(t + 1))
        for r in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * factor[t * rows + r], starts)) if len(full) else key
        out[t] = key
    return out.T


def signatures(documents: DataFrame, rows: int, tables: int, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, hashes) of every row; d1 and d2 digest the set, hashes is empty for empty sets."""

    def signed(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                x, at = shingles(b)
                owner = np.repeat(np.arange(b.n), np.diff(at))
                both = x ^ mix(owner.astype(U) + U(1))
                order = np.argsort(both)
                new = np.ones(len(x), bool)
                new[1:] = both[order][1:] != both[order][:-1]
                own, z = owner[order[new]], x[order[new]]
                sums = [np.zeros(b.n, U) for _ in range(2)]
                for s, k in zip(sums, (0x1234567, 0x89ABCDEF1)):
                    np.add.at(s, own, mix(z + U(k)))
                full = np.diff(at) > 0
                keys = _minima(x, at, rows, tables, seed).astype(np.int64)
                hashes = pa.ListArray.from_arrays(pa.array((np.concatenate([[0], np.cumsum(full)]) * 2 * tables).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.first, b.n), pa.array(np.bincount(own, minlength=b.n).astype(np.int64)), *(pa.array(s.astype(np.int64)) for s in sums), hashes], names=["doc_id", "n_shingles", "d1", "d2", "hashes"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(signed, "doc_id long, n_shingles long, d1 long, d2 long, hashes array<long>")


def _keys(nodes: DataFrame, tables: int) -> DataFrame:
    """(id, score, key): the key tables of nodes (id, hashes), of hashes that at least two nodes share.

    ``score`` counts the other holders of a node's hashes; of copies with edits, the least edited has the most.
    """
    each = nodes.select("id", F.posexplode("hashes").alias("t", "h")).withColumn("h", F.xxhash64("t", "h"))
    shared = written(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    sides = met(each, shared, ["h"]).groupBy("id").agg(
        F.sum("n").alias("score"), F.collect_list(F.when(F.col("t") < tables, F.col("h"))).alias("left"), F.collect_list(F.when(F.col("t") >= tables, F.col("h"))).alias("right")
    )
    pairs = written(sides, "sides").where("size(left) > 0 AND size(right) > 0").select("id", "score", F.explode("left").alias("l"), "right").select("id", "score", "l", F.explode("right").alias("r"))
    return pairs.select("id", "score", F.xxhash64("l", "r").alias("key"))


def _exploded(texts: DataFrame) -> DataFrame:
    """(id, x): the distinct shingles of texts (id, text)."""

    def rows(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for b in blocks(batch.column("text")):
                x, at = shingles(b)
                own = [np.unique(x[i:j]) for i, j in zip(at[:-1], at[1:])]
                doc = np.repeat(ids[b.first : b.first + b.n], [len(o) for o in own])
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.concatenate(own).astype(np.int64))], names=["id", "x"])

    return texts.mapInArrow(rows, "id long, x long")


def unshared(texts: DataFrame) -> DataFrame:
    """(id, own): of each text (id, text), the number of shingles that no other of the texts has; texts without any are left out."""
    holders = _exploded(texts).groupBy("x").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    return holders.where("id = other").groupBy("id").agg(F.count("*").alias("own"))


def verified(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b, linked) of pairs (a, b): whether 100 * intersection >= ``percent`` * union of the full sets."""
    pairs = written(pairs.select("a", "b"), "pairs")
    # a pair's texts meet in one join on its greater id and one on its lesser; either may be the centre of very many
    one = salted(pairs, pairs, texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a", "b")
    both = salted(one, pairs, texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b", "a").select("a", "b", "ta", "tb")

    def compared(batches):
        for batch in batches:
            sets = []
            for name in ("ta", "tb"):
                own = []
                for blk in blocks(batch.column(name)):
                    x, at = shingles(blk)
                    own += [np.unique(x[i:j]) for i, j in zip(at[:-1], at[1:])]
                sets.append(own)
            linked = []
            for p, q in zip(*sets):
                n = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(n > 0 and 100 * n >= percent * (len(p) + len(q) - n))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(compared, "a long, b long, linked boolean")


def _nodes(sets: DataFrame) -> DataFrame:
    """(id, n_shingles, hashes, all) of sets (id, n_shingles, hashes), repeated ones once.

    An id may have several sets; what one of them shares with others is among the id's ``all`` shingles that others have.
    """
    own = sets.groupBy("id").agg(F.collect_set(F.struct("n_shingles", "hashes")).alias("sets"))
    total = F.aggregate("sets", F.lit(0).cast("long"), lambda n, s: n + s["n_shingles"])
    return written(own.withColumn("all", total).select("id", "all", F.inline("sets")), "nodes")


def _level(nodes: DataFrame, texts_of, level: int, links: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) found by one level and those after it, with the links given."""
    rows, tables = LEVELS[level]
    keys = _keys(nodes, tables)
    # a bucket collapses to its count and its centre before its members meet
    bucket = keys.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("top")).where("n > 1")
    bucket = written(bucket.select("key", "n", (-F.col("top.minus")).alias("first")), "centres")
    members = written(met(keys.drop("score"), bucket, ["key"]).drop("n"), "buckets")
    texts = texts_of(members.select("id").distinct())
    star = members.where("id <> first").select(F.greatest("id", "first").alias("a"), F.least("id", "first").alias("b")).distinct()
    tested = written(verified(star, texts, percent), "tested")
    found = tested.where("linked").select("a", "b")
    found = found if links is None else found.unionByName(links)
    failed = tested.where("NOT linked").select("a", "b")
    if failed.isEmpty():
        return found
    mixed = members.select("key", F.greatest("id", "first").alias("a"), F.least("id", "first").alias("b")).join(apart(failed), ["a", "b"]).select("key").distinct()
    ids = written(members.select("key", "id").join(apart(mixed), "key").select("id").distinct(), "mixed")
    # a component's least node has no row here and is its own
    found = stars(found)
    groups = found.select(F.col("a").alias("id"), F.col("b").alias("component"))
    own = unshared(texts.join(apart(ids), "id", "left_semi"))
    bounds = nodes.join(apart(ids), "id", "left_semi").join(apart(own), "id", "left").select("id", "hashes", F.col("n_shingles").alias("n"), "all", F.least("n_shingles", F.col("all") - F.coalesce("own", F.lit(0))).alias("common"))
    mine = bounds.where(f"100 * common >= {percent} * n").join(apart(groups), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mine = written(mine, "candidates")
    # pairs that share a rare shingle are few; what other pairs can share is bounded by their common shingles
    each = written(_exploded(texts.join(apart(mine.select("id")), "id", "left_semi")), "shingles")
    rare = each.join(apart(each.groupBy("x").agg(F.count("*").alias("df")).where(f"df <= {RARE}")), "x")
    mine = mine.join(apart(rare.groupBy("id").agg(F.count("*").alias("rare"))), "id", "left").withColumn("plain", F.least("n", F.col("all") - F.coalesce("rare", F.lit(0))))
    mine = written(mine.select("id", "c", "n", "common", "plain", "hashes"), "bounded")
    # one bucket a left hash here: a pair meets in the first that it shares, and has to share a right one
    inside = mine.select("*", F.posexplode(F.slice("hashes", 1, tables)).alias("t", "key"))
    sizes = inside.groupBy("t", "key", "c").agg(F.count("*").alias("m")).groupBy("t", "key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "c")).alias("top")).where("n > top.m")
    sizes = written(sizes.select("t", "key", F.col("top.c").alias("most"), (F.col("n") - F.col("top.m")).alias("few")), "sizes")
    last = level + 1 == len(LEVELS)
    at_once = sizes if last else sizes.where(F.col("few") <= FEW)
    side = lambda d, z: d.select("t", "key", *(F.col(c).alias(c + z) for c in ("id", "c", "n", "plain", "hashes")))
    few = inside.join(apart(at_once), ["t", "key"]).where("c <> most")
    room = lambda c: f"cx <> cy AND 100 * least({c}x, {c}y) >= {percent} * (nx + ny - least({c}x, {c}y))"
    same = lambda start, n: f"exists(zip_with(slice(hashesx, {start}, {n}), slice(hashesy, {start}, {n}), (p, q) -> p = q), z -> z)"
    once = F.expr(f"{room('plain')} AND NOT {same(1, 't')} AND {same(tables + 1, tables)}")
    pairs = side(few, "x").join(apart(side(inside, "y")), ["t", "key"]).where(once).select("idx", "idy")
    tied = rare.where("df > 1").select("x", "id").join(apart(mine.select("id", "c", "n", "common")), "id")
    tie = lambda z: tied.select("x", *(F.col(c).alias(c + z) for c in ("id", "c", "n", "common")))
    ties = tie("x").join(apart(tie("y")), "x").where("idx < idy").where(F.expr(room("common"))).select("idx", "idy")
    pairs = pairs.unionByName(ties).select(F.greatest("idx", "idy").alias("a"), F.least("idx", "idy").alias("b")).distinct().join(apart(tested.select("a", "b")), ["a", "b"], "left_anti")
    found = found.unionByName(written(verified(pairs, texts, percent).where("linked").select("a", "b"), "found"))
    if last:
        return found
    rest = inside.join(apart(sizes.where(F.col("few") > FEW).select("t", "key")), ["t", "key"]).select("id").distinct()
    if rest.isEmpty():
        return found
    again = written(signatures(texts.join(apart(rest), "id").withColumnRenamed("id", "doc_id"), *LEVELS[level + 1], seed=level + 2), "signatures")
    return _level(_nodes(again.where("n_shingles > 0").select(F.col("doc_id").alias("id"), "hashes", "n_shingles")), texts_of, level + 1, found, percent)


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``documents``; needs columns doc_id and text."""
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(signatures(documents, *LEVELS[0]), "signatures")
    some = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = written(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sets")
    member = written(met(some, same, ["d1", "d2"]).select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("hashes")).alias("hashes")), "members")
    # an id has one row, and so one set, as a rule
    once = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    sets = member.where("hashes IS NOT NULL").select(F.col("rep").alias("id"), "hashes", "n_shingles")
    nodes = sets.withColumn("all", F.col("n_shingles")) if once else _nodes(sets)

    # rows are compared with each other as whole texts only where ids repeat
    def texts_of(ids: DataFrame) -> DataFrame:
        rows = documents.withColumnRenamed("doc_id", "id").join(apart(ids), "id", "left_semi")
        return written(rows if once else rows.distinct(), "texts")

    links = _level(nodes, texts_of, 0, None, percent)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    if once:
        of = stars(links).select(F.col("a").alias("rep"), F.col("b").alias("component"))
        linked = member.select("doc_id", "n_shingles", "rep").join(apart(of), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        alone = signed.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept)
    ends = member.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    # an id that occurs with several texts ties their sets together
    several = member.join(apart(ends.where("low <> high").select("doc_id", "low")), "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    of = stars(links.unionByName(several)).select(F.col("a").alias("low"), F.col("b").alias("component"))
    linked = ends.join(apart(of), "low", "left").select("doc_id", F.coalesce("component", "low").alias("c"))
    out = signed.select("doc_id", "n_shingles").join(apart(linked), "doc_id", "left").withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
