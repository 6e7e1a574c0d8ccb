"""An inverted index in shards of rows with block maxima, and exact top-k by BM25 that leaves out what can't enter.

Rows are dealt to shards by a hash of their id. In a shard the postings of a term, in the order of ids, are cut into blocks of
``BLOCK``, and each block is one row of the index: its ids, their weights and the greatest of these. The index is a table
bucketed by shard, so a search reads each shard's rows of the wanted terms in one task without a shuffle; what is shuffled is
the first k rows of each query and task.

A search of a shard takes a query's terms from the rarest to the most frequent. As soon as what the remaining terms can add
at most stays below the k-th best sum so far, no new row can enter: from then on, the remaining terms are only looked up for rows
that may still reach it, and a row whose block's maximum doesn't suffice is given up. Sums of weights are not negative, so the
result is that of adding up all postings.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import BM25, MOST_TERMS, NAMED_TERMS, TERM_BYTES, _rarity, _sent, postings, query_weights, top_per_query

#: Postings in a block, and rows in a shard, about.
BLOCK, SHARD_ROWS = 128, 1 << 14
SCHEMA = "shard int, term string, n int, most double, ids array<long>, ws array<double>"
#: Sums that differ by less are not told apart when a row is given up: twice the last digit of a score.
SLACK = 2e-6


def _cut(shards: np.ndarray, terms: list[str], sizes: np.ndarray, ids: np.ndarray, ws: np.ndarray) -> pa.RecordBatch:
    """Index rows of whole postings lists, one after the other: ``sizes`` postings of each (shard, term)."""
    number = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    start = (np.cumsum(sizes) - sizes)[of] + nth * BLOCK
    ends = np.append(start[1:], len(ids))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(start, len(ids)).astype(np.int32)), pa.array(values))
    most = np.maximum.reduceat(ws, start) if len(start) else np.zeros(0)
    columns = [pa.array(shards[of].astype(np.int32)), pa.array(terms, pa.string()).take(pa.array(of)), pa.array((ends - start).astype(np.int32)), pa.array(most), lists(ids), lists(ws)]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "n", "most", "ids", "ws"])


def _members(shard: int, ids: list[np.ndarray]) -> pa.RecordBatch:
    """The row without a term that has a shard's ids."""
    own = np.unique(np.concatenate(ids))
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, None, len(own), 0.0, own, []), kinds)], names=["shard", "term", "n", "most", "ids", "ws"])


def _blocks(batches):
    """Index rows from postings sorted by (shard, term, id). What is held is the last list and the ids of its shard."""
    key, ids, ws, members = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        s, t = batch.column("shard").to_numpy(zero_copy_only=False), batch.column("term").dictionary_encode()
        code, names = t.indices.to_numpy(zero_copy_only=False), t.dictionary.to_pylist()
        i, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "w"))
        first = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (s[1:] != s[:-1])) + 1])
        keys = [(int(s[a]), names[code[a]]) for a in first]
        if key is not None and keys[0] != key:
            yield _cut(np.array([key[0]]), [key[1]], np.array([sum(map(len, ids))]), np.concatenate(ids), np.concatenate(ws))
            ids, ws = [], []
        shard = None if key is None else key[0]
        for own in np.unique(s):
            if shard is not None and own != shard:
                yield _members(shard, members)
                members = []
            shard = int(own)
            members = [*members, np.unique(i[s == own])] if len(members) < 32 else [np.unique(np.concatenate([*members, i[s == own]]))]
        last = first[-1]
        if last:
            held = sum(map(len, ids))
            sizes = np.diff(first)
            sizes[0] += held
            yield _cut(s[first[:-1]], [k[1] for k in keys[:-1]], sizes, np.concatenate([*ids, i[:last]]), np.concatenate([*ws, w[:last]]))
            ids, ws = [], []
        key = keys[-1]
        ids.append(i[last:])
        ws.append(w[last:])
    if key is not None:
        yield _cut(np.array([key[0]]), [key[1]], np.array([sum(map(len, ids))]), np.concatenate(ids), np.concatenate(ws))
        yield _members(key[0], members)


class _Shard:
    """A shard's postings of the wanted terms, ids as places among the shard's sorted ids."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        terms = rows["term"].to_pylist()
        n, most = rows["n"].to_numpy(), rows["most"].to_numpy()
        all_ids, all_ws = (rows[c].combine_chunks() for c in ("ids", "ws"))
        start = np.concatenate([[0], np.cumsum(n)])
        flat = all_ids.flatten().to_numpy()
        own = next((k for k, t in enumerate(terms) if t is None), None)
        self.ids = np.zeros(0, np.int64) if own is None else flat[start[own] : start[own + 1]]
        weight = np.zeros(len(flat))
        with_ws = np.repeat(np.array([t is not None for t in terms], bool), n)
        weight[with_ws] = all_ws.flatten().to_numpy()
        self.terms: dict[str, tuple] = {}
        by: dict[str, list[int]] = {}
        for k, t in enumerate(terms):
            if t is not None:
                by.setdefault(t, []).append(k)
        for t, blocks in by.items():
            blocks.sort(key=lambda k: flat[start[k]])
            at = np.searchsorted(self.ids, np.concatenate([flat[start[k] : start[k + 1]] for k in blocks]))
            bounds = np.concatenate([[0], np.cumsum([n[k] for k in blocks])])
            self.terms[t] = (at, np.concatenate([weight[start[k] : start[k + 1]] for k in blocks]), bounds, most[blocks])

    def best(self, query: list[tuple[str, float]], k: int, allowed: np.ndarray | None = None, digits: int = 6) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, postings scored) of the first k rows, ties by id; ``allowed``: the places that count."""
        own = sorted(((t, q) for t, q in query if t in self.terms and q > 0), key=lambda x: len(self.terms[x[0]][0]))
        total = np.zeros(len(self.ids))
        if allowed is not None:
            barred = np.ones(len(self.ids), bool)
            barred[allowed] = False
            total[barred] = -np.inf
        tops = [q * self.terms[t][3].max() for t, q in own]
        rest = np.concatenate([np.cumsum(tops[::-1])[::-1], [0.0]])
        touched, floor, scored, live = np.zeros(0, np.int64), -np.inf, 0, None
        tries = {len(own) // 4, len(own) // 2, 3 * len(own) // 4}

        def kth(values):
            return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf

        for i, (t, q) in enumerate(own):
            at, w, bounds, most = self.terms[t]
            if live is None and floor > rest[i] + SLACK:
                live = touched
            if live is not None:
                live = live[total[live] + rest[i] + SLACK >= floor]
                block = np.searchsorted(at[bounds[1:] - 1], live)
                inside = block < len(most)
                gain = np.zeros(len(live))
                gain[inside] = q * most[block[inside]]
                live = live[total[live] + gain + rest[i + 1] + SLACK >= floor]
                place = np.searchsorted(at, live)
                hit = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == live)
                total[live[hit]] += q * w[place[hit]]
                scored += int(hit.sum())
                floor = max(floor, kth(total[live]))
                continue
            # a block is left out if neither its rows' sums so far nor its maximum suffice
            reach = np.maximum.reduceat(total[at], bounds[:-1]) + q * most + rest[i + 1]
            good = np.repeat(reach + SLACK >= floor, np.diff(bounds))
            hit = at if good.all() else at[good]
            total[hit] += q * (w if good.all() else w[good])
            scored += len(hit)
            touched = np.union1d(touched, hit)
            touched = touched[np.isfinite(total[touched])]
            floor = max(floor, kth(total[touched]))
            if i in tries and len(touched) >= k:
                # whole sums of the best rows so far are a better bound
                some = touched[np.argpartition(-total[touched], min(2 * k, len(touched)) - 1)[: 2 * k]]
                whole = total[some]
                for t2, q2 in own[i + 1 :]:
                    at2, w2 = self.terms[t2][:2]
                    place = np.minimum(np.searchsorted(at2, some), len(at2) - 1)
                    hit = at2[place] == some
                    whole[hit] += q2 * w2[place[hit]]
                    scored += int(hit.sum())
                floor = max(floor, kth(whole))
        rows = touched if live is None else live
        score = np.round(total[rows], digits)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order], scored


def _shard(spark: SparkSession, id_: str, shards: int) -> Column:
    """The shard of an id. Its numbers are such that Spark's hash puts each shard into a bucket of its own."""
    numbers = spark.range(32 * shards).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(shards)).alias("b")).agg(F.min("v").alias("v"))
    own = dict(numbers.collect())
    # a bucket that none of the numbers falls into leaves its number to another bucket's shard
    named = json.dumps([own.get(b, 32 * shards + b) for b in range(shards)])
    return F.element_at(F.from_json(F.lit(named), "array<int>"), (F.pmod(F.xxhash64(id_), F.lit(shards)) + 1).cast("int"))


class BlockIndex:
    """The index of a corpus under ``path``; ``shards`` is the number of buckets that it was written with."""

    def __init__(self, spark: SparkSession, path: str, shards: int):
        self.spark, self.path, self.shards = spark, path, shards
        # the catalog of a session knows a bucketed table by name; the files are those under the path
        self.name = f"lodestone_blocks_{zlib.crc32(path.encode()):08x}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (shard) SORTED BY (shard, term) INTO {shards} BUCKETS LOCATION '{path}/blocks'")

    @classmethod
    def write(cls, df: DataFrame, path: str, id_: str = "id", text: str = "text", model: BM25 = BM25(), shard_rows: int = SHARD_ROWS) -> BlockIndex:
        """Indexes rows whose ids are unique integers: postings are made in a scan and shuffled once, by shard."""
        spark = df.sparkSession
        shards = max(spark.sparkContext.defaultParallelism, -(-df.count() // shard_rows))
        each = postings(df.where(F.col(id_).isNotNull()), id_, text, model).withColumn("shard", _shard(spark, "id", shards))
        rows = each.repartition(shards, "shard").sortWithinPartitions("shard", "term", "id").select("shard", "term", F.col("id").cast("long").alias("id"), "w").mapInArrow(_blocks, SCHEMA)
        name = f"lodestone_blocks_{zlib.crc32(path.encode()):08x}"
        rows.write.bucketBy(shards, "shard").sortBy("shard", "term").option("path", f"{path}/blocks").format("parquet").mode("overwrite").saveAsTable(name)
        spark.createDataFrame([(shards,)], "shards int").write.mode("overwrite").parquet(f"{path}/shards")
        return cls(spark, path, shards)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BlockIndex:
        return cls(spark, path, spark.read.parquet(f"{path}/shards").first()[0])

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def size(self) -> DataFrame:
        """One row: postings and rows of the index."""
        return self.rows().agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("postings"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("rows"))

    def top(self, queries: DataFrame, k: int, ids: DataFrame | None = None, model: BM25 = BM25(), rows: DataFrame | None = None, counts: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of each query's first k, ties by id; with ``counts`` also the postings scored in each shard.

        ``queries``: (query_id, text). ``ids`` (id): the only rows that count. With ``model.idf`` terms are weighted by their rarity
        among ``rows``, which ``ids`` must not narrow. Queries' terms are sent to the tasks in parts of bounded size.
        """
        q = query_weights(queries, model=model)
        if model.idf:
            if ids is not None:
                raise ValueError("rarity is that of the whole index")
            q, names = _sent(q)
            # few terms are named to the scan, which then skips the others' row groups
            held = self.rows().select("term", "n").where(F.col("term").isin(names)) if names is not None else self.rows().select("term", "n").join(q.select("term").distinct(), "term", "left_semi")
            holders = held.groupBy("term").agg(F.sum("n").alias("df"))
            q = q.join(_rarity(holders, rows), "term").select("query_id", "term", (F.col("q") * F.col("idf")).alias("q"))
        first = q.limit(MOST_TERMS + 1).toArrow()
        if first.num_rows <= MOST_TERMS and first.nbytes <= TERM_BYTES:
            parts = [first]
        else:
            # a query's terms stay together; a part holds about half of what may be sent
            n = -(-2 * q.count() // MOST_TERMS)
            parts = (q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == p).toArrow() for p in range(n))
        out = None
        for part in parts:
            found = self._part(part, k, ids, counts)
            out = found if out is None else out.unionByName(found)
        return out if counts else top_per_query(out, k)

    def _part(self, terms: pa.Table, k: int, ids: DataFrame | None, counts: bool) -> DataFrame:
        by: dict[int, list[tuple[str, float]]] = {}
        for query, term, q in zip(*(terms[c].to_pylist() for c in ("query_id", "term", "q"))):
            by.setdefault(query, []).append((term, q))
        sent = self.spark.sparkContext.broadcast(by)
        names = sorted({t for own in by.values() for t, _ in own})
        rows = self.rows()
        if len(names) <= NAMED_TERMS:
            rows = rows.where(F.col("term").isin(names) | F.col("term").isNull())
        else:
            rows = rows.join(F.broadcast(self.spark.createDataFrame([(t,) for t in names], "named string")), F.col("term") == F.col("named"), "left").where("named IS NOT NULL OR term IS NULL").drop("named")

        def found(shard: _Shard, allowed=None) -> pa.Table:
            cols: tuple[list, list, list] = ([], [], [])
            scored = 0
            for query, own in sent.value.items():
                ids, scores, n = shard.best(own, k, allowed)
                scored += n
                for c, v in zip(cols, ([query] * len(ids), ids.tolist(), scores.tolist())):
                    c.extend(v)
            if counts:
                return pa.table({"postings": pa.array([sum(len(t[0]) for t in shard.terms.values())]), "scored": pa.array([scored]), "kept": pa.array([len(cols[0])])})
            return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

        schema = "postings long, scored long, kept long" if counts else "query_id long, id long, score double"
        if ids is None:
            return rows.groupBy("shard").applyInArrow(lambda table: found(_Shard(table)), schema)

        def narrowed(table, own):
            shard = _Shard(table)
            at = np.searchsorted(shard.ids, own["id"].to_numpy())
            known = (at < len(shard.ids)) & (shard.ids[np.minimum(at, max(len(shard.ids) - 1, 0))] == own["id"].to_numpy()) if len(shard.ids) else np.zeros(0, bool)
            return found(shard, at[known] if len(shard.ids) else None)

        dealt = ids.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").withColumn("shard", _shard(self.spark, "id", self.shards))
        return rows.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(narrowed, schema)
