"""Indexes that skip work: block maxima, lists of vectors, trigrams, Bloom filters."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import contains_like
from lodestone.operators import blockmax, catalogue, retrieval, trigrams
from lodestone.operators.blockmax import BlockIndex
from lodestone.operators.vector_index import VectorIndex
from lodestone.sources.store import Table

DATA = "/root/testdata/sf0.01"


def _corpus(spark, n=3000, seed=3):
    """Texts whose words' frequencies fall as a power; some are alike, empty, null or very long."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    say = lambda k: " ".join(r.choices(words, weights, k=k))
    rows = [(i * 7 - 50, say(r.randint(1, 80))) for i in range(n)]
    rows += [(100_000 + i, rows[5][1]) for i in range(20)] + [(200_000, None), (200_001, ""), (200_002, " .. "), (200_003, say(20_000))]
    return spark.createDataFrame(rows, "id long, text string").repartition(5), say


def _rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


@pytest.mark.parametrize("shard_rows", [200, 10**6])
def test_block_index_equals_adding_up(spark, tmp_path, shard_rows):
    docs, say = _corpus(spark)
    index = BlockIndex.write(docs, f"file://{tmp_path}/i", shard_rows=shard_rows)
    given = [(k, say(k)) for k in range(1, 30)] + [(40, ""), (41, None), (42, "nowhere"), (43, "w0 w0 w1 nowhere"), (44, say(300))]
    queries = spark.createDataFrame(given, "query_id long, text string")
    posts = retrieval.postings(docs).persist()
    for k in (1, 5, 5000):
        want = _rows(retrieval.top_per_query(retrieval.posting_scores(posts, queries), k))
        assert _rows(index.top(queries, k)) == want and want
    some = docs.where("id % 3 = 0").select("id").unionByName(spark.createDataFrame([(999_999,), (None,)], "id long"))
    assert _rows(index.top(queries, 5, ids=some)) == _rows(retrieval.top_per_query(retrieval.posting_scores(posts, queries, some), 5))
    rare = retrieval.BM25(idf=True)
    assert _rows(index.top(queries, 5, model=rare, rows=docs)) == _rows(retrieval.top_per_query(retrieval.posting_scores(posts, queries, rows=docs, model=rare), 5))
    again = BlockIndex.open(spark, f"file://{tmp_path}/i")
    assert again.shards == index.shards and again.size().first()["postings"] == posts.count()
    assert index.top(queries.limit(0), 5).count() == 0 and index.top(queries, 5, ids=some.limit(0)).count() == 0


def test_block_index_in_parts(spark, tmp_path, monkeypatch):
    docs, say = _corpus(spark, 300)
    index = BlockIndex.write(docs, f"file://{tmp_path}/i")
    queries = spark.createDataFrame([(k, say(9)) for k in range(20)], "query_id long, text string")
    want = _rows(index.top(queries, 4))
    monkeypatch.setattr(blockmax, "MOST_TERMS", 30)
    monkeypatch.setattr(blockmax, "NAMED_TERMS", 2)
    assert _rows(index.top(queries, 4)) == want


def test_block_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    index = BlockIndex.write(empty, f"file://{tmp_path}/i")
    assert index.top(spark.createDataFrame([(1, "a")], "query_id long, text string"), 3).count() == 0


def test_block_index_leaves_postings_out(spark, tmp_path):
    """A part of the postings is scored, no more than k rows a query and shard leave a task, and shards are read without a shuffle."""
    docs, say = _corpus(spark, 6000)
    index = BlockIndex.write(docs, f"file://{tmp_path}/i", shard_rows=2000)
    queries = spark.createDataFrame([(k, f"w{300 + k} w{200 + k} w{100 + k} " + say(6)) for k in range(30)], "query_id long, text string")
    rare = retrieval.BM25(idf=True)
    counted = index.top(queries, 5, model=rare, rows=docs, counts=True).agg(F.sum("scored"), F.sum("kept"), F.count("*")).first()
    every = retrieval.postings(docs).join(retrieval.query_weights(queries), "term").count()
    assert counted[0] < 0.5 * every and counted[1] <= 5 * 30 * counted[2]
    plan = index.top(queries, 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    assert "Exchange hashpartitioning" not in below and "Bucketed: true" in below


def test_vector_index(spark, tmp_path):
    r = np.random.default_rng(1)
    centres = r.standard_normal((30, 16)) * 3
    rows = [(i, (centres[i % 30] + r.standard_normal(16)).tolist()) for i in range(3000)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, rows[7][1]), (5004, rows[7][1])]
    df = spark.createDataFrame(rows + odd, "id long, embedding array<double>")
    index = VectorIndex.write(df, f"file://{tmp_path}/v", 40)
    queries = spark.createDataFrame([(q, rows[q * 11][1]) for q in range(60)] + [(99, [])], "query_id long, vector array<double>")
    exact = {(x["query_id"], x["id"]): x["score"] for x in retrieval.dense_batch(df, queries, 10).collect()}
    probes = index.probes_for(0.95)
    found = index.top(queries, 10, probes)
    got = {(x["query_id"], x["id"]): x["score"] for x in found.collect()}
    assert probes < 20 and len(set(got) & set(exact)) >= 0.9 * len(exact)
    assert all(got[k] == exact[k] for k in set(got) & set(exact))
    assert _rows(index.top(queries, 10, 40)) == _rows(retrieval.dense_batch(df, queries, 10))  # all lists: exact
    plan = index.top(queries.where("query_id = 3"), 10, 2)._jdf.queryExecution().executedPlan().toString()
    lists = re.search(r"PartitionFilters: \[list#\d+ IN \((\d+),(\d+)\)\]", plan)  # two partitions are read
    assert lists and int(lists[1]) != int(lists[2])
    assert index.top(queries.limit(0), 10, 2).count() == 0
    with pytest.raises(Exception, match="lengths"):
        index.top(spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>"), 3, 1).collect()


def test_vector_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    VectorIndex.write(spark.createDataFrame([(1, [0.0, 0.0])], empty.schema), f"file://{tmp_path}/z", 4)


def test_unequal_vectors_raise(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="lengths"):
        retrieval.dense_batch(df, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"), 1).collect()


def _names(spark):
    r = random.Random(8)
    parts = ["Get", "user", "NAME", "io", "É", "_x", "%", "token", "a", "日本語"]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 5))), f"m{i % 9}." + "".join(r.choices(parts, k=2))) for i in range(800)]
    return spark.createDataFrame([*rows, (900, None, "getUser"), (901, "", None), (902, "ab", None)], "id long, name string, full_symbol string").withColumns({"repo": F.lit("r"), "filepath": F.lit("f"), "start_line": F.col("id")})


def test_trigram_index_equals_a_scan(spark, tmp_path, monkeypatch):
    rows = _names(spark).persist()
    index = trigrams.TrigramIndex.write(rows, f"file://{tmp_path}/t")
    patterns = ["user", "GETUSER", "tokenÉ", "é", "io", "", "%", "user%name", "u_er", "日本語", "m3.", "nowhere", "name_xtok", "x'y\\"]
    for limit in (trigrams.NAMED_IDS, 3):  # by named ids and by a join
        monkeypatch.setattr(trigrams, "NAMED_IDS", limit)
        for p in patterns:
            match = F.coalesce(contains_like(F.col("name"), p), F.lit(False)) | F.coalesce(contains_like(F.col("full_symbol"), p), F.lit(False))
            assert sorted(r["id"] for r in index.containing(p).collect()) == sorted(r["id"] for r in rows.where(match).collect()), p
    assert [r["id"] for r in index.find("user", "r", 4).collect()] == sorted(r["id"] for r in index.containing("user").collect())[:4]
    assert index.candidates("io") is None and trigrams.pattern_grams("user%name") == ["ame", "nam", "ser", "use"]


def test_trigram_index_reads_row_groups_of_its_grams(spark, tmp_path):
    rows = _names(spark)
    index = trigrams.TrigramIndex.write(rows, f"file://{tmp_path}/t")
    found = index.candidates("tokenget")
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().executedPlan().toString()
    few = index.containing("tokenuser")
    assert "PushedFilters: [In(id" in few._jdf.queryExecution().executedPlan().toString() or few.count() == 0


def _scanned(df):
    """Rows that the scan of a plan gave to the filter above it."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_point_filters_skip_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") * 2 % 5000).alias("doc"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    plain = Table(spark, f"file://{tmp_path}/a", rows.schema, ["k"])
    own = Table(spark, f"file://{tmp_path}/b", rows.schema, ["k"], indexed=["doc", "pad"], block=1 << 18)
    for t in (plain, own):
        t.upsert(rows)
        assert t.read().count() == 60_000
    here, gone = "doc = 'v44'", "pad = sha2('nowhere', 256)"
    assert own.read().where(here).count() == plain.read().where(here).count() == rows.where(here).count() > 0
    assert 0 < _scanned(own.read().where(here)) < 0.5 * _scanned(plain.read().where(here))  # by order
    # no row has it, though it lies between others: Bloom filters alone tell
    assert _scanned(own.read().where(gone)) < 0.2 * _scanned(plain.read().where(gone))
    assert own.read().where("pad = sha2('77', 256)").count() == 1


def test_an_index_follows_its_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "en", "s"), (2, "b c", "en", "s")], "doc_id long, text string, lang string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    first = catalogue._blocks(spark, str(tmp_path))
    assert catalogue._blocks(spark, str(tmp_path)).path == first.path
    rows.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, "c c", "en", "s")], rows.schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    later = catalogue._blocks(spark, str(tmp_path))
    assert later.path != first.path and later.size().first()["rows"] == 1


def test_first_rows_of_texts_and_postings_are_those_of_all_scores(spark, monkeypatch):
    """In pieces of any size, with repeated ids, null texts and queries without hits; scores are not shuffled before tasks keep their best."""
    r = random.Random(3)
    say = lambda n: " ".join(f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(n))
    docs = spark.createDataFrame([(i, say(r.randrange(40))) for i in range(200)] + [(500, None)], "id long, text string").repartition(7)
    queries = spark.createDataFrame([(i, say(6)) for i in range(9)] + [(9, "absent"), (10, "")], "query_id long, text string")
    posts = retrieval.postings(docs)
    for cells, products in ((1 << 17, 1 << 20), (20, 5)):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        monkeypatch.setattr(retrieval, "PRODUCTS", products)
        for model in (retrieval.BM25(), retrieval.BM25(stop=("w1",)), retrieval.BM25(idf=True)):
            want = _rows(retrieval.top_per_query(retrieval.sparse_scores(docs, queries, model=model), 4))
            assert _rows(retrieval.sparse_batch(docs, queries, 4, model=model)) == want
            if not model.stop:
                assert _rows(retrieval.posting_batch(posts, queries, 4, rows=docs, model=model)) == want
    twice = docs.unionByName(docs.where("id < 50").select("id", F.lit("w1 w2 w3").alias("text")))
    whole = twice.groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    assert _rows(retrieval.sparse_batch(twice, queries, 4)) == _rows(retrieval.sparse_batch(whole, queries, 4))
    plan = retrieval.sparse_batch(docs, queries, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan
