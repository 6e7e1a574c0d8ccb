import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import catalogue, changes, chunking, filters, keywords, retrieval, symbols


def _greedy(text, most, overlap):
    """Chunks by the definition, line by line."""
    if len(text) <= most:
        return [(text, 1, len(text.splitlines()))]
    done, held, size, first = [], [], 0, 1
    for n, line in enumerate(text.splitlines(keepends=True), 1):
        if held and size + len(line) > most:
            done.append(("".join(held), first, n - 1))
            keep = []
            for x in held[::-1]:
                if sum(map(len, keep)) + len(x) > overlap:
                    break
                keep = [x, *keep]
            held, size, first = keep, sum(map(len, keep)), n - len(keep)
        held.append(line)
        size += len(line)
    return [*done, ("".join(held), first, n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "long line of text", "\n", "\r\n", "\x0b", "\u2028", "\x1c", " ", "é"]), max_size=120).map("".join), st.integers(1, 60), st.integers(0, 40))
def test_by_length(text, most, overlap):
    assert chunking.by_length(text, most, overlap) == _greedy(text, most, overlap)


def test_by_heading():
    md = "intro\n# Top Title\nx\n## Section 1\ny\n### Sub 1.1\nz\n```\n# in code\n```\n####### no\n#no"
    got = chunking.by_heading(md)
    assert [(h, a, z) for _, a, z, h in got] == [("Root", 1, 1), ("Top Title", 2, 3), ("Section 1", 4, 5), ("Sub 1.1", 6, 8), ("in code", 9, 12)]
    long = "# H\n" + "\n".join("word " * 20 for _ in range(20))
    parts = chunking.by_heading(long, 400, 50)
    assert len(parts) > 1 and {p[3] for p in parts} == {"H"}


def test_front_matter():
    head, body = chunking.front_matter("---\ncategory: a\ntags: [x, 1]\n---\nbody\n")
    assert (head["category"], chunking.header_tags(head), body) == ("a", ["x", "1"], "body")
    for t in ("---\n: [\n---\nx", "---\nopen", "none"):
        assert chunking.front_matter(t) == ({}, t)


def test_split_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "  ")], "doc_id long, text string")
    assert {r["id"] for r in chunking.split(df).collect()} == {1, 2, 3}
    assert {r["id"] for r in chunking.split(df, blank=False).collect()} == {1}


@pytest.mark.parametrize(
    ("path", "code", "names"),
    [
        ("a.rs", "pub struct S { x: i32 }\nimpl S {\n  pub fn get(&self) -> i32 { self.x }\n}\nenum E { A }\n", {"S", "S.get", "E"}),
        ("A.java", "public class A {\n  private int x;\n  public int get(int k) {\n    if (k > 0) { return k; }\n    return x;\n  }\n}\n", {"A", "A.get"}),
        ("a.ts", "interface I { x: number }\nexport class C {\n  run(): void {\n  }\n}\ntype T = string;\n", {"I", "C", "C.run", "T"}),
        ("a.rb", "module M\n  class K\n    def go\n      if x\n        1\n      end\n    end\n  end\nend\n", {"M", "M.K", "M.K.go"}),
        ("a.php", "<?php\nclass P {\n  public function f($x) { return \"}\"; }\n}\nfunction g() { }\n", {"P", "P.f", "g"}),
        ("a.cs", "namespace N {\n class C {\n  public int M(int x) { return x; }\n }\n}\n", {"C", "C.M"}),
        ("a.c", "struct s { int x; };\nstatic int f(int a) {\n  return a; /* } */\n}\n", {"s", "f"}),
    ],
)
def test_symbols(path, code, names):
    found, chunks = symbols.extract(code, path)
    assert {s["full_symbol"] for s in found} == names
    assert all(1 <= s["start_line"] <= s["end_line"] <= code.count("\n") + 1 for s in found) and len(chunks) == len(found)


def test_symbol_fallbacks():
    assert symbols.extract("x = 1\n", "a.py") == ([], [{"symbol": None, "kind": "module", "heading": "a.py", "content": "x = 1\n", "start_line": 1, "end_line": 1}])
    assert symbols.extract("def (", "a.py")[1][0]["kind"] == "code"
    assert symbols.extract("prose", "a.xyz")[1][0]["kind"] == "code"
    long = "class A:\n" + "".join(f"    x{i} = {i}\n" for i in range(300))
    _, chunks = symbols.extract(long, "a.py")
    assert len(chunks) > 1 and chunks[0]["start_line"] == 1 and chunks[-1]["end_line"] == 301 and {c["symbol"] for c in chunks} == {"A"}


def _corpus(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["red", "green", "blue", "tree", "house"]) for _ in range(r.randrange(1, 30))), "en" if i % 2 else "de", [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    return spark.createDataFrame(rows, "id long, text string, lang string, embedding array<double>")


def test_fusion_and_filters(spark):
    df = _corpus(spark)
    q = spark.createDataFrame([(0, "red tree", [1.0, 0.0, 0.0, 0.0]), (1, "?", [0.0, 1.0, 0.0, 0.0])], "query_id long, text string, vector array<double>")
    got = retrieval.hybrid(df.drop("embedding"), df.select("id", "embedding"), q, 5, where=F.col("lang") == "en").collect()
    assert all(r["id"] % 2 for r in got) and {r["query_id"] for r in got} == {0, 1}
    dense = {r["id"]: r["rank"] for r in retrieval.dense_batch(df.where("lang = 'en'"), q.where("query_id = 0"), 10).collect()}
    sparse = {r["id"]: r["rank"] for r in retrieval.top_per_query(retrieval.sparse_scores(df.where("lang = 'en'"), q.where("query_id = 0")), 10).collect()}
    for r in got:
        if r["query_id"] == 0:
            want = sum(1 / (60 + ranks[r["id"]]) for ranks in (dense, sparse) if r["id"] in ranks)
            assert r["score"] == pytest.approx(want, abs=1e-8)
        else:  # no terms: the cosine itself
            assert abs(r["score"]) <= 1 and r["score"] > 1 / 60


def test_queries_in_blocks(spark, monkeypatch):
    df = _corpus(spark)
    q = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, retrieval.dense_batch(df, q, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 7 * 4 * 8)
    assert sorted(map(tuple, retrieval.dense_batch(df, q, 3).collect())) == whole


def test_long_queries_score_alike(spark, monkeypatch):
    df = _corpus(spark).withColumn("sparse", F.map_from_entries(retrieval.sparse_vector(F.col("text"))))
    query = [("red", 1.5), ("tree", 0.5), ("no \"such'", 2.0)]
    one = retrieval.sparse_top_k(df, query, 10).select("id", "score").collect()
    monkeypatch.setattr(retrieval, "FEW_TERMS", 0)
    assert retrieval.sparse_top_k(df, query, 10).select("id", "score").collect() == one and one[0]["score"] > 0
    many = [(f"t{i}", 1.0) for i in range(3000)] + query
    assert retrieval.sparse_top_k(df, many, 10).select("id", "score").collect() == one


def test_metadata(spark):
    df = spark.createDataFrame([("a", "doc", ["x"]), ("b", "code", []), (None, "doc", None)], "repo string, doc_type string, tags array<string>")
    n = lambda **k: df.where(filters.metadata(**k)).count()
    assert (n(), n(repo="a"), n(repo=""), n(doc_type="all"), n(tag="x"), n(repo="a", doc_type="code")) == (3, 1, 3, 3, 1, 0)


def test_log_edges(spark):
    df = spark.range(10).select(F.col("id").alias("seq"))
    for n, want in ((3, [9, 8, 7]), (0, list(range(9, -1, -1))), (-7, [9, 8, 7]), (-20, [])):
        assert [r[0] for r in filters.log_tail(df, n).collect()] == want


def test_keyword_cloud_skips_bad_json(spark):
    df = spark.createDataFrame([(1, '["b","a"]'), (2, "{"), (3, '["a","c"]'), (4, None)], "id long, keywords string")
    assert [tuple(r) for r in keywords.keyword_cloud(df).collect()] == [("a", 2), ("b", 1), ("c", 1)]


def test_poll(spark):
    repos = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False), (4, None, True), (5, "e", True)], "id long, commit_sha string, auto_sync boolean")
    heads = spark.createDataFrame([(1, "a"), (2, "x"), (3, "x"), (4, "d"), (5, None)], "id long, sha string")
    assert tuple(changes.poll(repos, heads).first()) == (3, 2)
    assert {r["id"] for r in changes.stale_repositories(repos, heads).collect()} == {2, 3, 4, 5}


def test_counted_keywords_shuffle_texts_once(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (1, "beta gamma beta"), (2, None), (None, "delta delta")], "doc_id long, text string")
    out = keywords.counted_keywords(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((str(r["id"]), r["rank"], r["word"], r["n"]) for r in out.collect()) == [("1", 1, "beta", 3), ("1", 2, "alpha", 2), ("1", 3, "gamma", 1), ("None", 1, "delta", 2)]


def test_queries_send_texts_to_python_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    catalogue.keyword_cloud(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
