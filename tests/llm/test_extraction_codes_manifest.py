"""HTML extraction, vector codes and the Merkle manifest against plain versions, SQL and odd input."""

import hashlib
import html
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import html_extraction as he
from lodestone.llm import merkle_manifest as mm
from lodestone.llm import vector_codes as vc

TABLES = "documents embeddings pages labels".split()


def _sql(text, data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    out = con.sql(text)
    return sorted(map(repr, ({c: v for c, v in sorted(zip(out.columns, r))} for r in out.fetchall())))


@pytest.mark.parametrize("module", [mm, vc])
def test_query_against_sql(spark, data, module):
    got = sorted(repr(dict(sorted(r.asDict().items()))) for r in module.query(spark, data).collect())
    assert got == _sql(module.ORACLE_SQL, data)


# --- Merkle manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def _climb(nodes, paths):
    """The root of labelled nodes [(digest, members)], noting each member's sibling on the way."""
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for k, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append(run[1 - k][0] if len(run) == 2 else "")
            up.append((_h(*(d for d, _ in run)), [m for _, ms in run for m in ms]))
        nodes = up
    return nodes[0][0]


def _plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    paths, of, subroots, ids = {}, {}, [], []
    for lang in sorted(groups, key=lambda v: (v is not None, (v or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _plain_leaf(r)))
        keys = [(lang, i) for i in range(len(own))]
        paths |= {k: [] for k in keys}
        of |= dict(zip(keys, own))
        top = _climb([(_plain_leaf(r), [k]) for r, k in zip(own, keys)], paths)
        subroots.append((top, keys))
        ids += [(k, top) for k in keys]
    root = _climb(subroots, paths)
    return sorted((str(of[k]["doc_id"]), _plain_leaf(of[k]), top, root, _h(*paths[k])) for k, top in ids)


def _columns(rows):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows)


def test_manifest_of_odd_rows(spark, frame, odd):
    docs = frame(odd).withColumn("lang", F.expr("CASE WHEN doc_id = 9 THEN 'zz' WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id > 12 THEN '' ELSE 'é' END")).withColumn("pos", F.lit("x")).withColumn("hash", F.lit("y"))
    rows = [r.asDict() for r in docs.collect()]
    got = mm.manifest(docs).collect()
    assert _columns(got) == _plain_manifest(rows)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)
    altered = mm.manifest(docs, F.col("doc_id") % 2 == 0).collect()
    assert _columns(altered) == _plain_manifest(rows)
    hit = {r["doc_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] % 2 == 0 and r["n_chars"] is not None}
    assert {r["doc_id"] for r in altered if not r["verified"]} == hit and hit


def test_manifest_over_several_bands(spark):
    n = (1 << mm.BAND) * 2 + 77
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") < 3, "b").otherwise("a").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rows = [r.asDict() for r in docs.collect()]
    got = mm.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0).collect()
    assert _columns(got) == _plain_manifest(rows)
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i in range(n) if zlib.crc32(str(i).encode()) % 7 == 0}
    for r in got[:50]:  # a proof leads from the leaf to the root
        assert mm.folded(r["leaf"], r["proof"]) == r["root"]


def test_manifest_of_one_row_and_none(spark, frame):
    [r] = mm.manifest(frame([(5, "a b")])).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == _h() and r["verified"]
    assert mm.manifest(frame([])).collect() == []


# --- vector codes


def _plain_codes(rows, rounds=4):
    kept = [(i, [int(np.floor(x * 1024)) for x in map(float, v)]) for i, v in rows if v and len(v) % 4 == 0 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in kept[:256]] for p in range(4)]
    assign = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[assign(v, p)[1] for p in range(4)] for _, v in kept]
        for p in range(4):
            for k in range(len(books[p])):
                if own := [cut(v, p) for (_, v), a in zip(kept, at) if a[p] == k]:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, v in kept:
        best = [assign(v, p) for p in range(4)]
        out.append((str(i), "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return sorted(out), books


VECTORS = "vec_id long, embedding array<float>, label int, v string, now string, error string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, i and i % 3, "x", "y", "z") for i, v in rows], VECTORS)


def _odd_vectors():
    r = random.Random(4)
    some = [(i, [r.gauss(0, 0.3) + (i % 7) * 0.2 for _ in range(8)]) for i in range(700)]
    return [*some, *some[5:9], (700, None), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (704, []), (705, [0.5] * 4), (706, [0.5] * 6), (None, [0.1] * 8), (707, [0.25] * 8), (708, [0.25] * 8)]


def test_codes_of_odd_vectors(spark):
    rows = _odd_vectors()
    coded, books = vc.code(_vectors(spark, rows))
    want, want_books = _plain_codes(rows)
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in coded.collect()) == want
    assert books.tolist() == want_books


def test_fewer_vectors_than_entries_and_none(spark):
    rows = _odd_vectors()[:40]
    coded, books = vc.code(_vectors(spark, rows))
    want, want_books = _plain_codes(rows)
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in coded.collect()) == want and books.tolist() == want_books
    for given in ([], [(1, None)], [(1, [1.0] * 6)]):
        assert vc.code(_vectors(spark, given))[0].collect() == []


def test_large_components_stay_exact():
    r = np.random.default_rng(1)
    x, book = r.integers(-vc._MOST, vc._MOST, (50, 16)), r.integers(-vc._MOST, vc._MOST, (20, 16))
    at, far = vc.nearest(x, book)
    for k in range(50):
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[k], e)) for e in book]
        assert far[k] == min(d) and at[k] == d.index(min(d))


def test_only_changed_assignments_contribute(spark):
    """What a round sends is as many rows as there are entries whose members changed, and equals the difference of full sums."""
    shape = "vec_id long, label int, v array<int>, was binary, now binary, error long"
    code = lambda *k: bytearray(k)
    rows = [(1, 0, [1, 2, 3, 4], code(0, 0, 0, 0), code(0, 0, 0, 0), 0), (2, 0, [5, 6, 7, 8], code(0, 0, 0, 0), code(0, 1, 0, 0), 0), (3, 0, [9, 9, 9, 9], None, code(1, 1, 1, 1), 0)]
    got = vc.changes(spark.createDataFrame(rows, shape).coalesce(1), 2, 1).collect()
    assert sorted((r["part"], r["entry"], r["n"], r["sums"][0]) for r in got) == [(0, 1, 1, 9), (1, 0, -1, -6), (1, 1, 2, 15), (2, 1, 1, 9), (3, 1, 1, 9)]


# --- HTML extraction


def _truth(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


@pytest.fixture(scope="module")
def model(spark, data):
    return he.train(spark.read.parquet(f"{data}/pages.parquet"), sample=120)


def test_articles_of_pages_it_did_not_learn_from(spark, model, data):
    known = {r["page_id"] for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id").collect()}
    pages = spark.read.parquet(f"{os.path.dirname(data)}/sf0.1/pages.parquet").where(F.col("page_id") % 5 == 0)
    want = {r["page_id"]: _truth(r["html"]) for r in pages.collect() if r["page_id"] not in known}
    got = {r["page_id"]: r["text"] for r in he.extract(pages, model).collect()}
    assert len(want) > 400 and all(got[i] == t for i, t in want.items())


def test_blocks_of_layouts_it_did_not_learn_from(model):
    r, reader = random.Random(123), he.Reader()
    words = [f"{a}{b}" for a in ("sun", "moon", "tree", "road") for b in ("light", "s", "ward", "ing")]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(2, 50))) + "." for _ in range(100)]
    right = total = 0
    for _ in range(200):
        page = reader.blocks(he.layout(texts, words, r))
        if page:
            z, mask = he.padded([model.embed(he.describe(page, he.place([page]), reader))])
            found = model.score(z, mask)[:, 0] >= 0.5
            right += sum(f == (reader.label[b[1]] == 1) for f, b in zip(found, page))
            total += len(page)
    assert right / total > 0.97


def test_gradient_by_differences():
    r = np.random.default_rng(2)
    m = he.Labeller(5)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    x, mask = he.padded([r.standard_normal((n, he.INPUT)) * 0.2 for n in (3, 5, 1)])
    x, y = x.astype(float), r.integers(0, 2, mask.shape).astype(float)
    _, grad = m.gradient(x, mask, y)
    for k, a in m.p.items():
        flat, i = a.reshape(-1), int(np.abs(grad[k]).argmax())
        kept, step = flat[i], 1e-4
        flat[i] = kept + step
        up = m.gradient(x, mask, y)[0]
        flat[i] = kept - step
        down = m.gradient(x, mask, y)[0]
        flat[i] = kept
        assert (up - down) / (2 * step) == pytest.approx(grad[k].reshape(-1)[i], rel=0.02, abs=1e-5)


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p>a <b>b</b>c<p>d&amp;e &lt;f&gt; &eacute;&#233;&#xe9;&nbsp;g", ["a bc", "d&e <f> éé\xe9 g"]),
        ("<ul><li>x<li>y <ul><li>z</ul></ul>w", ["x", "y", "z", "w"]),
        ("a<!-- <p>b -->c<script>if (x<y) '<p>';</script>d<style>p{}</style>", ["acd"]),
        ("<div title='1 > 0' class=\"a\">x</div><br/>y<hr>z", ["x", "y", "z"]),
        ("1 < 2 and 3 > 2 &am <p", ["1 < 2 and 3 > 2 &am"]),
        ("<table><tr><td>a<td>b<tr><th>c</table></section></p>d", ["a", "b", "c", "d"]),
        ("<TITLE>no</TITLE><P>\n a\t\tb </P><textarea>no</textarea><!-- open", ["a b"]),
        ("", []), ("<p> </p>", []), ("plain", ["plain"]),
    ],
)
def test_blocks(page, blocks):
    assert [b[0] for b in he.Reader().blocks(page)] == blocks


def test_pages_of_odd_rows(spark, model):
    long = "<body><nav><a href='/'>home</a></nav><article>" + "<p>The river stone is light under the road.</p>" * 20_000 + "</article><footer>end</footer>"
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (3, "u", "   "), (4, "u", long), (None, "u", "<article><p>a</p></article>"), (5, "u", deep), (6, "u", "<a \"" * 20_000), (7, "u", "<script>never closed" + "<p>" * 1000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = he.extract(pages, model).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in got) == sorted((i or 0, u or "") for i, u, _ in rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[3] == by[7] == ""
    assert by[4].count("river") == 20_000 and "home" not in by[4]
    assert he.extract(pages.limit(0), model).collect() == []


def test_fit_without_marked_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "u", None)], "page_id long, url string, html string")
    for given in (pages, pages.limit(0)):
        got = he.extract(pages, he.train(given, sample=20, layouts=1)).collect()
        assert len(got) == 2
