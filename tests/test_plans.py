import datetime
import json
import os
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog, retrieval
from lodestone.plans import backends
from lodestone.plans.ingest import CHUNKS, Index, payload
from lodestone.plans.overview import Overview, lines
from lodestone.plans.registry import Registry
from lodestone.plans.search import Profile, Search, embedded, sanitized
from lodestone.sources import files as sources
from lodestone.sources.store import Broken, KeyExists, Table
from lodestone.streaming import feeds


def _write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    _write(root / "a.md", "---\ncategory: architecture\ntags: design, system\n---\n# Top\nfastapi jwt tokens\n## Next\nmore\n")
    _write(root / "src/auth.py", "class AuthService:\n    def authenticate(self):\n        return 1\n")
    _write(root / "src/run.py", "print(1)\n")
    _write(root / "bad.txt", b"ok \xff\xfe end", "wb")
    _write(root / "src/__init__.py", "")
    for hidden in (".git/x.py", "node_modules/y.js", ".z.py", "data.dat", "deep/.h/z.md"):
        _write(root / hidden, "x")
    return root


def test_scan(spark, tree):
    found = {r["rel_path"]: (r["language"], r["doc_type"]) for r in sources.scan(spark, [{"path": str(tree)}]).collect()}
    assert found == {"a.md": ("markdown", "doc"), "src/auth.py": ("python", "code"), "src/run.py": ("python", "code"), "src/__init__.py": ("python", "code"), "bad.txt": ("text", "doc")}
    flat = sources.scan(spark, [{"path": str(tree), "recursive": False}, {"path": str(tree / "src/auth.py"), "type": "file", "repo": "own"}, {"path": "/no/such"}, {"path": str(tree), "enabled": False}])
    assert {(r["rel_path"], r["repo"]) for r in flat.collect()} == {("a.md", "local"), ("bad.txt", "local"), ("auth.py", "own")}
    last = sources.scan(spark, [{"path": str(tree)}, {"path": str(tree / "src"), "repo": "later"}])
    assert {r["rel_path"] for r in last.where("repo = 'later'").collect()} == {"auth.py", "run.py", "__init__.py"}
    text = {r["rel_path"]: r["content"] for r in sources.texts(sources.scan(spark, [{"path": str(tree)}])).collect()}
    assert text["bad.txt"] == "ok  end" and len(text) == 5
    assert sources.head_of("abc\trefs/heads/main\ndef\tx\n") == "abc" and sources.head_of("\n") is None


def test_ingest_and_search(spark, tree, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", embed=embedded)
    assert index.sync_local([{"path": str(tree)}]) == 5
    assert index.sync_local([{"path": str(tree)}]) == 0
    chunks = {(r["rel_path"], r["symbol"] or r["heading"]): r for r in index.chunks.read().collect()}
    assert set(chunks) == {("a.md", "Top"), ("a.md", "Next"), ("src/auth.py", "AuthService"), ("src/auth.py", "AuthService.authenticate"), ("src/run.py", "run.py"), ("bad.txt", "Root")}
    doc, code = chunks["a.md", "Top"], chunks["src/auth.py", "AuthService.authenticate"]
    assert (doc["category"], doc["tags"], doc["language"], doc["doc_type"]) == ("architecture", ["design", "system"], None, "doc")
    assert (code["category"], code["language"], code["kind"], code["start_line"]) == ("python", "python", "function_definition", 2)
    assert "Category: architecture" in doc["embed_text"] and "Category" not in doc["content"]
    summary = index.summaries.read().where("title = 'a.md'").first()
    assert {"fastapi", "jwt", "tokens"} <= set(json.loads(summary["keywords"])) and json.loads(summary["headings"]) == ["Top", "Next"]
    assert {r["full_symbol"] for r in index.symbols.read().collect()} == {"AuthService", "AuthService.authenticate"}

    search = Search(index.chunks.read())
    assert search.hits("fastapi jwt", 3).first()["heading"] == "Top"
    assert search.hits("authenticate", 3, doc_type="code", language="python").first()["symbol"].startswith("AuthService")
    assert search.hits("fastapi", 3, language="python", doc_type="doc").count() == 0
    assert search.hits("  ").count() == 0 and search.search_docs("") == "Nothing to search for."
    block = search.search_docs("fastapi", tag="design", limit=1)
    assert block.startswith("local/a.md:1-2  Top  #design #system  0.0") and block.endswith("\n    # Top\n    fastapi jwt tokens")
    assert search.search_code("x", repo="none") == "No hits."
    texts = Search(index.chunks.read().drop("sparse"))
    for q in ("fastapi jwt", "authenticate", "print more tokens"):
        assert [tuple(r) for r in texts.hits(q, 4).select("id", "score").collect()] == [tuple(r) for r in search.hits(q, 4).select("id", "score").collect()]
    plan = retrieval.sparse_top_k(index.chunks.read().select("id", "sparse"), [("jwt", 1.0)], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "content" not in plan and "ArrowEvalPython" not in plan
    assert search.search_test("fastapi").count() <= 6
    dense = Search(index.chunks.read(), profile=Profile.DENSE).hits("fastapi", 4)
    assert dense.count() == 4 and dense.where("score < 0").count() == 0
    broken = Search(index.chunks.read().drop("dense"), on_error="empty")
    assert broken.hits("fastapi").count() == 0
    with pytest.raises(Exception, match="dense"):
        Search(index.chunks.read().drop("dense")).hits("fastapi")

    os.utime(tree / "src/run.py", (1, 1))
    _write(tree / "src/auth.py", "def other():\n    pass\n")
    os.remove(tree / "a.md")
    assert index.sync_local([{"path": str(tree)}]) == 2
    assert {r["full_symbol"] for r in index.symbols.read().collect()} == {"other"}
    assert index.files.read().count() == 5
    index.sync_local([{"path": str(tree)}], purge=True)
    assert index.files.read().count() == 4 and index.chunks.read().where("rel_path = 'a.md'").count() == 0

    assert index.sync_clone("lib", str(tree), "abc123", "git@github.com:o/lib.git") == 4
    link = index.chunks.read().where("repo = 'lib' AND symbol = 'other'").first()
    assert (link["path"], link["permalink_url"]) == ("lib://src/auth.py", "https://github.com/o/lib/blob/abc123/src/auth.py#L1-L2")
    index.drop("lib")
    assert index.chunks.read().where("repo = 'lib'").count() == 0 and index.files.read().count() == 4


def test_overview(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setenv("GITLAB_TOKEN", "t")
    index, registry = Index(spark, f"file://{tmp_path}/i"), Registry(spark, f"file://{tmp_path}/r")
    view = Overview(index, registry)
    assert view.outline("auth.py").count() == 0 and view.find_symbol(" ").count() == 0 and view.catalog().count() == 0
    index.sync_local([{"path": str(tree)}])
    registry.add_path(str(tree), category="notes")
    one = registry.add_repository("lib", "https://github.com/o/lib", provider="github", auth_token="x")
    registry.set_status(one, "error", "no route")
    assert [(r["name"], r["kind"]) for r in view.find_symbol("auth", exact=False).collect()] == [("AuthService", "class_definition"), ("authenticate", "function_definition")]
    assert [r["signature"] for r in view.outline("auth.py").collect()] == ["class AuthService:", "def authenticate(self):"]
    assert lines(view.outline("auth.py"), "outline").splitlines()[1] == "AuthService.authenticate (function_definition) lines 2-3"
    git, local = view.sources().collect()
    assert (git["name"], git["provider"], git["branch"], git["sha"], git["status"], git["file_count"], git["last_synced"]) == ("lib", "github", "main", None, "error", 0, None)
    assert (local["kind"], local["category"], local["file_count"]) == ("local", "notes", 5)
    status = view.status().first().asDict()
    want = {"points": 6, "files": 5, "symbols": 2, "repositories": 1, "paths": 1, "last_indexed": None, "profile": "hybrid_rrf", "dimension": 384, "vectors_fit": True, "poll_minutes": 15}
    want |= {"repositories_with_token": 1, "hosts_with_token": 0, "environment_tokens": ["GITLAB_TOKEN"]}
    assert status | want == status and "fastapi" in status["top_keywords"] and "x" not in status.values()
    assert {(r["language"], r["more"]) for r in view.catalog().collect()} == {("markdown", 0), ("python", 0), ("text", 0)}
    calls = []
    assert view.sync("lib", calls.append, lambda: calls.append("all")) == one and view.sync("nope", calls.append, lambda: calls.append("all")) is None
    assert calls == [one, "all"]
    index.drop("lib", registry)
    assert registry.repositories.read().count() == 0


def test_poll_until():
    stop, seen = threading.Event(), []

    def cycle():
        seen.append(1)
        if len(seen) == 2:
            stop.set()
        raise ValueError("a cycle that fails")

    minutes = iter([0] * 5)
    assert feeds.poll_until(stop, lambda: next(minutes, 0.00001), cycle, slice_s=0.001, idle_s=0.002) == 2


def test_payload(spark):
    df = spark.createDataFrame([("i", "r", ["t"], {"repo": "own", "extra": "1"})], "id string, repo string, tags array<string>, metadata map<string,string>")
    for field in (f.split()[0] for f in CHUNKS.split(", ")):
        if field not in df.columns:
            df = df.withColumn(field, F.lit(None).cast("string"))
    assert payload(df).first()["payload"] == {"repo": "own", "extra": "1", "tags": '["t"]'}
    m = spark.createDataFrame([({"a": None, "b": "", "c": "1"},)], "metadata map<string,string>")
    assert sanitized(m).first()["metadata"] == {"c": "1"}


def test_store(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k long, v string, p string", ["k"], ["p"])
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "y")], "k long, v string, p string"))
    t.upsert(spark.createDataFrame([(2, "B")], "k long, v string"))
    rows = lambda: {r["k"]: (r["v"], r["p"]) for r in t.read().collect()}
    assert rows() == {1: ("a", "x"), 2: ("B", None), 3: ("c", "y")}
    t.delete(F.col("p") == "x")
    assert rows() == {2: ("B", None), 3: ("c", "y")}
    t.replace("p", "y", spark.createDataFrame([], "k long, v string, p string"))
    assert rows() == {2: ("B", None)}
    with pytest.raises(KeyExists):
        t.insert(spark.createDataFrame([(2, "z")], "k long, v string"))
    assert t.update(F.col("k") == 2, v=F.lit("u")) == 1 and t.update(F.col("k") == 9, v=F.lit("u")) == 0
    t.delete_equal("p", None)
    assert rows() == {}
    wider = Table(spark, f"file://{tmp_path}/t", "k long, v string, p string, w int", ["k"], ["p"])
    assert wider.read().columns == ["k", "v", "p", "w"]
    vectors = Table(spark, f"file://{tmp_path}/v", "id string, dense array<float>", ["id"])
    vectors.upsert(spark.createDataFrame([("a", [1.0, 2.0])], "id string, dense array<float>"))
    assert vectors.fits(2) and not vectors.heal(2) and vectors.heal(3) and vectors.read().count() == 0


def _stored(path):
    return {os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_changes_touch_their_folders_alone(spark, tmp_path):
    schema = "k long, v string, p string"
    t = Table(spark, f"file://{tmp_path}/t", schema, ["k"], ["p"])
    t.upsert(spark.createDataFrame([(i, "a", ["x y", "b/c", "z"][i % 3]) for i in range(9)], schema))
    before = _stored(tmp_path / "t")
    t.upsert(spark.createDataFrame([(100, "new", "w")], schema))
    assert before < _stored(tmp_path / "t")  # appended
    t.replace("p", "b/c", spark.createDataFrame([(1, "r", "b/c")], schema))
    t.upsert(spark.createDataFrame([(0, "u", "x y")], schema))
    t.delete_equal("p", "w")
    assert {f for f in before if "p=z" in f} <= _stored(tmp_path / "t")
    assert not {f for f in before if "p=b" in f} & _stored(tmp_path / "t")
    got = {(r["k"], r["v"], r["p"]) for r in t.read().collect()}
    assert got == {(0, "u", "x y"), (3, "a", "x y"), (6, "a", "x y"), (1, "r", "b/c"), (2, "a", "z"), (5, "a", "z"), (8, "a", "z")}
    t.compact()
    assert {(r["k"], r["v"], r["p"]) for r in t.read().collect()} == got
    assert t.delete(F.col("k") == 77) is None and t.read().count() == 7


@pytest.mark.parametrize("step", ["_holding", "_written", "_publish", "_sweep"])
@pytest.mark.parametrize("after", [False, True])
def test_a_change_that_dies_leaves_whole_versions(spark, tmp_path, monkeypatch, step, after):
    t = Table(spark, f"file://{tmp_path}/t", "k long, v string", ["k"])
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    whole = getattr(Table, step)

    def dying(self, *given):
        if after:
            whole(self, *given)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Table, step, dying)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"))
    old, new = {1: "a", 2: "b"}, {1: "a", 2: "c", 3: "d"}
    other = Table(spark, f"file://{tmp_path}/t", "k long, v string", ["k"])
    published = step == "_sweep" or step == "_publish" and after
    assert {r["k"]: r["v"] for r in other.read().collect()} == (new if published else old)
    other.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"))
    assert {r["k"]: r["v"] for r in t.read().collect()} == new


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    tables = [Table(spark, f"file://{tmp_path}/t", "k long, v string", ["k"]) for _ in range(3)]
    for t in tables:  # each as if in a process of its own
        t._lock = threading.RLock()
    rows = lambda i: spark.createDataFrame([(i * 10 + j, str(i)) for j in range(2)] + [(0, str(i))], "k long, v string")
    tables[0].upsert(rows(0))
    late = tables[1]._publish

    def beaten(version, folders):
        monkeypatch.setattr(tables[1], "_publish", late)
        tables[2].upsert(rows(2))
        return late(version, folders)

    monkeypatch.setattr(tables[1], "_publish", beaten)
    tables[1].upsert(rows(1))
    assert {r["k"]: r["v"] for r in tables[0].read().collect()} == {0: "1", 1: "0", 10: "1", 11: "1", 20: "2", 21: "2"}


def test_rows_without_a_log_are_an_error(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k long", ["k"])
    t.upsert(spark.createDataFrame([(1,)], "k long"))
    shutil.rmtree(tmp_path / "t/_log")
    with pytest.raises(Broken):
        t.read()


def test_registry(spark, tmp_path):
    r = Registry(spark, f"file://{tmp_path}")
    one = r.add_repository("My Repo!", " https://github.com/o/r ", auth_token="ghp_123456789", webhook_secret="s")
    with pytest.raises(KeyExists):
        r.add_repository("my_repo_", "u")
    shown = r.shown_repositories(spark.createDataFrame([("my_repo_",)], "repo string")).first().asDict()
    assert (shown["name"], shown["file_count"], shown["status"]) == ("my_repo_", 1, "pending") and not {"auth_token", "webhook_secret"} & shown.keys()
    assert r.set_auto_sync(one, False) and not r.set_auto_sync(99, False)
    assert r.set_status(one, "synced", sha="abc") and r.repositories.read().first()["commit_sha"] == "abc"
    path = r.add_path("/x")
    r.remove_path(path)
    assert r.paths.read().count() == 0
    r.save_host("https://H.example:8443/x", "secret-token", "me")
    assert r.shown_hosts().first()["auth_token"] == "secr...oken" and r.shown_hosts().first()["host"] == "h.example:8443"
    repos = spark.createDataFrame([(1, "https://h.example:8443/r", "", None, "gitea"), (2, "https://z/r", " own ", "u", None), (3, "https://github.com/r", None, None, "github"), (4, "https://q/r", None, None, None)], "id long, url string, auth_token string, auth_user string, provider string")
    got = {x["id"]: (x["auth_token"], x["source"]) for x in r.credentials(repos, {"github": "g"}).collect()}
    assert got == {1: ("secret-token", "host h.example:8443"), 2: ("own", "own"), 3: ("g", "stored github"), 4: (None, "none")}
    # without a named provider the host tells it; the user stays unless the host's own credentials are taken
    silent = spark.createDataFrame([(1, "https://gitlab.com/org/repo.git", None, "me", None), (2, "https://gitea.homelab.arpa/o/r.git", " ", " me ", ""), (3, "https://github.com/o/r", None, None, None), (4, "https://h.example:8443/r", None, "me", None), (5, "https://code.example/r", None, "me", None), (6, "https://gitlab.com/r", " own ", " me ", "github")], repos.schema)
    got = {x["id"]: (x["auth_token"], x["auth_user"], x["source"]) for x in r.credentials(silent, {"gitea": " tea ", "github": " "}, {"gitlab": "lab", "github": "hub"}).collect()}
    want = {1: ("lab", "me", "environment gitlab"), 2: ("tea", " me ", "stored gitea"), 3: ("hub", None, "environment github")}
    assert got == want | {4: ("secret-token", "me", "host h.example:8443"), 5: (None, "me", "none"), 6: ("own", "me", "own")}
    r.remove_host("h.example:8443")
    assert r.hosts.read().count() == 0 and r.get("k", "d") == "d" and r.interval() == 15
    r.set_interval(-3)
    assert r.interval() == 0
    inner = []
    assert r.exclusive(lambda: inner.append(r.exclusive(lambda: None))) and inner == [False] and r.exclusive(lambda: None)


def test_backends(spark, tmp_path, monkeypatch):
    registry = Registry(spark, f"file://{tmp_path}/r")
    choice = backends.Backends(spark, registry, backends.Settings(f"file://{tmp_path}/a"))
    store = choice.current()
    assert choice.current() is store and store.healthy()[0] and store.facts().first()["points"] == 0
    rows = spark.createDataFrame([("x", "r", "p1", "red tree", "doc"), ("y", "r", "p2", "blue house", "doc"), ("z", "s", "p3", "red house", "code")], "id string, repo string, path string, content string, doc_type string")
    store.upsert(rows)
    store.upsert(rows.where("id = 'y'"))
    assert store.facts().first()["points"] == 3
    assert [r["path"] for r in store.hits("red tree", 1).collect()] == ["p1"] and store.hits("red", repo="s").first()["path"] == "p3"
    assert {len(r["id"]) for r in store.table.read().collect()} == {36} and store.table.read().where("dense IS NULL OR sparse IS NULL").count() == 0
    store.delete_path("p1")
    store.delete_repo("s")
    assert [r["path"] for r in store.table.read().collect()] == ["p2"]
    built = []
    choice.callbacks.append(lambda: built.append(choice.settings().profile))
    dense = choice.switch(backends.Settings(f"file://{tmp_path}/b", Profile.DENSE))
    assert built == [Profile.DENSE] and choice.current() is dense and dense is not store
    dense.upsert(rows)
    assert {r["id"] for r in dense.table.read().collect()} == {"x", "y", "z"} and dense.hits("red", 3).where("score < 0").count() == 0
    with pytest.raises(ConnectionError):
        choice.switch(backends.Settings("nosuch://h/x"))
    monkeypatch.setenv("STORE_SPARE", f"file://{tmp_path}/c")
    registry.put("store_path", "nosuch://h/x")
    assert choice.current().settings.path == f"file://{tmp_path}/c"


def test_inventory_and_listing(spark):
    entries = spark.createDataFrame([("b", False), ("A", False), (".h", False), ("z", True)], "name string, is_dir boolean")
    assert [r["name"] for r in catalog.listing(entries).collect()] == ["z", "A", "b"]


def test_logs(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(seconds=i), "DEBUG" if i % 2 else "INFO") for i in range(20)]
    kept = feeds.kept_logs(spark.createDataFrame(rows, "seq long, ts timestamp, level string"), 5).collect()
    assert [r["seq"] for r in kept] == [18, 16, 14, 12, 10]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, datetime.datetime(2024, 1, 1, 0, i), json.dumps({"ref": "refs/heads/main", "repository": {"clone_url": f"https://h/o/{i % 3}.git"}})) for i in range(6)], "event_id long, ts timestamp, payload string")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    repos = spark.createDataFrame([(1, "one", "git@h:o/1", "main", True), (2, "two", "https://h/o/2", "main", False), (3, "three", "https://h/o/0", "dev", True)], "id int, name string, url string, branch string, auto_sync boolean")
    synced = []
    feeds.webhook_stream(stream, lambda: repos, lambda i, name: synced.append((i, name)), f"{tmp_path}/ck").awaitTermination(60)
    assert synced == [(1, "one")]
    heads = spark.createDataFrame([(1, "x"), (2, None)], "id long, sha string")
    asked = []
    base = spark.createDataFrame([(1, "w", True), (2, "w", True)], "id long, commit_sha string, auto_sync boolean")
    assert feeds.poll_once(base, heads, asked.append) == (1, 1) and asked == [1]
    assert feeds.poll_once(base, heads, asked.append, lambda: True) == (0, 0)
