"""Streams, sources, table functions, models and leases."""

import datetime
import hashlib
import hmac
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ids, tables
from lodestone.operators import changes, chunking
from lodestone.plans import search
from lodestone.plans.ingest import Index
from lodestone.plans.registry import Registry
from lodestone.sources import changed
from lodestone.sources.lease import Lease
from lodestone.sources.store import Table
from lodestone.streaming import feeds

T = datetime.datetime(2024, 1, 1)


# --- webhooks


def _signed(secret, body):
    return hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def test_deliveries_are_verified(spark):
    secret, body = "super-secret-ké", json.dumps({"ref": "refs/heads/main", "n": "é"}, ensure_ascii=False).encode()
    good = _signed(secret, body)
    cases = [
        ({"x-hub-signature-256": f"sha256={good}"}, True), ({"x-hub-signature-256": good}, True), ({"x-hub-signature": f"sha1={good}"}, True), ({"x-hub-signature-256": "sha256=invalid"}, False),
        ({"x-hub-signature-256": ""}, False), ({"x-gitlab-token": f" {secret} "}, True), ({"x-gitlab-token": "wrong"}, False), ({"x-gitea-signature": good}, True), ({"x-gitea-signature-256": f"sha256={good}"}, True),
        ({"x-gitea-signature": "invalid_sig"}, False), ({"x-github-event": "push"}, False), ({}, False), (None, False),
        ({"x-hub-signature-256": "sha256=bad", "x-gitlab-token": secret}, False),  # the first kind decides
    ]
    df = spark.createDataFrame([(k, bytearray(body), h) for k, (h, _) in enumerate(cases)], "k int, body binary, headers map<string,string>")
    got = {r["k"]: r["ok"] for r in df.select("k", ids.delivery_valid(secret, F.col("body"), F.col("headers")).alias("ok")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    for none in (None, "", "  "):
        assert df.where(ids.delivery_valid(none, F.col("body"), F.col("headers"))).count() == len(cases)


REPOS = [
    (1, "test-repo", "https://github.com/example/test-repo.git", "main", True), (2, "test-gitlab", "git@gitlab.com:example/test-gitlab.git", "main", None), (3, "test-bitbucket", "https://bitbucket.org/example/test-bitbucket/", "main", True),
    (4, "disabled-repo", "https://github.com/example/disabled-repo", "main", False), (5, "second", "https://github.com/example/test-repo", "dev", True), (6, "no-branch", "https://h/none", None, True), (7, "late", "https://github.com/example/test-repo", "main", True),
]


def _registered(spark):
    return spark.createDataFrame(REPOS, "id int, name string, url string, branch string, auto_sync boolean")


def test_pushes_meet_their_first_repository(spark, tmp_path):
    of = lambda url, ref=None: json.dumps({"repository": {"clone_url": url}} | ({"ref": ref} if ref is not None else {}))
    bodies = [
        (of("https://github.com/example/test-repo.git", "refs/heads/main"), ("test-repo", "sync_triggered")), (of("git@github.com:example/test-repo.git", "refs/heads/dev"), ("second", "sync_triggered")),
        (of("https://github.com/example/test-repo"), ("test-repo", "sync_triggered")), (of("https://github.com/example/test-repo", ""), ("test-repo", "sync_triggered")), (of("https://github.com/example/test-repo", "refs/heads/x"), (None, "ignored")),
        (json.dumps({"ref": "refs/heads/main", "project": {"git_http_url": "https://gitlab.com/example/test-gitlab.git"}}), ("test-gitlab", "sync_triggered")),
        (json.dumps({"push": {"changes": [{"new": {"name": "main"}}]}, "repository": {"links": {"html": {"href": "https://bitbucket.org/example/test-bitbucket"}}}}), ("test-bitbucket", "sync_triggered")),
        (of("https://github.com/example/disabled-repo.git", "refs/heads/main"), ("disabled-repo", "ignored")), (of("https://h/none", "refs/heads/main"), (None, "ignored")), (of("https://h/none"), ("no-branch", "sync_triggered")),
        (of("https://elsewhere/x", "refs/heads/main"), (None, "ignored")), ("[1]", (None, "invalid")), ("not json", (None, "invalid")), ("", (None, "invalid")), (None, (None, "invalid")),
    ]
    events = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(bodies)], "event_id int, payload string")
    got = {r["event_id"]: (r["repo_name"], r["status"]) for r in changes.matched_pushes(changes.pushes(events), _registered(spark)).collect()}
    assert got == {k: want for k, (_, want) in enumerate(bodies)}
    _registered(spark).write.parquet(f"{tmp_path}/r")
    plan = changes.matched_pushes(changes.pushes(events), spark.read.parquet(f"{tmp_path}/r"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan


def _deliveries(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, payload binary, headers map<string,string>")


def test_webhook_stream_ignores_forged_and_repeated_deliveries(spark, tmp_path):
    secret = "s3"
    body = json.dumps({"ref": "refs/heads/main", "repository": {"clone_url": "https://github.com/example/test-repo.git"}}).encode()
    good, bad = {"x-hub-signature-256": "sha256=" + _signed(secret, body)}, {"x-hub-signature-256": "sha256=00"}
    first = [(1, T, bytearray(body), bad), (2, T, bytearray(body), bad), (2, T, bytearray(body), good), (2, T, bytearray(body), good)]
    second = [(1, T, bytearray(body), good), (2, T, bytearray(body), good), (3, T, bytearray(body), None)]
    synced, schema = [], _deliveries(spark, []).schema
    for rows in (first, second):
        _deliveries(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        feeds.webhook_results(stream(), _registered(spark), f"{tmp_path}/out", f"{tmp_path}/c1", secret).awaitTermination()
        feeds.webhook_stream(stream(), lambda: _registered(spark), lambda i, n: synced.append((i, n)), f"{tmp_path}/c2", secret=secret).awaitTermination()
    out = sorted((r["event_id"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # a forged delivery neither starts a sync nor uses up the id of the true one, which came in the second run
    assert out == [(1, "sync_triggered"), (1, "unauthorized"), (2, "sync_triggered"), (2, "unauthorized"), (3, "unauthorized")]
    assert synced == [(1, "test-repo"), (1, "test-repo")]


# --- the log buffer


def test_log_buffer_evicts_clears_and_restarts(spark, tmp_path):
    first = [(T + datetime.timedelta(minutes=i), "DEBUG" if i == 39 else "INFO", f"l{i % 4}", f"m{i}", None) for i in range(40)]
    second = [(T + datetime.timedelta(minutes=100 + i), "ERROR", "a", f"n{i}", "trace") for i in range(3)] + [(T + datetime.timedelta(minutes=50), feeds.CLEAR, None, None, None)]
    third = [(T + datetime.timedelta(minutes=45), "INFO", "late", "before the clearing", None), (T + datetime.timedelta(minutes=99), "INFO", None, "after it", None)]
    kept = Table(spark, f"file://{tmp_path}/kept", feeds.BUFFER, ["salt", "ts", "seq"])
    for rows, want in ((first, ["m38", "m37", "m36", "m35", "m34"]), (second, ["n2", "n1", "n0"]), (third, ["n2", "n1", "n0", "after it"])):
        spark.createDataFrame(rows, feeds.LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/logs")
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        feeds.keep_log(spark.readStream.schema(feeds.LOG).parquet(f"{tmp_path}/logs"), kept, f"{tmp_path}/check", 5, salts=3).awaitTermination()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
        got = feeds.tail(kept.read(), 5).collect()
        assert [r["message"] for r in got] == want
        assert kept.read().groupBy("salt").count().where("count > 5").count() == 0
    assert got[0]["ts"] == T + datetime.timedelta(minutes=102) and got[0]["traceback"] == "trace" and got[3]["logger"] is None


# --- the source of changed files


def test_changed_files_arrive_once(spark, tmp_path):
    tree, out = tmp_path / "tree", f"{tmp_path}/out"
    (tree / "sub").mkdir(parents=True)
    past = time.time() - 1000

    def put(name, text, at):
        (tree / name).write_text(text)
        os.utime(tree / name, (past + at, past + at))

    name = changed.register(spark)

    def run():
        stream = spark.readStream.format(name).option("path", str(tree)).option("suffixes", ".py,.md").option("group", "2").load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(out).awaitTermination()
        return sorted((os.path.relpath(r["path"], tree), bytes(r["content"]).decode()) for r in spark.read.schema(changed.SCHEMA).parquet(out).collect())

    put("a.py", "1", 0), put("sub/b.md", "2", 0), put("c.txt", "no", 0), put("d.py", "3", 5), put("e.py", "", 5)
    assert run() == [("a.py", "1"), ("d.py", "3"), ("e.py", ""), ("sub/b.md", "2")]
    assert len(run()) == 4  # nothing changed
    put("a.py", "new", 9), put("f.py", "4", 9)
    (tree / "e.py").unlink()
    (tree / "g.py").write_text("still being written")  # within the time to settle
    os.utime(tree / "g.py", (time.time() + 60, time.time() + 60))
    assert run() == [("a.py", "1"), ("a.py", "new"), ("d.py", "3"), ("e.py", ""), ("f.py", "4"), ("sub/b.md", "2")]
    # a batch read gives the tree as it is, and what changed against a table is the batch operator's answer
    batch = spark.read.format(name).option("path", str(tree)).load()
    assert batch.count() == 6
    known = batch.select(F.col("path").alias("filepath"), "mtime").where("path NOT LIKE '%d.py'")
    assert [os.path.basename(r["filepath"]) for r in changes.changed_files(batch.select(F.col("path").alias("filepath"), "mtime"), known).collect()] == ["d.py"]


# --- table functions


def test_table_functions(spark):
    assert tables.register_tables(spark) == ["split_chunks", "split_markdown"]
    text = "# A\n" + "word " * 30 + "\n## B\nx\n"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = spark.sql("SELECT id, c.* FROM {rows}, LATERAL split_markdown(text, 60, 10) c ORDER BY id, chunk_no", rows=rows).collect()
    assert [tuple(r)[2:] for r in got if r["id"] == 1] == chunking.by_heading(text, 60, 10)
    got = spark.sql("SELECT id, c.* FROM {rows}, LATERAL split_chunks(text) c ORDER BY id, chunk_no", rows=rows).collect()
    assert [(r["id"], r["content"]) for r in got] == [(1, text), (2, ""), (3, "")]
    for call in ("split_chunks(id)", "split_chunks(text, 0)", "split_chunks(text, 10, -1)", "split_chunks(text, id)", "split_chunks(text, 'x')"):
        with pytest.raises(Exception, match="type|constant|most is|overlap is"):
            spark.sql(f"SELECT * FROM {{rows}}, LATERAL {call}", rows=rows).collect()


# --- models


def test_models_load_once_a_worker_and_failures_cost_one_row(spark, tmp_path):
    log = f"{tmp_path}/loads"

    def make():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(texts):
            assert sum(map(len, texts)) <= 40 or len(texts) == 1
            if any("poison" in t for t in texts):
                raise RuntimeError("no vector")
            return [[1.0] if "short" in t else [float("nan"), 1.0] if "nan" in t else [len(t), 1.0] for t in texts]

        return model

    words = ["a", "bb", None, "", "poison", "short", "nan", "c" * 100] * 20
    rows = spark.createDataFrame(list(enumerate(words)), "id int, embed_text string").repartition(6)
    got = {r["id"]: r["dense"] for r in search.predicted(rows, make, 2, rows=7, characters=40).collect()}
    assert len(got) == len(words)
    for i, w in enumerate(words):
        assert got[i] == (None if w in ("poison", "short", "nan") else [float(len(w or "")), 1.0])
    loads = open(log).read().split()
    assert loads and len(loads) == len(set(loads))
    assert search.predicted(rows.limit(0), make, 2).count() == 0


# --- leases


def test_one_holder_at_a_time(spark, tmp_path):
    lease, other = (Lease(spark, f"file://{tmp_path}/lease", 60) for _ in range(2))
    first = lease.acquire()
    assert first == 1 and other.acquire() is None and lease.valid(1) and lease.renew(1)
    lease.release(1)
    second = other.acquire()
    assert second == 2 and not lease.valid(1) and not lease.renew(1)
    lease.release(1)  # a former holder lets go of nothing
    assert other.valid(2) and lease.acquire() is None


def test_a_dead_holder_is_succeeded(spark, tmp_path):
    lease, other = (Lease(spark, f"file://{tmp_path}/lease", 60) for _ in range(2))
    first = lease.acquire()
    file = tmp_path / "lease" / str(first)
    os.utime(file, (time.time() - 61,) * 2)
    second = other.acquire()
    assert second == 2 and not lease.valid(first) and lease.acquire() is None
    os.utime(tmp_path / "lease" / "2", (time.time() - 61,) * 2)
    assert other.renew(2) and lease.acquire() is None  # renewed in time


def test_of_many_one_wins(spark, tmp_path):
    got, ready = [], threading.Barrier(6)

    def run():
        own = Lease(spark, f"file://{tmp_path}/lease", 60)
        ready.wait()
        got.append(own.acquire())

    threads = [threading.Thread(target=run) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(t for t in got if t) == [1]


def test_registries_of_two_processes_exclude_each_other(spark, tmp_path):
    a, b = (Registry(spark, f"file://{tmp_path}/r") for _ in range(2))
    ran = []
    assert a.exclusive(lambda: ran.append(b.exclusive(lambda: ran.append("b")))) and ran == [False]
    with pytest.raises(ValueError):
        a.exclusive(lambda: (_ for _ in ()).throw(ValueError()))
    assert b.exclusive(lambda: ran.append("b")) and ran == [False, "b"]


# --- a sync that dies


@pytest.mark.parametrize("step", ["chunks", "symbols", "summaries", "files"])
def test_a_sync_that_dies_is_made_whole_by_the_next(spark, tmp_path, monkeypatch, step):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def one():\n    return 1\n")
    index, registry = Index(spark, f"file://{tmp_path}/i"), Registry(spark, f"file://{tmp_path}/r")
    own = registry.add_repository("lib", "https://github.com/o/lib")
    status = lambda: registry.repositories.read().where(F.col("id") == own).first()
    index.sync_clone("lib", str(tree), "old", registry=registry)
    assert index.synced_sha("lib") == "old" and (status()["status"], status()["commit_sha"]) == ("synced", "old")
    (tree / "a.py").write_text("def two():\n    return 2\n")
    table = getattr(index, step)
    with monkeypatch.context() as m:
        m.setattr(table, "replace", lambda *given: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            index.sync_clone("lib", str(tree), "new", registry=registry)
    assert index.synced_sha("lib") is None and (status()["status"], status()["last_error"], status()["commit_sha"]) == ("error", "gone", "old")
    index.sync_clone("lib", str(tree), "new", registry=registry)
    assert index.synced_sha("lib") == "new" and status()["commit_sha"] == "new"
    assert [r["name"] for r in index.symbols.read().collect()] == ["two"] and index.chunks.read().where("content LIKE '%one%'").count() == 0
