"""Queries over the driver's tables that go through the store, the registry, ingestion and search, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, languages, tables, text, urls
from ..functions.batches import spread
from ..operators import changes
from ..operators.catalogue import CODE, DECLARED_SQL, WEBHOOK_SQL, _hybrid_sql, _query, _split_sql, _t, code_files, nations
from ..sources.folders import new_path
from ..sources.store import KeyExists, Table
from ..streaming import feeds
from . import ingest
from .registry import HOSTS, Registry
from .search import HashedEmbedder, Search, predicted, sanitized, weighted


def _folder(spark) -> str:
    return new_path(spark, "plans")


def _table(spark, rows: DataFrame, key: list[str], partition: list[str] | None = None) -> Table:
    t = Table(spark, _folder(spark), rows.schema, key, partition)
    t.upsert(rows)
    return t


# the store


@_query("SELECT count(*) AS rows, sum(p_size)::BIGINT AS size, true AS refused FROM part")
def unique_violation(spark, d):
    """An insert of a taken key is refused and changes nothing; one of new keys adds rows."""
    part = _t(spark, d, "part").select("p_partkey", "p_size")
    t = _table(spark, part.where("p_partkey % 2 = 0"), ["p_partkey"])
    t.insert(part.where("p_partkey % 2 = 1"))
    try:
        t.insert(part.where("p_partkey % 3 = 0"))
        refused = False
    except KeyExists:
        refused = True
    return t.read().agg(F.count("*").alias("rows"), F.sum("p_size").alias("size"), F.lit(refused).alias("refused"))


@_query(f"SELECT repo, filepath, full_symbol, CASE WHEN ext = 'py' THEN 0 ELSE start_line END AS start_line FROM {DECLARED_SQL} WHERE ext <> 'go'")
def symbol_purge(spark, d):
    """The symbols of changed files go, and their new ones come; files without new ones lose theirs."""
    from ..operators import symbols

    key = ["repo", "filepath", "full_symbol", "start_line"]
    found = lambda files: symbols.symbol_rows(symbols.extracted(spread(files, "filepath"))).select(*key)
    files = code_files(spark, d)
    t = _table(spark, found(files), key, ["repo"])
    # names alone tell which files have changed; of those, the ones with new symbols are parsed a second time
    changed = files.where("filepath LIKE '%.py' OR filepath LIKE '%.go'").select("filepath")
    # the names grow with the table, and Spark takes their size from that of the table's files: too low for a broadcast
    t.swap(changed.hint("merge"), found(files.where("filepath LIKE '%.py'")).withColumn("start_line", F.lit(0)))
    return t.read()


@_query("SELECT source AS repo, 'files' AS kind, count(*) AS n FROM documents WHERE source <> 'src1' GROUP BY source UNION ALL SELECT source, 'symbols', count(*) FROM documents WHERE source <> 'src1' AND lang = 'en' GROUP BY source")
def cascade_delete(spark, d):
    """A repository's rows go from every table."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filepath"), F.col("source").alias("repo"), "lang")
    own = {"files": _table(spark, docs.drop("lang"), ["filepath"], ["repo"]), "symbols": _table(spark, docs.where("lang = 'en'").drop("lang"), ["filepath"], ["repo"])}
    out = None
    for kind, t in own.items():
        t.delete_equal("repo", "src1")
        part = t.read().groupBy("repo").agg(F.count("*").alias("n")).select("repo", F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@_query("SELECT vec_id, len(embedding)::INT AS dimension FROM embeddings WHERE vec_id % 2 = 1")
def store_heal(spark, d):
    """A table whose vectors have another dimension is emptied; one whose vectors fit stays."""
    rows = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("dense"))
    width = rows.select(F.size("dense")).first()[0]
    t = _table(spark, rows.where("vec_id % 2 = 0").withColumn("dense", F.slice("dense", 1, width - 1)), ["vec_id"])
    t.heal(width)
    t.upsert(rows.where("vec_id % 2 = 1"))
    t.heal(width)
    return t.read().select("vec_id", F.size("dense").alias("dimension"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def gone_files(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("filepath"))
    return changes.gone_files(orders.where("o_orderkey % 5 <> 0"), orders).select("o_orderkey")


# the registry


#: Hosts of which two have credentials and others tell their provider; a provider that is named goes before the host's.
_URL = "CASE n_nationkey % 6 WHEN 0 THEN 'https://h0.example:8443/o/' WHEN 1 THEN 'https://h1.example:8443/o/' WHEN 2 THEN 'https://gitlab.example/o/' WHEN 3 THEN 'git@Forgejo.example:o/' WHEN 4 THEN 'https://github.com/o/' ELSE 'https://code.example/o/' END || n_name"
_NAMED = "CASE n_nationkey % 4 WHEN 1 THEN 'GitHub' WHEN 2 THEN '' END"
_MEANT = f"coalesce(nullif(lower({_NAMED}), ''), CASE n_nationkey % 6 WHEN 2 THEN 'gitlab' WHEN 3 THEN 'gitea' WHEN 4 THEN 'github' ELSE 'generic' END)"


@_query(f"""SELECT id, CASE s WHEN 'own' THEN 'own' WHEN 'host' THEN 'host' || (id % 6) WHEN 'stored' THEN 'g-' || p WHEN 'environment' THEN 'e-' || p END AS auth_token,
  CASE s WHEN 'own' THEN 'me' WHEN 'host' THEN 'u' || (id % 6) ELSE CASE WHEN id % 5 = 0 THEN ' me ' END END AS auth_user,
  s || CASE s WHEN 'own' THEN '' WHEN 'none' THEN '' WHEN 'host' THEN ' h' || (id % 6) || '.example:8443' ELSE ' ' || p END AS source
FROM (SELECT n_nationkey::BIGINT AS id, {_MEANT} AS p, CASE WHEN n_nationkey % 5 = 0 THEN 'own' WHEN n_nationkey % 6 < 2 THEN 'host' WHEN {_MEANT} IN ('github', 'gitea') THEN 'stored' WHEN {_MEANT} = 'gitlab' THEN 'environment' ELSE 'none' END AS s FROM nation)""")
def host_credentials(spark, d):
    """The credentials of repositories whose providers are named or not, from every source."""
    nation = _t(spark, d, "nation").withColumns({"url": F.expr(_URL), "provider": F.expr(_NAMED)})
    registry = Registry(spark, _folder(spark))
    hosts = nation.where("n_nationkey < 2").select(F.col("n_nationkey").cast("long").alias("id"), F.expr("concat('h', n_nationkey, '.example:8443')").alias("host"), F.expr("concat('u', n_nationkey)").alias("auth_user"), F.expr("concat('host', n_nationkey)").alias("auth_token"))
    registry.hosts.upsert(hosts)
    own = F.col("n_nationkey") % 5 == 0
    repositories = nation.select(F.col("n_nationkey").cast("long").alias("id"), "url", F.when(own, " own ").otherwise(" ").alias("auth_token"), F.when(own, " me ").alias("auth_user"), "provider")
    return registry.credentials(repositories, {"github": "g-github", "gitea": " g-gitea ", "gitlab": "  "}, {"gitlab": "e-gitlab", "github": "e-github"})


@_query("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_nationkey % 2 = 0 AS auto_sync, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey DESC) AS place FROM nation")
def registry_order(spark, d):
    """Repositories, newest first, after a change of some rows."""
    registry = Registry(spark, _folder(spark))
    rows = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(True).alias("auto_sync"), F.timestamp_seconds("n_regionkey").alias("added_at"))
    registry.repositories.upsert(rows)
    registry.repositories.update(F.col("id") % 2 == 1, auto_sync=F.lit(False))
    shown = registry.shown_repositories(_t(spark, d, "documents").select(F.col("source").alias("repo")))
    return shown.select("id", "name", "auto_sync", F.row_number().over(Window.orderBy(F.desc("added_at"), F.desc("id"))).cast("long").alias("place"))


@_query("SELECT 'h' || c_custkey AS host, CASE WHEN length(c_name) > 8 THEN left(c_name, 4) || '...' || right(c_name, 4) ELSE '****' END AS auth_token FROM customer WHERE c_custkey % 10 = 0")
def shown_hosts(spark, d):
    registry = Registry(spark, _folder(spark))
    columns = {f.split()[0] for f in HOSTS.split(", ")}
    rows = _t(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"), F.expr("concat('h', c_custkey)").alias("host"), F.col("c_name").alias("auth_token"))
    registry.hosts.upsert(rows.select(*[c for c in rows.columns if c in columns]))
    return registry.shown_hosts().select("host", "auth_token")


# ingestion


def _files(spark, d) -> DataFrame:
    kind = languages.language(F.col("filepath"))
    return code_files(spark, d).withColumns({"rel_path": F.col("filepath"), "mtime": F.lit(0.0), "language": kind, "doc_type": languages.doc_type(kind)})


_LANGUAGE = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in zip(CODE, ("python", "go", "javascript", "typescript", "rust", "java", "c_sharp", "c", "cpp", "ruby", "php", "text"))) + " END"


@_query(f"""SELECT repo, rel_path, title, category, language, doc_type, symbol, kind, start_line, end_line FROM (
  SELECT repo, filepath AS rel_path, regexp_extract(filepath, '[^/]*$') AS title, {_LANGUAGE} AS category, {_LANGUAGE} AS language, 'code' AS doc_type, full_symbol AS symbol, kind, start_line, end_line FROM {DECLARED_SQL}
  UNION ALL SELECT p_brand, 'src/' || p_partkey || '.txt', p_partkey || '.txt', 'src', NULL, 'doc', NULL, NULL, 1, (p_size % 7 + 1)::INT FROM part WHERE p_partkey % {len(CODE)} = {len(CODE) - 1})""")
def ingested_chunks(spark, d):
    """The chunks of source files and of prose: category, language, kind, symbol or title, and lines."""
    rows = ingest.chunk_rows(ingest.described(ingest.parsed(spread(_files(spark, d), "filepath"))))
    out = rows.select("repo", "rel_path", "title", "category", "language", "doc_type", "symbol", "kind", "start_line", "end_line", "content")
    return out.where(text.not_blank(F.col("content"))).drop("content")


@_query("SELECT p_partkey, p_brand AS repo, CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS extra, p_size::VARCHAR AS start_line, NULL::VARCHAR AS heading FROM part")
def hit_payload(spark, d):
    """What a hit shows: columns as a map, entries of its metadata before them, nulls left out."""
    part = _t(spark, d, "part")
    even = F.when(F.col("p_partkey") % 2 == 0, F.map_from_arrays(F.array(F.lit("title")), F.array(F.lit("own"))))
    third = F.when(F.col("p_partkey") % 3 == 0, F.map_from_arrays(F.array(F.lit("extra")), F.array("p_type")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    given = {"id": F.col("p_partkey").cast("string"), "repo": F.col("p_brand"), "title": F.col("p_name"), "start_line": F.col("p_size").cast("int"), "metadata": F.map_concat(F.coalesce(even, none), F.coalesce(third, none))}
    rows = part.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in ingest.CHUNKS.split(", "))))
    p = lambda k: F.try_element_at("payload", F.lit(k)).alias(k)
    return ingest.payload(rows).select(F.col("id").cast("long").alias("p_partkey"), p("repo"), p("title"), p("extra"), p("start_line"), p("heading"))


# search


class _Vector:
    """An embedder of one known vector."""

    name = "given"

    def __init__(self, vector):
        self.vector, self.dimension = vector, len(vector)

    def embed(self, texts):
        return [self.vector for _ in texts]


@_query(f"SELECT id, round(score, 4) AS score FROM ({_hybrid_sql(6, 60, 1, True, 'doc_id IN (SELECT vec_id FROM embeddings)')}) WHERE query_id = 3")
def search_test_hits(spark, d):
    """Six hits of a text and its vector among chunks that have both, with scores of four digits."""
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"))
    docs = _t(spark, d, "documents").join(vectors, "doc_id").select(F.format_string("%09d", "doc_id").alias("id"), F.col("source").alias("repo"), F.lit("doc").alias("doc_type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("embed_text"), "dense")
    query = _t(spark, d, "benchmark").where("item_id = 3").first()["text"]
    vector = [float(x) for x in vectors.where("doc_id = 3").first()["dense"]]
    hits = Search(weighted(docs), _Vector(vector)).search_test(query, doc_type="all")
    return hits.select(F.col("id").cast("long").alias("id"), "score")


# streams


_SECRET = "hook-secret"


def _streamed(spark, rows: DataFrame, order: str, parts: int, run) -> None:
    """Gives ``rows`` to ``run(stream, checkpoint)`` as files that come in ``parts`` steps, each run from the last one's checkpoint."""
    folder = _folder(spark)
    for k in range(parts):
        rows.where(F.pmod(order, F.lit(parts)) == k).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/checkpoint")


@_query("""SELECT event_id, CASE WHEN m = 4 OR NOT ok THEN NULL ELSE n_nationkey END AS repo_id, CASE WHEN m = 4 OR NOT ok THEN NULL ELSE n_name END AS repo_name,
  CASE WHEN NOT ok THEN 'unauthorized' WHEN m = 4 THEN 'invalid' WHEN n_nationkey % 2 = 0 THEN 'sync_triggered' ELSE 'ignored' END AS status
FROM (SELECT event_id, event_id % 5 AS m, event_id % 7 < 4 AS ok, (user_id % 30)::INT AS k FROM events) LEFT JOIN nation ON ok AND m <> 4 AND m <> 3 AND n_nationkey = k""")
def webhook_results_stream(spark, d):
    """Deliveries as a stream, in two runs from one checkpoint, each delivery twice: what is signed or has the token is judged."""
    events = _t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.encode(F.expr(WEBHOOK_SQL), "utf-8").alias("payload"))
    body = F.col("payload")
    good = ids.hmac_sha256(_SECRET, body)
    kinds = [("x-hub-signature-256", F.concat(F.lit("sha256="), good)), ("x-gitlab-token", F.lit(_SECRET)), ("x-gitea-signature", good), ("x-hub-signature", good), ("x-hub-signature-256", F.lit("sha256=invalid")), ("x-gitlab-token", F.lit("wrong"))]
    headers = F.create_map(F.lit("content-type"), F.lit("application/json"))
    for k, (name, value) in enumerate(kinds):
        headers = F.when(F.col("event_id") % 7 == k, F.create_map(F.lit(name), value)).otherwise(headers)
    events = events.withColumn("headers", headers)
    sink = _folder(spark)
    repositories = nations(spark, d)
    twice = events.unionByName(events)
    _streamed(spark, twice, "event_id", 2, lambda stream, checkpoint: feeds.webhook_results(stream, repositories, sink, checkpoint, _SECRET, "10000 days", spark.sparkContext.defaultParallelism).awaitTermination())
    return spark.read.schema(changes.matched_pushes(changes.pushes(events.withColumn("payload", body.cast("string"))), repositories).schema).parquet(sink)


_RING_SQL = "SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'DEBUG' WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 500"


def _levels(spark, d) -> DataFrame:
    level = F.when(F.col("event_type") == "view", "DEBUG").when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return _t(spark, d, "events").select(F.col("event_id").alias("seq"), "ts", level.alias("level"))


@_query(_RING_SQL)
def log_buffer_stream(spark, d):
    """The newest rows of a stream of logs, kept as state, in three runs from one checkpoint."""
    rows = _levels(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "seq", "level", F.lit("events").alias("logger"), F.col("seq").cast("string").alias("message"), F.lit(None).cast("string").alias("traceback"))
    kept = Table(spark, _folder(spark), feeds.BUFFER, ["salt", "ts", "seq"])
    _streamed(spark, rows, "seq", 3, lambda stream, checkpoint: feeds.keep_log(stream, kept, checkpoint).awaitTermination())
    return feeds.tail(kept.read()).select("seq", "level")


# table functions, models, filters on indexed columns


@_query("WITH RECURSIVE texts AS (SELECT doc_id AS id, 0 AS part, text FROM documents WHERE text <> ''), " + _split_sql("texts") + """
SELECT id AS doc_id, k::INT AS chunk_no, content, first::INT AS start_line, last::INT AS end_line FROM chunks
UNION ALL SELECT doc_id, 0, '', 1, 0 FROM documents WHERE coalesce(text, '') = ''""")
def split_chunks_lateral(spark, d):
    tables.register_tables(spark)
    return spark.sql("SELECT doc_id, c.* FROM {documents}, LATERAL split_chunks(text, 1500, 200) AS c", documents=_t(spark, d, "documents"))


def _hashed():
    return HashedEmbedder(64).embed


@_query("""WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
words AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS word FROM benchmark),
coded AS (SELECT DISTINCT word, regexp_extract_all(hex(encode(word)), '..') AS pairs FROM words),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(pairs, lambda p: (instr('0123456789ABCDEF', p[1]) * 16 + instr('0123456789ABCDEF', p[2]) - 17)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) AS h FROM coded, crc),
sums AS (SELECT item_id, (h % 64)::INT AS place, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM words JOIN hashed USING (word) GROUP BY item_id, h % 64),
sizes AS (SELECT item_id, sqrt(sum(x * x)) AS size FROM sums GROUP BY item_id)
SELECT item_id, place, round(x / size, 4) AS x FROM sums JOIN sizes USING (item_id) WHERE x <> 0""")
def batch_inference(spark, d):
    """Vectors of a model that each worker loads once, by batches; components that are not 0."""
    made = predicted(_t(spark, d, "benchmark").select("item_id", "text"), _hashed, 64, "text")
    return made.select("item_id", F.posexplode("dense").alias("place", "x")).where("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 4))


@_query("SELECT doc_id, source, n_chars FROM documents WHERE source = 'src3' AND lang = 'en' UNION ALL SELECT doc_id, source, n_chars FROM documents WHERE source = 'nowhere'")
def indexed_filter(spark, d):
    """Point filters on columns that a table has Bloom filters and a sorted layout for."""
    rows = _t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    t = Table(spark, _folder(spark), rows.schema, ["doc_id"], indexed=["source", "lang"])
    t.upsert(rows)
    now = t.read()
    return now.where("source = 'src3' AND lang = 'en'").unionByName(now.where("source = 'nowhere'")).select("doc_id", "source", "n_chars")


# smaller parts


@_query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS kind, (p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT AS n FROM part")
def sanitised_upsert(spark, d):
    """Metadata without its null and empty values, as a store keeps it."""
    part = _t(spark, d, "part")
    values = F.array(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit("")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")), F.lit("[]"))
    rows = part.select("p_partkey", F.map_from_arrays(F.array(F.lit("brand"), F.lit("kind"), F.lit("tags")), values).alias("metadata"))
    t = _table(spark, sanitized(rows), ["p_partkey"])
    of = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return t.read().select("p_partkey", of("brand"), of("kind"), F.size("metadata").alias("n"))


@_query("SELECT n_nationkey::BIGINT AS id, '/x/' || n_name AS path FROM nation WHERE n_nationkey <> 3")
def path_delete(spark, d):
    registry = Registry(spark, _folder(spark))
    registry.paths.upsert(_t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("/x/"), "n_name").alias("path"), F.lit(True).alias("enabled")))
    registry.remove_path(3)
    return registry.paths.read().select("id", "path")


@_query("SELECT CASE n_name WHEN (SELECT min(n_name) FROM nation) THEN 'changed' ELSE n_nationkey::VARCHAR END AS value, n_name AS key FROM nation UNION ALL SELECT '7', 'auto_sync_interval'")
def settings_values(spark, d):
    """Values by key, one of which is set anew."""
    nation = _t(spark, d, "nation")
    registry = Registry(spark, _folder(spark))
    registry.settings.upsert(nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")))
    registry.put(nation.agg(F.min("n_name")).first()[0], "changed")
    registry.set_interval(registry.interval() - 8)
    return registry.settings.read().select("key", "value")


@_query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, CASE WHEN page_id % 2 = 0 THEN 6333 END AS port, starts_with(url, 'https') AS secure FROM pages")
def store_url_parts(spark, d):
    """Host, port and security of stores' addresses: those of pages, half of them with a port."""
    url = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", r"^([a-z]+://[^/?#]*)", "$1:6333")).otherwise(F.col("url"))
    return _t(spark, d, "pages").select("page_id", urls.address(url).alias("a")).select("page_id", "a.host", "a.port", "a.secure")


@_query("SELECT 'blank' AS query, 0::BIGINT AS hits UNION ALL SELECT 'words', least(5, count(*)) FROM documents WHERE regexp_matches(lower(text), '[\\p{L}\\p{N}]')")
def blank_query(spark, d):
    """A blank query has no hits, one with words of every text has."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("repo"), F.lit("doc").alias("doc_type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("embed_text"), F.array(F.lit(1.0)).alias("dense"))
    search = Search(docs, _Vector([1.0]))
    own = [search.hits(q).select(F.lit(name).alias("query"), "id") for name, q in (("blank", " \t "), ("words", "the of and"))]
    names = spark.range(1).select(F.explode(F.array(F.lit("blank"), F.lit("words"))).alias("query"))
    return names.join(own[0].unionByName(own[1]).groupBy("query").agg(F.count("*").alias("hits")), "query", "left").select("query", F.coalesce("hits", F.lit(0)).alias("hits"))


# logs and functions


@_query(_RING_SQL)
def log_ring(spark, d):
    return feeds.kept_logs(_levels(spark, d)).select("seq", "level")


@_query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(regexp_extract(url, '^(.*)/[^/]*$', 1), '([^/])/+$', '\\1') AS dir, greatest(0, coalesce(TRY_CAST(regexp_extract(url, '[^/]*$') AS INT), 15))::INT AS minutes, printf('%.4f', page_id / 7.0::DOUBLE) AS score FROM pages")
def path_functions(spark, d):
    base = text.basename(F.col("url"))
    return _t(spark, d, "pages").select("page_id", base.alias("base"), text.dirname(F.col("url")).alias("dir"), text.interval_minutes(base).alias("minutes"), F.format_string("%.4f", F.col("page_id") / 7.0).alias("score"))
