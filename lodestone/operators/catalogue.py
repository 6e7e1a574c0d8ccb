"""All queries by name over the driver's tables, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, languages, text, urls
from ..functions.batches import small_batches, spread
from ..sources.folders import new_path, remove
from ..sources.store import Table
from . import catalog, changes, chunking, filters, keywords, retrieval, symbols
from .blockmax import BlockIndex
from .trigrams import TrigramIndex
from .vector_index import VectorIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


# filters


@_query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3'")
def filter_repo_language(spark, d):
    return _t(spark, d, "documents").where(filters.metadata(lang="en", source="src3", category="")).select("doc_id", "lang", "source", "n_chars")


@_query("SELECT conv_id, turn, role FROM conversations WHERE list_contains(string_split('chat, ' || role, ', '), 'user')")
def filter_tag(spark, d):
    tagged = _t(spark, d, "conversations").withColumn("tags", text.split_tags(F.concat(F.lit("chat, "), "role")))
    return tagged.where(filters.metadata(tag="user")).select("conv_id", "turn", "role")


def _symbols(spark, d):
    return _t(spark, d, "part").select(
        F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("full_symbol"), F.col("p_brand").alias("repo"),
        F.concat(F.lower("p_type"), F.lit(".py")).alias("filepath"), F.col("p_type").alias("kind"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"), F.col("p_partkey").alias("id"),
    )


_SYMBOLS_SQL = """(SELECT p_name AS name, p_brand || '.' || p_name AS full_symbol, p_brand AS repo, lower(p_type) || '.py' AS filepath,
  p_type AS kind, p_size AS start_line, p_size + 5 AS end_line, p_partkey AS id FROM part)"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(f"SELECT id, name, full_symbol FROM {_SYMBOLS_SQL} WHERE name = (SELECT min(p_name) FROM part) OR full_symbol = (SELECT min(p_name) FROM part)")
def symbol_exact(spark, d):
    name = _t(spark, d, "part").agg(F.min("p_name")).first()[0]
    return filters.find_symbol(_symbols(spark, d), name, limit=-1).select("id", "name", "full_symbol")


@_query(f"SELECT id, full_symbol, repo FROM {_SYMBOLS_SQL} WHERE {_LOWER.format('full_symbol')} LIKE '%brand#1_.%' AND repo = 'Brand#13'")
def symbol_fuzzy(spark, d):
    return filters.find_symbol(_symbols(spark, d), "BRAND#1_.", repo="Brand#13", exact=False, limit=-1).select("id", "full_symbol", "repo")


#: Parts of names: with wildcards, in any case, in one column or the other, too short for the index, and in no row.
_PARTS = ("BRAND#1_.", "an", "%al%en", "steel", "#23.", "_", "nowhere", "13")


def _part_of(column: str, part: str) -> str:
    low = part.translate({i: i + 32 for i in range(65, 91)})
    return f"{_LOWER.format(column)} LIKE '%{low}%'"


@_query(" UNION ALL ".join(f"SELECT '{p}' AS part, id, full_symbol FROM {_SYMBOLS_SQL} WHERE {_part_of('name', p)} OR {_part_of('full_symbol', p)}" for p in _PARTS))
def symbol_trigram(spark, d):
    """Symbols by parts of their names, through an index of trigrams."""
    rows = _symbols(spark, d)
    index = TrigramIndex(spark, _indexed(spark, d, "trigrams", rows, lambda p: TrigramIndex.write(rows, p)), ("name", "full_symbol"))
    out = None
    for part in _PARTS:
        found = index.containing(part).select(F.lit(part).alias("part"), "id", "full_symbol")
        out = found if out is None else out.unionByName(found)
    return out


@_query(f"SELECT id, outline, start_line FROM (SELECT *, full_symbol || ' (' || kind || ') lines ' || start_line || '-' || end_line AS outline FROM {_SYMBOLS_SQL}) WHERE filepath LIKE '%mo.py'")
def outline_suffix(spark, d):
    return filters.outline(_symbols(spark, d), "MO.py").select("id", "outline", "start_line")


# counts and inventories


@_query("SELECT source AS repo, count(*) AS file_count FROM documents GROUP BY source")
def files_per_repo(spark, d):
    return catalog.files_per_repo(_t(spark, d, "documents").select(F.col("source").alias("repo")))


@_query("SELECT c_custkey, c_name AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS file_count FROM customer")
def repo_file_counts_correlated(spark, d):
    orders, customers = _t(spark, d, "orders").select("o_custkey"), _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return catalog.with_file_counts(customers, orders, "c_custkey", "o_custkey")


@_query("""SELECT kind, name, location, status, sha, coalesce(n, 0) AS file_count FROM (
  SELECT 'git' AS kind, n_name AS name, 'https://git.example/' || lower(n_name) AS location, 'synced' AS status, substr(sha1(n_name), 1, 8) AS sha FROM nation
  UNION ALL SELECT 'local', r_name, '/' || lower(r_name), CASE WHEN r_regionkey % 2 = 0 THEN 'enabled' ELSE 'disabled' END, NULL FROM region)
LEFT JOIN (SELECT n_name AS repo, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) ON name = repo""")
def repo_inventory(spark, d):
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    git = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("https://git.example/"), F.lower("n_name")).alias("url"), F.lit("synced").alias("status"), F.sha1("n_name").alias("commit_sha"))
    local = region.select(F.col("r_name").alias("repo"), F.concat(F.lit("/"), F.lower("r_name")).alias("path"), (F.col("r_regionkey") % 2 == 0).alias("enabled"))
    files = _t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("repo"))
    return catalog.inventory(git, local, files)


@_query("SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM nation) AS repositories, (SELECT count(*) FROM embeddings) AS points")
def global_stats(spark, d):
    return catalog.counts(files=_t(spark, d, "documents"), symbols=_t(spark, d, "part"), repositories=_t(spark, d, "nation"), points=_t(spark, d, "embeddings"))


@_query("SELECT doc_id, source, lang, greatest(0, (SELECT count(*) FROM documents) - 40) AS more FROM documents ORDER BY source, doc_id LIMIT 40")
def catalog_head(spark, d):
    return catalog.head(_t(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "doc_id"])


@_query("""SELECT 'Search. ' || (SELECT count(*) FROM nation) + (SELECT count(*) FROM region WHERE r_regionkey < 3) || ' sources: '
  || (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 10)) || '. ' || (SELECT count(*) FROM part) || ' symbols in ' || (SELECT count(*) FROM documents) || ' files.' AS text""")
def catalog_description(spark, d):
    repositories = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("synced").alias("status"))
    paths = _t(spark, d, "region").select(F.concat(F.lit("/x/"), "r_name").alias("path"), (F.col("r_regionkey") < 3).alias("enabled"))
    return catalog.description(repositories, paths, _t(spark, d, "part"), _t(spark, d, "documents"), "Search.")


@_query("""SELECT row_number() OVER (ORDER BY is_dir DESC, lower(name), name) AS place, name, is_dir FROM (
  SELECT p_name AS name, min(p_size) > 25 AS is_dir FROM part WHERE p_name NOT LIKE '.%' GROUP BY p_name)""")
def browse_listing(spark, d):
    entries = _t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg((F.min("p_size") > 25).alias("is_dir"))
    from pyspark.sql import Window

    return catalog.listing(entries).withColumn("place", F.row_number().over(Window.orderBy(F.desc("is_dir"), F.lower("name"), "name")).cast("long")).select("place", "name", "is_dir")


# keywords


def _keyword_sql(column: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    return f"""tokens AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower({column}), '{text.KEYWORD_TOKEN}')) AS word, generate_subscripts(regexp_extract_all(lower({column}), '{text.KEYWORD_TOKEN}'), 1) AS pos FROM documents),
counted AS (SELECT id, word, count(*) AS n, min(pos) AS first FROM tokens WHERE length(word) >= 3 AND word NOT IN ({stop}) AND NOT regexp_full_match(word, '[0-9]+') GROUP BY id, word),
ranked AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS rank, word, n FROM counted)"""


@_query(f"WITH {_keyword_sql('text')} SELECT id, rank, word, n FROM ranked WHERE rank <= 25")
def doc_keywords_top25(spark, d):
    return keywords.ranked_keywords(_t(spark, d, "documents").select("doc_id", "text"))


@_query(f"WITH {_keyword_sql('text')} SELECT id, rank, word, n FROM ranked WHERE rank <= 25")
def doc_keywords_by_id(spark, d):
    return keywords.counted_keywords(_t(spark, d, "documents").select("doc_id", "text"))


@_query(f"WITH {_keyword_sql('text')} SELECT id AS doc_id, string_agg(word, ' ' ORDER BY rank) AS words FROM ranked WHERE rank <= 25 GROUP BY id")
def doc_keywords_in_row(spark, d):
    out = keywords.document_keywords(_t(spark, d, "documents").select("doc_id", "text")).where(F.size("keywords") > 0)
    return out.select("doc_id", F.array_join("keywords", " ").alias("words"))


@_query(f"""WITH {_keyword_sql('text')} SELECT word, count(*) AS n FROM ranked WHERE rank <= 25 GROUP BY word ORDER BY count(*) DESC, min(id * 100 + rank) LIMIT 25""")
def keyword_cloud(spark, d):
    docs = keywords.document_keywords(_t(spark, d, "documents").select("doc_id", "text"))
    broken = F.when(F.size("keywords") == 0, F.lit("{not json")).otherwise(F.to_json("keywords"))
    return keywords.keyword_cloud(docs.withColumn("keywords", broken), order="doc_id")


@_query("""SELECT doc_id, list_aggregate(list_sort(list_distinct(list_slice(string_split(text, ' '), 1, 20))), 'string_agg', '|') AS headings FROM documents WHERE text <> ''""")
def headings_distinct20(spark, d):
    words = F.split("text", " ", -1)
    return _t(spark, d, "documents").where("text <> ''").select("doc_id", F.array_join(F.array_sort(keywords.distinct_headings(words)), "|").alias("headings"))


# chunks and symbols


_LINES = r"regexp_extract_all(text, '[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])|[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+$')"


def _split_sql(source: str, most: int = 1500, overlap: int = 200) -> str:
    """Splitting by length in SQL, for a table ``source`` with columns id, part and text; its CTEs end in ``chunks``.

    ``ends`` are the sums of the lines' lengths. A recursion goes from chunk to chunk: one ends before the first line that
    makes it too long, and the next opens with the last whole lines that fit the overlap and takes a line whatever its length.
    """
    return f"""
lined AS (SELECT id, part, length(text) AS size, {_LINES} AS lines FROM {source}),
each AS (SELECT id, part, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM lined),
summed AS (SELECT id, part, n, sum(length(line)) OVER (PARTITION BY id, part ORDER BY n) AS till FROM each),
placed AS (SELECT id, part, size, lines, ends FROM lined JOIN (SELECT id, part, list_prepend(0, list(till::BIGINT ORDER BY n)) AS ends FROM summed GROUP BY id, part) USING (id, part)),
steps AS (
  SELECT id, part, 0 AS k, 1::BIGINT AS first, CASE WHEN size <= {most} THEN len(lines) ELSE least(len(lines), greatest(len(list_filter(ends, lambda x: x <= {most})), 2) - 1) END::BIGINT AS last FROM placed
  UNION ALL
  SELECT id, part, k + 1, opens, least(len(lines), greatest(len(list_filter(ends, lambda x: x <= ends[opens] + {most})), greatest(opens, last + 1) + 1) - 1)::BIGINT
  FROM (SELECT id, part, k, last, lines, ends, greatest(first, len(list_filter(ends, lambda x: x < ends[last + 1] - {overlap})) + 1)::BIGINT AS opens
        FROM steps JOIN placed USING (id, part) WHERE last < len(lines))
),
chunks AS (SELECT id, part, k, first, last, array_to_string(list_slice(lines, first, last), '') AS content FROM steps JOIN placed USING (id, part))"""


@_query("WITH RECURSIVE texts AS (SELECT doc_id AS id, 0 AS part, text FROM documents WHERE text <> ''), " + _split_sql("texts") + """
SELECT id, k::INT AS chunk_no, content, first::INT AS start_line, last::INT AS end_line, NULL::VARCHAR AS heading FROM chunks
UNION ALL SELECT doc_id, 0, '', 1, 0, NULL FROM documents WHERE coalesce(text, '') = ''""")
def split_by_length_chunks(spark, d):
    return chunking.split(_t(spark, d, "documents"))


_SECTIONS_SQL = r"""
pages_ AS (SELECT conv_id AS id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn, role, text) AS page FROM conversations GROUP BY conv_id),
plain AS (SELECT id, string_split(page, chr(10)) AS plain_lines FROM pages_),
rows_ AS (SELECT id, unnest(plain_lines) AS row_, generate_subscripts(plain_lines, 1) AS n FROM plain),
numbered AS (SELECT id, n, row_, regexp_extract(row_, '^#{1,6}[\s\x1c-\x1f\x{85}\x{a0}]+(.+)$', 1) AS head FROM rows_),
marked AS (SELECT id, n, row_, head, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS part FROM numbered),
sections AS (SELECT id, part, min(n) AS top, coalesce(max(trim(head)) FILTER (head <> ''), 'Root') AS heading, string_agg(row_, chr(10) ORDER BY n) AS text FROM marked GROUP BY id, part),
texts AS (SELECT id, part, text FROM sections WHERE text <> '')"""


@_query(f"WITH RECURSIVE {_SECTIONS_SQL}, {_split_sql('texts')}" + r"""
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY part, k) - 1)::INT AS chunk_no, content, (first + top - 1)::INT AS start_line, (last + top - 1)::INT AS end_line, heading
FROM chunks JOIN sections USING (id, part) WHERE regexp_matches(content, '[^\s\x1c-\x1f\x{85}\x{a0}]')""")
def markdown_chunks(spark, d):
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    page = turns.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"])), "\n").alias("text"))
    return chunking.split(page, "conv_id", markdown=True, blank=False)


@_query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 3 THEN p_type END AS category, CASE p_partkey % 4 WHEN 0 THEN p_name || '|' || p_type WHEN 3 THEN p_brand || '|' || p_size END AS tags,
  CASE p_partkey % 4 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '# ' || p_name || chr(10) WHEN 2 THEN '---' || chr(10) || 'category: ' || p_type ELSE p_name END AS body FROM part""")
def frontmatter_extract(spark, d):
    text = F.expr(r"""CASE p_partkey % 4
      WHEN 0 THEN concat('---\ncategory: "', p_brand, '"\ntags: ', p_name, ' , ', p_type, ',\n---\n# ', p_name, '\n')
      WHEN 1 THEN concat('# ', p_name, '\n')
      WHEN 2 THEN concat('---\ncategory: ', p_type)
      ELSE concat('---\ntags: ["', p_brand, '", ', p_size, ']\ncategory: ', p_type, '\n---\n', p_name) END""")
    rows = chunking.headers(_t(spark, d, "part").select("p_partkey", text.alias("text")))
    return rows.select("p_partkey", "category", F.array_join("tags", "|").alias("tags"), "body")


#: Source files by extension, with ``@`` for a number, and what is declared in them: full name, kind, first and last line.
CODE = {
    "py": ("class C@:\n    def m(self):\n        return 1\n\ndef f@():\n    pass\n", [("C@", "class_definition", 1, 3), ("C@.m", "function_definition", 2, 3), ("f@", "function_definition", 5, 6)]),
    "go": ("type T@ struct {\n  x int\n}\n\nfunc (t T@) Get() int {\n  return t.x\n}\n", [("T@", "type_declaration", 1, 3), ("Get", "method_declaration", 5, 7)]),
    "js": ("class J@ {\n  run(x) {\n    return '}';\n  }\n}\nconst g@ = (y) => {\n  return y;\n};\n", [("J@", "class_declaration", 1, 5), ("J@.run", "method_definition", 2, 4), ("g@", "arrow_function", 6, 8)]),
    "ts": ("interface I@ {\n  x: number\n}\nexport class D@ {\n  go(): void {\n  }\n}\n", [("I@", "interface_declaration", 1, 3), ("D@", "class_declaration", 4, 7), ("D@.go", "method_definition", 5, 6)]),
    "rs": ("pub struct S@ {\n  x: i32,\n}\n\nimpl S@ {\n  pub fn get(&self) -> i32 {\n    self.x\n  }\n}\n", [("S@", "struct_item", 1, 3), ("S@", "impl_item", 5, 9), ("S@.get", "function_item", 6, 8)]),
    "java": ("public class A@ {\n  public int get(int q) {\n    if (q > 0) { return q; }\n    return 0;\n  }\n}\n", [("A@", "class_declaration", 1, 6), ("A@.get", "method_declaration", 2, 5)]),
    "cs": ("namespace N {\n  class B@ {\n    public int M(int x) { return x; }\n  }\n}\n", [("B@", "class_declaration", 2, 4), ("B@.M", "method_declaration", 3, 3)]),
    "c": ("/* { */\nstatic int f@(int a) {\n  return a;\n}\n", [("f@", "function_definition", 2, 4)]),
    "cpp": ("class Q@ {\n public:\n  int g() { return 1; }\n};\n", [("Q@", "class_specifier", 1, 4), ("Q@.g", "function_definition", 3, 3)]),
    "rb": ("module M@\n  class K\n    def go\n      if x\n        1\n      end\n    end\n  end\nend\n", [("M@", "module", 1, 9), ("M@.K", "class", 2, 8), ("M@.K.go", "method", 3, 7)]),
    "php": ("<?php\nclass P@ {\n  public function f($x) { return 1; }\n}\n", [("P@", "class_declaration", 2, 4), ("P@.f", "method_declaration", 3, 3)]),
    "txt": ("only prose @\n", []),
}


def code_files(spark, d):
    """(repo, filepath, content): a source file a part, in the languages in turn, after some blank lines."""
    part = _t(spark, d, "part")
    ext, text = F.array(*map(F.lit, CODE)), F.array(*[F.lit(c) for c, _ in CODE.values()])
    kind = (F.col("p_partkey") % len(CODE)).cast("int")
    content = F.concat(F.repeat(F.lit("\n"), (F.col("p_size") % 7).cast("int")), F.replace(F.get(text, kind), F.lit("@"), F.col("p_partkey").cast("string")))
    return part.select(F.col("p_brand").alias("repo"), F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit("."), F.get(ext, kind)).alias("filepath"), content.alias("content"))


DECLARED_SQL = f"""(SELECT p_brand AS repo, 'src/' || p_partkey || '.' || ext AS filepath, ext, replace(name, '@', p_partkey::VARCHAR) AS full_symbol, kind, (first + p_size % 7)::INT AS start_line, (last + p_size % 7)::INT AS end_line
  FROM part JOIN (VALUES {', '.join(f"({i}, '{e}', '{n}', '{k}', {a}, {z})" for i, (e, (_, found)) in enumerate(CODE.items()) for n, k, a, z in found)}) AS v(i, ext, name, kind, first, last) ON p_partkey % {len(CODE)} = i)"""


@_query(f"SELECT repo, filepath, full_symbol, kind, start_line, end_line FROM {DECLARED_SQL}")
def symbol_extract(spark, d):
    return symbols.symbol_rows(symbols.extracted(spread(code_files(spark, d), "filepath"))).select("repo", "filepath", "full_symbol", "kind", "start_line", "end_line")


# retrieval


def _vector(spark, d, i):
    return [float(x) for x in _t(spark, d, "embeddings").where(F.col("vec_id") == i).first()["embedding"]]


_COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})), 6)"


@_query(f"SELECT vec_id, {_COSINE.format(7)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk(spark, d):
    return retrieval.dense_top_k(_t(spark, d, "embeddings"), _vector(spark, d, 7), 10, id_="vec_id").select("vec_id", "score")


@_query(f"SELECT vec_id, label, {_COSINE.format(7)} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk_filtered(spark, d):
    return retrieval.dense_top_k(_t(spark, d, "embeddings"), _vector(spark, d, 7), 10, F.col("label") == 3, id_="vec_id").select("vec_id", "label", "score")


@_query(f"SELECT vec_id, greatest(0.0, c) AS score FROM (SELECT vec_id, {_COSINE.format(11)} AS c FROM embeddings ORDER BY c DESC, vec_id LIMIT 400)")
def dense_clamped(spark, d):
    return retrieval.dense_top_k(_t(spark, d, "embeddings"), _vector(spark, d, 11), 400, id_="vec_id", clamp=True).select("vec_id", "score")


_QUERY_SQL = "queries AS (SELECT item_id AS query_id, b.text, embedding AS vector FROM benchmark b JOIN embeddings e ON item_id = vec_id)"
_TERMS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"
_SPARSE_SQL = f"""dt AS (SELECT doc_id AS id, {_TERMS} AS term FROM documents), dl AS (SELECT id, count(*) AS len FROM dt GROUP BY id),
dw AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM dt JOIN dl USING (id) GROUP BY id, term),
d AS (SELECT id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / 256)) AS w FROM dw),
qt AS (SELECT query_id, {_TERMS} AS term FROM queries), ql AS (SELECT query_id, count(*) AS len FROM qt GROUP BY query_id),
qw AS (SELECT query_id, term, count(*) AS tf, any_value(len) AS len FROM qt JOIN ql USING (query_id) GROUP BY query_id, term),
q AS (SELECT query_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / 256)) AS q FROM qw)"""
_IDF_SQL = "f AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(DISTINCT id) + 0.5::DOUBLE) / (count(DISTINCT id) + 0.5::DOUBLE)) AS idf FROM dt GROUP BY term)"


def _top_sql(source: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({source})) WHERE rank <= {k})"


_SPARSE = "SELECT query_id, id, round(sum(w * q), 6) AS score FROM d JOIN q USING (term) GROUP BY query_id, id"
_DENSE = "SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], vector::DOUBLE[]), 6) AS score FROM embeddings, queries"


def _queries(spark, d):
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return _t(spark, d, "benchmark").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), "text", "vector")


def _docs(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


_INDEXES: dict[tuple, tuple[tuple, str]] = {}


def _indexed(spark, d, name: str, rows: DataFrame, write: Callable[[str], object]) -> str:
    """The path of an index of a table's rows, written when a session first asks for it, and anew when the table's files change."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = sorted(rows.inputFiles())
    fs = at(files[0]).getFileSystem(spark._jsc.hadoopConfiguration()) if files else None
    state = tuple((f, s.getModificationTime(), s.getLen()) for f in files for s in [fs.getFileStatus(at(f))])
    key = (spark.sparkContext.applicationId, d, name)
    known, path = _INDEXES.get(key, (None, None))
    if known != state:
        fresh = new_path(spark, name)
        write(fresh)
        if path:
            remove(spark, path)
        _INDEXES[key] = state, fresh
    return _INDEXES[key][1]


def _postings(spark, d):
    docs = _docs(spark, d)
    path = _indexed(spark, d, "postings", docs, lambda p: retrieval.write_postings(docs, p))
    return spark.read.schema("term string, id long, w double").parquet(path)


def _blocks(spark, d):
    docs = _docs(spark, d)
    return BlockIndex.open(spark, _indexed(spark, d, "blocks", docs, lambda p: BlockIndex.write(docs, p)))


@_query(f"WITH {_QUERY_SQL}, {_SPARSE_SQL} SELECT query_id, id, score, rank FROM {_top_sql(_SPARSE, 5)}")
def bm25_topk(spark, d):
    return _blocks(spark, d).top(_queries(spark, d), 5)


@_query(f"WITH {_QUERY_SQL}, {_SPARSE_SQL} SELECT query_id, id, score, rank FROM {_top_sql(_SPARSE, 5)}")
def bm25_topk_from_postings(spark, d):
    return retrieval.posting_batch(_postings(spark, d), _queries(spark, d), 5)


@_query(f"WITH {_QUERY_SQL}, {_SPARSE_SQL} SELECT query_id, id, score, rank FROM {_top_sql(_SPARSE, 5)}")
def bm25_topk_from_texts(spark, d):
    return retrieval.sparse_batch(_docs(spark, d), _queries(spark, d), 5)


@_query(f"WITH {_QUERY_SQL}, {_SPARSE_SQL}, {_IDF_SQL} SELECT query_id, id, score, rank FROM {_top_sql('SELECT query_id, id, round(sum(w * q * idf), 6) AS score FROM d JOIN q USING (term) JOIN f USING (term) GROUP BY query_id, id', 5)}")
def bm25_topk_idf(spark, d):
    return _blocks(spark, d).top(_queries(spark, d), 5, model=retrieval.BM25(idf=True), rows=_docs(spark, d))


_STOP = ("the", "of", "and", "die", "der", "la", "el", "de")


@_query(f"WITH {_QUERY_SQL}, {_SPARSE_SQL} SELECT query_id, id, score, rank FROM {_top_sql(_SPARSE, 5)}".replace(f"{_TERMS} AS term FROM documents)", f"term FROM (SELECT doc_id, {_TERMS} AS term FROM documents) WHERE term NOT IN {_STOP})").replace(f"{_TERMS} AS term FROM queries)", f"term FROM (SELECT query_id, {_TERMS} AS term FROM queries) WHERE term NOT IN {_STOP})"))
def bm25_topk_without_stop_words(spark, d):
    return retrieval.sparse_batch(_docs(spark, d), _queries(spark, d), 5, model=retrieval.BM25(stop=_STOP))


@_query(f"WITH {_QUERY_SQL}, {_SPARSE_SQL} SELECT id, score FROM ({_SPARSE}) WHERE query_id = 3 ORDER BY score DESC, id LIMIT 10")
def sparse_topk_in_row(spark, d):
    docs = _docs(spark, d).withColumn("sparse", F.map_from_entries(retrieval.sparse_vector(F.col("text"))))
    query = retrieval.query_weights(_queries(spark, d).where("query_id = 3")).select("term", "q").collect()
    return retrieval.sparse_top_k(docs.select("id", "sparse"), [tuple(r) for r in query], 10).select("id", "score")


@_query(f"WITH {_QUERY_SQL} SELECT query_id, id, score, rank FROM {_top_sql(_DENSE, 10)}")
def dense_topk_batch(spark, d):
    return retrieval.dense_batch(_t(spark, d, "embeddings"), _queries(spark, d), 10, "vec_id")


def _lists(spark, d):
    """Vectors in about as many lists as the square root of their number, and the probes that find 19 in 20 on a sample."""
    rows = _t(spark, d, "embeddings")
    lists = max(1, round(rows.count() ** 0.5))
    path = _indexed(spark, d, "vectors", rows, lambda p: VectorIndex.write(rows, p, lists, "vec_id"))
    index = VectorIndex(spark, path)
    return index, index.probes_for(0.95)


@_query()
def dense_topk_ivf(spark, d):
    """The first ten rows of each query in the lists that it probes; ``dense_ivf_recall`` tells how many are the exact ones."""
    index, probes = _lists(spark, d)
    return index.top(_queries(spark, d), 10, probes)


@_query("SELECT count(*) AS queries, true AS recall_ok, true AS scores_ok FROM benchmark JOIN embeddings ON item_id = vec_id")
def dense_ivf_recall(spark, d):
    """Whether at least nine in ten of the exact first ten are found, and whether every score is exact."""
    index, probes = _lists(spark, d)
    queries = _queries(spark, d)
    found, exact = index.top(queries, 10, probes), retrieval.dense_batch(_t(spark, d, "embeddings"), queries, 10, "vec_id")
    both = exact.join(found.select("query_id", "id", F.col("score").alias("own")), ["query_id", "id"], "left")
    recall = both.agg(F.count_if(F.col("own").isNotNull()).alias("hits"), F.count("*").alias("all"), F.coalesce(F.bool_and(F.col("own") == F.col("score")), F.lit(True)).alias("scores_ok"))
    return recall.join(F.broadcast(queries.agg(F.count("*").alias("queries"))), F.lit(True)).select("queries", (F.col("hits") >= 0.9 * F.col("all")).alias("recall_ok"), "scores_ok")


def _hybrid_sql(k: int, rrf: int, base: int, filtered: bool = False, where: str = "TRUE") -> str:
    dense, sparse = _DENSE, _SPARSE
    if filtered:
        dense = f"SELECT * FROM ({_DENSE}) WHERE id IN (SELECT doc_id FROM documents WHERE {where})"
        sparse = f"SELECT * FROM ({_SPARSE}) WHERE id IN (SELECT doc_id FROM documents WHERE {where})"
    fused = f"SELECT query_id, id, round(sum(1.0::DOUBLE / ({rrf} + rank - 1 + {base})), 9) AS score FROM (SELECT query_id, id, rank FROM {_top_sql(dense, 2 * k)} UNION ALL SELECT query_id, id, rank FROM {_top_sql(sparse, 2 * k)}) GROUP BY query_id, id"
    return f"WITH {_QUERY_SQL}, {_SPARSE_SQL} SELECT query_id, id, score, rank FROM {_top_sql(fused, k)}"


def _hybrid(spark, d, queries, k=10, fusion=retrieval.WRITTEN, where=None, posts=False):
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    own = {"posts": _postings(spark, d)} if posts else {"index": _blocks(spark, d)}
    return retrieval.hybrid(_docs(spark, d), vectors, queries, k, fusion, where=where, **own)


@_query(_hybrid_sql(10, 60, 1, True, "lang = 'en'") + " WHERE query_id = 3")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d, _queries(spark, d).where("query_id = 3"), where=filters.metadata(lang="en"))


@_query(_hybrid_sql(10, 60, 1))
def hybrid_rrf_batch(spark, d):
    return _hybrid(spark, d, _queries(spark, d))


@_query(_hybrid_sql(10, 2, 0))
def hybrid_rrf_k2(spark, d):
    return _hybrid(spark, d, _queries(spark, d), fusion=retrieval.ZERO_BASED, posts=True)


@_query(f"WITH {_QUERY_SQL} SELECT query_id, id, score, rank FROM {_top_sql(_DENSE, 10)}")
def hybrid_no_sparse_fallback(spark, d):
    return _hybrid(spark, d, _queries(spark, d).withColumn("text", F.lit(" ?! ")))


# logs


def _logs(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("seq"), "ts", F.upper("event_type").alias("level"), F.col("user_id").cast("string").alias("logger"), F.col("props").alias("message"))


@_query("SELECT event_id AS seq, upper(event_type) AS level, props AS message FROM events WHERE upper(event_type) = 'ERROR' AND (contains(lower(props), '\"k\": 1') OR contains(user_id::VARCHAR, '\"k\": 1')) ORDER BY event_id DESC LIMIT 50")
def log_tail(spark, d):
    return filters.log_tail(filters.logs(_logs(spark, d), "error", ' "K": 1 '), 50).select("seq", "level", "message")


@_query("SELECT event_id AS seq FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY event_id LIMIT 100)")
def log_tail_negative(spark, d):
    return filters.log_tail(_logs(spark, d), -100).select("seq")


@_query("SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click FROM events")
def log_level_counts(spark, d):
    return catalog.level_counts(_logs(spark, d), ["ERROR", "VIEW", "CLICK"])


@_query("SELECT event_id AS seq, event_type AS level FROM events WHERE contains(lower(props || ' ' || event_type || user_id), 'err') ORDER BY ts DESC, event_id DESC LIMIT 500")
def log_search_wide(spark, d):
    rows = filters.logs(_logs(spark, d), "ALL", "ERR", ("message", "logger", "level"), trim=False)
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(500).select("seq", F.lower("level").alias("level"))


# URLs


_GIT = "CASE n_nationkey % 5 WHEN 0 THEN 'git@github.com:o/' || n_name || '.git' WHEN 1 THEN 'https://user:t@gitlab.example:8443/o/' || n_name || '/' WHEN 2 THEN 'http://forgejo.example/' || n_name || '.git' WHEN 3 THEN 'https://bitbucket.org/o/' || n_name ELSE 'git@code.example:' || n_name END"
_NORMAL = "regexp_replace(trim(u), '^git@([^:]+):(.+)$', 'https://\\1/\\2')"
_PROVIDER = "CASE WHEN lower(u) LIKE '%gitlab%' THEN 'gitlab' WHEN lower(u) LIKE '%gitea%' OR lower(u) LIKE '%forgejo%' THEN 'gitea' WHEN lower(u) LIKE '%bitbucket%' THEN 'bitbucket' WHEN lower(u) LIKE '%github%' THEN 'github' ELSE 'generic' END"


def _remotes(spark, d):
    return _t(spark, d, "nation").withColumn("u", F.expr(_GIT)).select("n_nationkey", "u")


@_query(f"SELECT n_nationkey, {_NORMAL} AS normal, {_PROVIDER} AS provider, lower(regexp_extract(regexp_replace(u, '^(git@|https?://)', ''), '^([^/:]*)', 1)) AS host, regexp_replace(u, '(https?://)[^/@]+@', '\\1***') AS safe FROM (SELECT n_nationkey, {_GIT} AS u FROM nation)")
def url_normalize_host_provider(spark, d):
    u = F.col("u")
    return _remotes(spark, d).select("n_nationkey", urls.normalize(u).alias("normal"), urls.provider(u).alias("provider"), urls.host(u).alias("host"), urls.sanitize(u).alias("safe"))


@_query(f"""SELECT n_nationkey, base || CASE provider WHEN 'gitlab' THEN '/-/blob/' WHEN 'gitea' THEN CASE WHEN sha IS NULL THEN '/src/branch/' ELSE '/src/commit/' END WHEN 'bitbucket' THEN '/src/' ELSE '/blob/' END
  || coalesce(sha, 'main') || '/src/a.py' || CASE provider WHEN 'bitbucket' THEN '#lines-' ELSE '#L' END || n_nationkey
  || CASE WHEN n_nationkey % 2 = 0 THEN CASE provider WHEN 'bitbucket' THEN ':' WHEN 'gitlab' THEN '-' ELSE '-L' END || n_nationkey + 9 ELSE '' END AS link
FROM (SELECT n_nationkey, regexp_replace(regexp_replace({_NORMAL}, '/+$', ''), '\\.git$', '') AS base, {_PROVIDER} AS provider, CASE WHEN n_nationkey % 3 > 0 THEN md5(n_nationkey::VARCHAR) END AS sha FROM (SELECT n_nationkey, {_GIT} AS u FROM nation))""")
def permalinks(spark, d):
    k = F.col("n_nationkey")
    sha, last = F.when(k % 3 > 0, F.md5(k.cast("string").cast("binary"))), F.when(k % 2 == 0, k + 9).otherwise(k)
    return _remotes(spark, d).select("n_nationkey", urls.permalink(F.col("u"), sha, F.lit("/src/a.py"), k, last).alias("link"))


@_query("SELECT c_custkey, CASE WHEN length(t) = 0 THEN 'None' WHEN length(t) <= 8 THEN '****' ELSE left(t, 4) || '...' || right(t, 4) END AS masked, regexp_replace(lower(regexp_replace(c_name || ' /x', '[^a-zA-Z0-9_\\-]', '_', 'g')), 'z', 'z') AS slug FROM (SELECT *, left(c_name || c_mktsegment, (c_custkey % 20)::INT) AS t FROM customer)")
def mask_and_slug(spark, d):
    c = _t(spark, d, "customer").withColumn("t", F.expr("left(concat(c_name, c_mktsegment), int(c_custkey % 20))"))
    return c.select("c_custkey", text.mask_token(F.col("t")).alias("masked"), text.slug(F.concat("c_name", F.lit(" /x"))).alias("slug"))


@_query(f"SELECT n_nationkey, CASE provider WHEN 'github' THEN scheme || 'x-access-token:t%20k%2F1@' || rest WHEN 'gitlab' THEN scheme || coalesce(usr, 'oauth2') || ':t%20k%2F1@' || rest WHEN 'bitbucket' THEN scheme || coalesce(usr, 'x-token-auth') || ':t%20k%2F1@' || rest ELSE scheme || coalesce(usr || ':', '') || 't%20k%2F1@' || rest END AS auth FROM (SELECT n_nationkey, {_PROVIDER} AS provider, regexp_extract({_NORMAL}, '^(https?://)', 1) AS scheme, regexp_replace(regexp_replace({_NORMAL}, '^https?://', ''), '^[^@]+@', '') AS rest, CASE WHEN n_nationkey % 2 = 0 THEN 'me' END AS usr FROM (SELECT n_nationkey, {_GIT} AS u FROM nation))")
def authenticated_urls(spark, d):
    user = F.when(F.col("n_nationkey") % 2 == 0, F.lit("me"))
    return _remotes(spark, d).select("n_nationkey", urls.authenticated(F.col("u"), F.lit(" t k/1 "), user).alias("auth"))


_FILE = "regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/$', '')"
_LANG = "CASE page_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.hpp' WHEN 3 THEN '.md' WHEN 4 THEN '.cs' WHEN 5 THEN '.yml' WHEN 6 THEN '.zz' ELSE '.html' END"


@_query(f"""SELECT page_id, lang AS language, CASE WHEN lang IN ('markdown', 'text', 'json', 'yaml', 'toml') THEN 'doc' ELSE 'code' END AS doc_type, page_id % 8 NOT IN (1, 2, 6) AS is_read FROM (
  SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'tsx' WHEN 2 THEN 'cpp' WHEN 3 THEN 'markdown' WHEN 4 THEN 'c_sharp' WHEN 5 THEN 'yaml' WHEN 6 THEN 'text' ELSE 'html' END AS lang FROM pages)""")
def language_detect(spark, d):
    path = F.expr(f"concat({_FILE}, '/f', {_LANG})")
    lang = languages.language(path)
    return _t(spark, d, "pages").select("page_id", lang.alias("language"), languages.doc_type(lang).alias("doc_type"), languages.is_read(path).alias("is_read"))


# ids and signatures


@_query(f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT doc_id, sha1(from_hex('{ids.NAMESPACE.hex}') || encode(source || ':' || lang || '/' || doc_id || '.md#0')) AS h FROM documents)""")
def chunk_uuid5(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", ids.chunk_id(F.col("source"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")), F.lit(0)).alias("id"))


_PADS = [bytes(b ^ x for b in b"secret".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@_query(f"SELECT event_id, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(props)))) AS signature, event_id % 2 = 0 AS valid FROM events")
def hmac_verify(spark, d):
    own = ids.hmac_sha256("secret", F.col("props"))
    header = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sha256="), own)).otherwise(F.concat(F.lit("sha256=0"), own))
    return _t(spark, d, "events").select("event_id", own.alias("signature"), ids.signature_valid("secret", F.col("props"), header).alias("valid"))


# changes and the store


@_query("SELECT o_orderkey AS filepath, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0.001 END AS mtime FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 = 0")
def change_detect_mtime(spark, d):
    orders = _t(spark, d, "orders")
    known = orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("filepath"), F.col("o_totalprice").alias("mtime"))
    found = orders.select(F.col("o_orderkey").alias("filepath"), F.expr("o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1D ELSE 0.001D END").alias("mtime"))
    return changes.changed_files(found, known)


_HEADS = "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'new' ELSE c_name END"


@_query(f"SELECT c_custkey AS id, c_name AS commit_sha FROM customer WHERE {_HEADS} IS NULL OR {_HEADS} <> c_name")
def change_detect_sha(spark, d):
    return changes.stale_repositories(*_repositories(spark, d)).select("id", "commit_sha")


def _repositories(spark, d):
    customer = _t(spark, d, "customer")
    return customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("commit_sha"), (F.col("c_nationkey") > 3).alias("auto_sync")), customer.select(F.col("c_custkey").alias("id"), F.expr(_HEADS).alias("sha"))


@_query(f"SELECT count({_HEADS}) AS checked, count(*) FILTER ({_HEADS} <> c_name) AS updated FROM customer WHERE c_nationkey > 3")
def poll_counts(spark, d):
    return changes.poll(*_repositories(spark, d))


def _table(spark, rows: DataFrame, key: list[str], partition: list[str] | None = None) -> Table:
    t = Table(spark, new_path(spark, "table"), rows.schema, key, partition)
    t.upsert(rows)
    return t


@_query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1 - o_orderkey, 'X', 0 FROM orders WHERE o_orderkey % 4 = 0")
def upsert_replace(spark, d):
    t = _table(spark, _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"])
    some = t.read().where("o_orderkey % 4 = 0").withColumn("o_totalprice", F.lit(0.0))
    t.upsert(some.unionByName(some.select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), "o_totalprice")))
    return t.read()


@_query("SELECT doc_id, source, lang FROM documents WHERE source <> 'src1' OR source IS NULL")
def delete_by_repo(spark, d):
    t = _table(spark, _t(spark, d, "documents").select("doc_id", "source", "lang"), ["doc_id"], ["source"])
    t.delete_equal("source", "src1")
    return t.read()


@_query("SELECT page_id, url FROM pages WHERE page_id <> 7")
def delete_by_path(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "url")
    t = _table(spark, pages, ["page_id"])
    t.swap(pages.where("page_id = 7").select("url"))
    return t.read()


@_query("SELECT doc_id, source, lang FROM documents WHERE source <> 'src2' UNION ALL SELECT doc_id + 1000000000, 'src2', 'xx' FROM documents WHERE source = 'src2' AND lang = 'en'")
def replace_repo(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    t = _table(spark, docs, ["doc_id"])
    new = docs.where("source = 'src2' AND lang = 'en'").select((F.col("doc_id") + 1000000000).alias("doc_id"), "source", F.lit("xx").alias("lang"))
    t.replace("source", "src2", new)
    return t.read()


#: A delivery's body, in the forms of several hosts.
WEBHOOK_SQL = """CASE event_id % 5
  WHEN 0 THEN concat('{"ref": "refs/heads/main", "repository": {"clone_url": "git@h.example:o/', user_id % 30, '.git"}}')
  WHEN 1 THEN concat('{"push": {"changes": [{"new": {"name": "main"}}]}, "repository": {"links": {"html": {"href": "https://h.example/o/', user_id % 30, '/"}}}}')
  WHEN 2 THEN concat('{"project": {"git_http_url": "", "git_ssh_url": "git@h.example:o/', user_id % 30, '.git"}}')
  WHEN 3 THEN concat('{"ref": "refs/heads/dev", "repository": {"html_url": "https://h.example/o/', user_id % 30, '"}}')
  ELSE '{"ref": "refs/heads/main"}' END"""


def nations(spark, d) -> DataFrame:
    """Nations as registered repositories, half of them synced automatically."""
    return _t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("https://h.example/o/"), F.col("n_nationkey").cast("string"), F.lit(".git")).alias("url"), F.lit("main").alias("branch"), (F.col("n_nationkey") % 2 == 0).alias("auto_sync"))


@_query("""SELECT event_id, CASE WHEN m = 4 THEN NULL ELSE n_nationkey END AS repo_id, CASE WHEN m = 4 THEN NULL ELSE n_name END AS repo_name,
  CASE WHEN m = 4 THEN 'invalid' WHEN n_nationkey % 2 = 0 THEN 'sync_triggered' ELSE 'ignored' END AS status
FROM (SELECT event_id, event_id % 5 AS m, (user_id % 30)::INT AS k FROM events) LEFT JOIN nation ON m <> 4 AND m <> 3 AND n_nationkey = k""")
def webhook_match(spark, d):
    events = _t(spark, d, "events").select("event_id", F.expr(WEBHOOK_SQL).alias("payload"))
    return changes.matched_pushes(changes.pushes(events), nations(spark, d))
