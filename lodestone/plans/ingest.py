"""Ingestion: files to chunks, symbols and summaries, as one job, and their keyed tables."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import NAMESPACE, chunk_id
from ..functions.text import basename, dirname, strip
from ..functions.urls import permalink
from ..operators.changes import changed_files, gone_files
from ..operators.chunking import by_heading, front_matter, header_tags
from ..operators.keywords import distinct_headings, document_keywords, keyword_source
from ..operators.retrieval import BM25
from ..operators.symbols import extract
from ..sources.files import scan, texts
from ..sources.store import Table
from .search import weighted

CHUNKS = (
    "id string, repo string, doc_type string, path string, rel_path string, title string, folder string, category string, "
    "tags array<string>, heading string, symbol string, language string, start_line int, end_line int, permalink_url string, "
    "content string, embed_text string, kind string, metadata map<string,string>, dense array<float>, sparse map<string,double>"
)
FILES = "filepath string, repo string, doc_type string, language string, commit_sha string, mtime double"
SUMMARIES = "filepath string, repo string, title string, folder string, category string, tags string, headings string, keywords string, mtime double"
SYMBOLS = "repo string, filepath string, name string, full_symbol string, kind string, start_line int, end_line int, signature string, language string"


def parsed(files: DataFrame, most: int = 1500, overlap: int = 200) -> DataFrame:
    """``files`` (with content) and, a row a file: body, category, tags, symbols (JSON) and chunks that are not blank.

    Prose has front matter (``.md`` and ``.txt``), whose category and tags count, and chunks by heading; code has symbols.
    """

    def rows(batches):
        struct = pa.struct([("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("heading", pa.string()), ("symbol", pa.string()), ("kind", pa.string())])
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for path, kind, text in zip(*(batch.column(c).to_pylist() for c in ("filepath", "doc_type", "content"))):
                text, head, symbols = text or "", {}, []
                if kind == "doc":
                    if path.endswith((".md", ".txt")):
                        head, text = front_matter(text)
                    chunks = [{"content": c, "start_line": a, "end_line": z, "heading": h, "symbol": None, "kind": None} for c, a, z, h in by_heading(text, most, overlap)]
                else:
                    symbols, chunks = extract(text, path, most)
                    chunks = [c | {"heading": None} for c in chunks]
                chunks = [c for c in chunks if c["content"].strip()]
                category = head.get("category")
                for column, x in zip(out, (text, None if category is None else str(category), header_tags(head) or [], json.dumps(symbols), chunks)):
                    column.append(x)
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(struct))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*batch.schema.names, "body", "own_category", "tags", "symbols_json", "chunks"])

    more = StructType.fromDDL("body string, own_category string, tags array<string>, symbols_json string, chunks array<struct<content:string,start_line:int,end_line:int,heading:string,symbol:string,kind:string>>")
    out = StructType([*files.schema.fields, *more.fields])
    return files.mapInArrow(rows, out)


_SYMBOL_JSON = "array<struct<name:string,full_symbol:string,kind:string,start_line:int,end_line:int,signature:string,language:string>>"


def described(files: DataFrame) -> DataFrame:
    """``parsed`` files with title, folder, category, headings and keywords."""
    folder = dirname(F.col("rel_path"))
    top = F.when(folder == "", F.lit("root")).otherwise(folder)
    symbols = F.from_json("symbols_json", _SYMBOL_JSON)
    is_doc = F.col("doc_type") == "doc"
    named = F.filter(F.transform("chunks", lambda c: c["heading"]), lambda h: h.isNotNull() & (h != "Root"))
    df = files.withColumns({"title": basename(F.col("rel_path")), "folder": folder, "category": F.coalesce("own_category", top), "symbols": symbols})
    df = df.withColumn("headings", F.when(is_doc, named).otherwise(F.transform("symbols", lambda s: s["name"])))
    tags = F.when(is_doc, F.col("tags")).otherwise(F.array("language"))
    return document_keywords(df.withColumn("_k", keyword_source(F.col("title"), F.col("headings"), tags, F.col("body"))), "_k").drop("_k")


def chunk_rows(files: DataFrame, url: Column | None = None, sha: Column | None = None, provider: Column | None = None, namespace: uuid.UUID = NAMESPACE) -> DataFrame:
    """The rows of the table of chunks, without vectors: the text to embed has a header that the stored content lacks."""
    url, sha = F.lit(None).cast("string") if url is None else url, F.lit(None).cast("string") if sha is None else sha
    each = files.select("*", F.posexplode("chunks").alias("n", "c"))
    is_doc = F.col("doc_type") == "doc"
    content = strip(F.col("c.content"))
    symbol = F.when(~is_doc, F.coalesce("c.symbol", "title"))
    # fixed values: the names and the order of the header's lines, which vectors of equal texts depend on
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n"))
    prose = F.concat(line("Repo", F.col("repo")), line("Document", F.col("rel_path")), line("Category", F.col("category")), line("Heading", F.col("c.heading")), F.lit("Content:\n"), content)
    lines = F.format_string("%d-%d", "c.start_line", "c.end_line")
    code = F.concat(line("Repo", F.col("repo")), line("File", F.col("rel_path")), line("Language", F.col("language")), line("Symbol", symbol), line("Lines", lines), F.lit("Code:\n"), content)
    return each.select(
        chunk_id(F.col("repo"), F.col("rel_path"), F.col("n"), namespace).alias("id"), "repo", "doc_type", F.col("filepath").alias("path"), "rel_path", "title", "folder",
        F.when(is_doc, F.col("category")).otherwise(F.col("language")).alias("category"), F.when(is_doc, F.col("tags")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.col("c.heading").alias("heading"), symbol.alias("symbol"), F.when(~is_doc, F.col("language")).alias("language"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"),
        permalink(url, sha, F.col("rel_path"), F.col("c.start_line"), F.col("c.end_line"), provider).alias("permalink_url"), content.alias("content"),
        F.when(is_doc, prose).otherwise(code).alias("embed_text"), F.when(~is_doc, F.coalesce("c.kind", F.lit("code"))).alias("kind"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def payload(chunks: DataFrame) -> DataFrame:
    """(id, payload): what a hit shows, as a map; entries of ``metadata`` override the others. Null values are left out."""
    names = ["repo", "path", "rel_path", "title", "folder", "category", "doc_type", "language", "heading", "symbol", "start_line", "end_line", "permalink_url", "content", "kind"]
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names], F.struct(F.lit("tags").alias("key"), F.to_json("tags").alias("value")))
    own = F.coalesce(F.col("metadata"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    standard = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.array_contains(F.map_keys(own), e["key"]))
    return chunks.select("id", F.map_concat(F.map_from_entries(standard), own).alias("payload"))


def summary_rows(files: DataFrame) -> DataFrame:
    return files.select("filepath", "repo", "title", "folder", "category", F.to_json("tags").alias("tags"), F.to_json(distinct_headings(F.col("headings"))).alias("headings"), F.to_json("keywords").alias("keywords"), "mtime")


class Index:
    """The tables of an index in a folder, and the two ways in which files get into it."""

    def __init__(self, spark: SparkSession, path: str, namespace: uuid.UUID = NAMESPACE, embed=None, model: BM25 = BM25()):
        """``embed``: a function from a DataFrame with embed_text to the same with a column dense, or None. ``model``: of the sparse weights."""
        self.spark, self.namespace, self.embed, self.model = spark, namespace, embed, model
        self.chunks = Table(spark, f"{path}/chunks", CHUNKS, ["id"], ["repo"], indexed=["doc_type", "language", "path"])
        self.files = Table(spark, f"{path}/files", FILES, ["filepath"], ["repo"])
        self.summaries = Table(spark, f"{path}/summaries", SUMMARIES, ["filepath"], ["repo"])
        self.symbols = Table(spark, f"{path}/symbols", SYMBOLS, ["repo", "filepath", "full_symbol", "start_line"], ["repo"])

    @contextmanager
    def _made(self, files: DataFrame, url, sha, provider):
        """Chunks, files, summaries and symbols of files; what is held meanwhile is let go at the end."""
        ready = described(parsed(texts(files))).persist()
        lit = lambda x: F.lit(x).cast("string")
        chunks = weighted(chunk_rows(ready, lit(url), lit(sha), lit(provider) if provider else None, self.namespace), self.model)
        chunks = self.embed(chunks) if self.embed else chunks
        known = ready.select("filepath", "repo", "doc_type", "language", lit(sha).alias("commit_sha"), "mtime")
        try:
            yield chunks, known, summary_rows(ready), ready.select("repo", "filepath", F.inline("symbols"))
        finally:
            ready.unpersist()

    def sync_local(self, targets: list[dict], purge: bool = False) -> int:
        """Indexes the files of targets that are new or changed; returns their number. Files that are gone stay unless ``purge``."""
        found = scan(self.spark, targets).persist()
        changed = changed_files(found, self.files.read()).persist()
        try:
            n = changed.count()
            if n:
                touched = changed.select("filepath")
                with self._made(changed, None, None, None) as (chunks, known, summaries, symbols):
                    self.chunks.swap(touched.withColumnRenamed("filepath", "path"), chunks)
                    self.symbols.swap(touched, symbols)
                    self.summaries.upsert(summaries)
                    self.files.upsert(known)
            if purge:
                gone = gone_files(found, self.files.read().where("repo = 'local'")).select("filepath").persist()
                self.chunks.swap(gone.withColumnRenamed("filepath", "path"))
                for table in (self.symbols, self.summaries, self.files):
                    table.swap(gone)
                gone.unpersist()
            return n
        finally:
            changed.unpersist()
            found.unpersist()

    def sync_clone(self, repo: str, path: str, sha: str, url: str | None = None, provider: str | None = None, registry=None) -> int:
        """Replaces a repository's rows by those of the checkout at ``path``; returns the number of files.

        The files' table, which says of which commit a repository's rows are (``synced_sha``), first loses them and last gets them:
        a sync that dies in between leaves no commit, so the next poll starts it again, and every table is then replaced whole.
        In ``registry`` the repository is ``syncing`` meanwhile, and ``synced`` or ``error`` afterwards.
        """
        own = None if registry is None else registry.repositories.read().where(F.col("name") == repo).select("id").first()
        say = (lambda *given, **more: registry.set_status(own["id"], *given, **more)) if own is not None else (lambda *given, **more: None)
        say("syncing")
        try:
            files = scan(self.spark, [{"path": path, "repo": repo}], clone=True)
            with self._made(files, url, sha, provider) as (chunks, known, summaries, symbols):
                if self.synced_sha(repo) not in (None, sha):
                    self.files.delete_equal("repo", repo)
                for table, rows in ((self.chunks, chunks), (self.symbols, symbols), (self.summaries, summaries), (self.files, known)):
                    table.replace("repo", repo, rows)
            n = self.files.read().where(F.col("repo") == repo).count()
        except Exception as e:
            say("error", str(e)[:500])
            raise
        say("synced", sha=sha)
        return n

    def synced_sha(self, repo: str) -> str | None:
        """The commit that all rows of a repository are of; None if there is none, or a sync has not ended."""
        row = self.files.read().where((F.col("repo") == repo) & F.col("commit_sha").isNotNull()).select("commit_sha").first()
        return None if row is None else row["commit_sha"]

    def drop(self, repo: str, registry=None) -> None:
        """All rows of a repository go, its row in ``registry`` first and vectors last."""
        if registry is not None:
            registry.repositories.delete_equal("name", repo)
        for table in (self.files, self.summaries, self.symbols, self.chunks):
            table.delete_equal("repo", repo)
