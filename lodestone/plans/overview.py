"""What an index and its registry hold, as DataFrames: symbols, outlines, sources, files, numbers and settings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, filters, keywords
from .ingest import Index
from .registry import Registry
from .search import HashedEmbedder, Profile

#: Variables of the environment that may hold a provider's token.
TOKENS = ("GITHUB_TOKEN", "GITLAB_TOKEN", "GITEA_TOKEN", "BITBUCKET_TOKEN")


def lines(df: DataFrame, *columns: str, apart: str = "  ") -> str:
    """The rows of a short DataFrame as text, a line each, of the columns' values that are not null."""
    given = [F.col(c).cast("string") for c in columns or df.columns]
    return "\n".join(r[0] for r in df.select(F.concat_ws(apart, *given)).collect())


class Overview:
    def __init__(self, index: Index, registry: Registry, embedder=HashedEmbedder(), profile: Profile = Profile.HYBRID):
        self.index, self.registry, self.embedder, self.profile = index, registry, embedder, profile

    def find_symbol(self, name: str | None, repo: str | None = None, exact: bool = True, limit: int = 10) -> DataFrame:
        """Symbols of a name, or that hold it; a blank name finds none."""
        name = (name or "").strip()
        return filters.find_symbol(self.index.symbols.read(), name, repo, exact, limit=limit if name else 0)

    def outline(self, path: str | None, repo: str | None = None) -> DataFrame:
        """The symbols of the files whose path ends so, by line."""
        return filters.outline(self.index.symbols.read(), (path or "").strip(), repo)

    def sources(self) -> DataFrame:
        """(kind, name, location, provider, branch, sha, status, category, file_count, last_synced): repositories, then enabled local paths."""
        none = lambda c: F.lit(None).cast("string").alias(c)
        git = self.registry.repositories.read().select(
            F.lit("git").alias("kind"), "id", "name", F.col("url").alias("location"), "provider", "branch", F.substring("commit_sha", 1, 8).alias("sha"), "status", none("category"), "last_synced",
        )
        local = self.registry.paths.read().where("enabled").select(
            F.lit("local").alias("kind"), "id", F.col("repo").alias("name"), F.col("path").alias("location"), none("provider"), none("branch"), none("sha"),
            F.lit("enabled").alias("status"), "category", F.lit(None).cast("timestamp").alias("last_synced"),
        )
        return catalog.with_file_counts(git.unionByName(local), self.index.files.read()).orderBy("kind", "id").drop("id")

    def stats(self) -> DataFrame:
        """One row: numbers of files, paths, repositories, symbols and chunks, when the index was last built, and its keywords."""
        numbers = catalog.counts(files=self.index.files.read(), paths=self.registry.paths.read(), repositories=self.registry.repositories.read(), symbols=self.index.symbols.read(), points=self.index.chunks.read())
        cloud = keywords.keyword_cloud(self.index.summaries.read(), order="filepath")
        top = cloud.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))), lambda x: x["word"]).alias("top_keywords"))
        return numbers.join(F.broadcast(top), F.lit(True)).withColumn("last_indexed", F.lit(self.registry.get("last_indexed")).cast("string"))

    def status(self) -> DataFrame:
        """``stats`` with settings: scoring profile, embedder, its dimension and whether stored vectors have it, minutes between polls, and which sources of credentials there are (never the credentials)."""
        own = F.count_if(F.coalesce("auth_token", F.lit("")) != "")
        repositories = self.registry.repositories.read().agg(own.alias("repositories_with_token"))
        hosts = self.registry.hosts.read().agg(own.alias("hosts_with_token"))
        settings = {
            "profile": F.lit(self.profile.value), "embedder": F.lit(getattr(self.embedder, "name", type(self.embedder).__name__)), "dimension": F.lit(self.embedder.dimension),
            "vectors_fit": F.lit(self.index.chunks.fits(self.embedder.dimension)), "poll_minutes": F.lit(self.registry.interval()),
            "environment_tokens": F.array(*[F.lit(t) for t in TOKENS if os.environ.get(t)]).cast("array<string>"),
        }
        out = self.stats().join(F.broadcast(repositories), F.lit(True)).join(F.broadcast(hosts), F.lit(True))
        return out.withColumns(settings)

    def catalog(self) -> DataFrame:
        """(repo, filepath, doc_type, language, more) of the first 40 files; ``more`` is the number of those not shown."""
        return catalog.head(self.index.files.read().select("repo", "filepath", "doc_type", "language"), ["repo", "filepath"])

    def sync(self, repo: str | None, one, everything) -> int | None:
        """Runs ``one(id)`` for a registered name and returns the id; without a name, or with an unknown one, ``everything()``."""
        row = self.registry.repositories.read().where(F.col("name") == (repo or "")).select("id").first()
        if row is None:
            everything()
            return None
        one(row["id"])
        return row["id"]
