"""Stores of chunks behind one interface, and the choice among them by settings.

A store is a keyed table in a folder under one of two scoring profiles: ``hybrid_rrf`` (dense and sparse ranks fused, ids that
are UUIDs) or ``dense_clamped`` (cosines of at least 0, ids as given, metadata without empty values). ``Backends`` takes the
settings from the registry, else from the environment, else defaults, makes a store anew when they change, and falls back
to a second folder where the first can't be reached.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Table
from .ingest import CHUNKS
from .registry import Registry
from .search import HashedEmbedder, Profile, Search, embedded, points, sanitized, weighted


class Store(Protocol):
    """What searches and ingestion need of a store."""

    def ready(self) -> bool: ...

    def upsert(self, rows: DataFrame) -> None: ...

    def delete_path(self, path: str) -> None: ...

    def delete_repo(self, repo: str) -> None: ...

    def hits(self, query: str, limit: int = 5, **filters: str | None) -> DataFrame: ...

    def facts(self) -> DataFrame: ...

    def healthy(self) -> tuple[bool, str]: ...


@dataclass(frozen=True)
class Settings:
    """Where a store is and how it scores. ``spare``: the folder to fall back to, or None."""

    path: str
    profile: Profile = Profile.HYBRID
    spare: str | None = None


class ChunkStore:
    """A store in a folder; the rows it is given may lack vectors, which it makes from their texts."""

    def __init__(self, spark: SparkSession, settings: Settings, embedder=HashedEmbedder()):
        self.settings, self.embedder = settings, embedder
        self.table = Table(spark, f"{settings.path.rstrip('/')}/{settings.profile.value}", CHUNKS, ["id"], ["repo"])

    def ready(self) -> bool:
        """Empties the store if its vectors have another dimension; whether its vectors fit now."""
        self.table.heal(self.embedder.dimension)
        return self.table.fits(self.embedder.dimension)

    def upsert(self, rows: DataFrame) -> None:
        """Rows of some of the chunks' columns, with an id; they replace those of their id."""
        rows = self.table._completed(rows)
        rows = points(rows) if self.settings.profile is Profile.HYBRID else sanitized(rows)
        made = embedded(rows.withColumnRenamed("dense", "_dense").withColumn("_text", F.coalesce("embed_text", "content", F.lit(""))), self.embedder, "_text")
        rows = made.withColumn("dense", F.coalesce("_dense", "dense")).drop("_dense", "_text")
        made = weighted(rows.withColumnRenamed("sparse", "_sparse"))
        self.table.upsert(made.withColumn("sparse", F.coalesce("_sparse", "sparse")).drop("_sparse"))

    def delete_path(self, path: str) -> None:
        self.table.delete_equal("path", path)

    def delete_repo(self, repo: str) -> None:
        self.table.delete_equal("repo", repo)

    def hits(self, query: str, limit: int = 5, **filters: str | None) -> DataFrame:
        return Search(self.table.read(), self.embedder, self.settings.profile).hits(query, limit, **filters)

    def facts(self) -> DataFrame:
        """One row: points, profile, folder and dimension."""
        s = self.settings
        return self.table.read().agg(F.count("*").alias("points"), F.lit(s.profile.value).alias("profile"), F.lit(s.path).alias("path"), F.lit(self.embedder.dimension).alias("dimension"))

    def healthy(self) -> tuple[bool, str]:
        """Whether the folder can be read, and why not."""
        try:
            fs, top = self.table._file("")
            fs.exists(top)
            return True, f"{self.table._state()[0]} versions"
        except Exception as e:  # noqa: BLE001  whatever the store says is the answer
            return False, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"


class Backends:
    """The store in use, by the registry's settings."""

    KEYS = {"path": "store_path", "profile": "store_profile", "spare": "store_spare"}

    def __init__(self, spark: SparkSession, registry: Registry, default: Settings, embedder=HashedEmbedder()):
        self.spark, self.registry, self.default, self.embedder = spark, registry, default, embedder
        self._made: tuple[Settings, ChunkStore] | None = None
        self.callbacks: list[Callable[[], None]] = []

    def settings(self) -> Settings:
        """From the registry, else from the environment (``STORE_PATH`` and so on), else the default."""
        given = {k: self.registry.get(name) or os.environ.get(name.upper()) for k, name in self.KEYS.items()}
        found = {k: v for k, v in given.items() if v}
        if "profile" in found:
            found["profile"] = Profile(found["profile"])
        return replace(self.default, **found)

    def test(self, settings: Settings) -> tuple[bool, str]:
        return ChunkStore(self.spark, settings, self.embedder).healthy()

    def current(self, anew: bool = False) -> ChunkStore:
        """The store; made anew if its settings changed, in the spare folder if the first can't be reached."""
        wanted = self.settings()
        if anew or self._made is None or self._made[0] != wanted:
            own = wanted if wanted.spare is None or self.test(wanted)[0] else replace(wanted, path=wanted.spare)
            store = ChunkStore(self.spark, own, self.embedder)
            store.ready()
            self._made = (wanted, store)
        return self._made[1]

    def switch(self, settings: Settings) -> ChunkStore:
        """Takes other settings, if their store can be reached, and has what ``callbacks`` hold build it anew."""
        fine, why = self.test(settings)
        if not fine:
            raise ConnectionError(why)
        for key, name in self.KEYS.items():
            value = getattr(settings, key)
            self.registry.put(name, value.value if isinstance(value, Profile) else value or "")
        store = self.current(anew=True)
        for callback in self.callbacks:
            callback()
        return store
