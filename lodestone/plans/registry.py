"""The registry: repositories, local paths, hosts' credentials and settings, as small keyed tables."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mask_token
from ..functions.urls import host, provider_of_host
from ..sources.lease import Lease
from ..sources.store import Table

REPOSITORIES = (
    "id long, name string, url string, branch string, commit_sha string, auth_token string, provider string, auth_user string, "
    "enabled boolean, auto_sync boolean, webhook_secret string, status string, last_error string, last_synced timestamp, added_at timestamp"
)
PATHS = "id long, path string, type string, recursive boolean, enabled boolean, category string, repo string, added_at timestamp"
HOSTS = "id long, host string, provider string, auth_user string, auth_token string, added_at timestamp"
SETTINGS = "key string, value string"


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.repositories = Table(spark, f"{path}/repositories", REPOSITORIES, ["id"])
        self.paths = Table(spark, f"{path}/paths", PATHS, ["id"])
        self.hosts = Table(spark, f"{path}/hosts", HOSTS, ["host"])
        self.settings = Table(spark, f"{path}/settings", SETTINGS, ["key"])
        self.lease = Lease(spark, f"{path}/lease")
        self._busy = threading.Lock()

    def _row(self, **values) -> DataFrame:
        columns = {k: F.lit(v) for k, v in values.items()}
        return self.spark.range(1).select(*(c.alias(k) for k, c in columns.items()), F.current_timestamp().alias("added_at"))

    def add_repository(self, name: str, url: str, branch: str = "main", provider: str | None = None, **more) -> int:
        """The new id. The name becomes lower case, with ``_`` for other than letters, digits, ``_`` and ``-``; a taken one raises ``KeyExists``."""
        import re

        values = {"name": re.sub(r"[^a-zA-Z0-9_\-]", "_", name.strip()).lower(), "url": url.strip(), "branch": branch or "main", "provider": provider, "enabled": True, "auto_sync": True, "status": "pending"}
        return self.repositories.insert(self._row(**values | more), unique=["name"], number="id")

    def add_path(self, path: str, type_: str = "directory", recursive: bool = True, category: str | None = None, repo: str = "local") -> int:
        return self.paths.insert(self._row(path=path, type=type_, recursive=recursive, enabled=True, category=category, repo=repo), unique=["path"], number="id")

    def remove_path(self, id_: int) -> None:
        """The registry's row alone goes; its files stay indexed until an ingestion purges them."""
        self.paths.delete_equal("id", id_)

    def set_auto_sync(self, id_: int, on: bool) -> bool:
        """Whether there is such a repository."""
        return self.repositories.update(F.col("id") == id_, auto_sync=F.lit(on)) > 0

    def set_status(self, id_: int, status: str, error: str | None = None, sha: str | None = None) -> bool:
        values = {"status": F.lit(status), "last_error": F.lit(error)}
        if status == "synced":
            values |= {"commit_sha": F.lit(sha), "last_synced": F.current_timestamp()}
        return self.repositories.update(F.col("id") == id_, **values) > 0

    def save_host(self, name: str, token: str, user: str | None = None, provider: str | None = None) -> None:
        row = self._row(provider=provider, auth_user=user, auth_token=token).withColumn("host", host(F.lit(name.strip()), keep_port=True))
        same = F.col("host") == row.select("host").first()["host"]
        if not self.hosts.update(same, provider=F.lit(provider), auth_user=F.lit(user), auth_token=F.lit(token)):
            self.hosts.insert(row, number="id")

    def remove_host(self, id_or_host: int | str) -> None:
        if isinstance(id_or_host, int) or str(id_or_host).isdigit():
            self.hosts.delete_equal("id", int(id_or_host))
        else:
            self.hosts.delete(F.col("host") == host(F.lit(id_or_host), keep_port=True))

    def shown_hosts(self) -> DataFrame:
        """Hosts by name, tokens masked."""
        return self.hosts.read().withColumn("auth_token", mask_token(F.col("auth_token"))).orderBy("host")

    def shown_repositories(self, files: DataFrame) -> DataFrame:
        """Repositories, newest first, with file_count and without secrets."""
        from ..operators.catalog import with_file_counts

        return with_file_counts(self.repositories.read().drop("auth_token", "webhook_secret"), files).orderBy(F.desc("added_at"), F.desc("id"))

    def get(self, key: str, default: str | None = None) -> str | None:
        row = self.settings.read().where(F.col("key") == key).first()
        return default if row is None else row["value"]

    def put(self, key: str, value: str) -> None:
        self.settings.upsert(self.spark.createDataFrame([(key, value)], SETTINGS))

    def interval(self) -> int:
        """Minutes between polls, 15 unless set."""
        try:
            return int(self.get("auto_sync_interval", "15"))
        except (TypeError, ValueError):
            return 15

    def set_interval(self, minutes: int) -> None:
        self.put("auto_sync_interval", str(max(0, int(minutes))))

    def credentials(self, repositories: DataFrame, global_tokens: dict[str, str] | None = None, environment: dict[str, str] | None = None) -> DataFrame:
        """(id, auth_user, auth_token, source): a repository's own token, its host's, its provider's, the environment's, or none.

        The tokens are by provider; a repository that names none has the one that its host's name tells. Blank tokens are none.
        ``source``: ``own``, ``host <host>``, ``stored <provider>``, ``environment <provider>`` or ``none``. The user is that of
        the host where its token is taken, else the repository's own.
        """
        r = repositories.withColumn("_host", host(F.col("url"), keep_port=True))
        h = self.hosts.read().select(F.col("host").alias("_host"), F.col("auth_user").alias("_u"), F.nullif("auth_token", F.lit("")).alias("_t"))
        named = F.coalesce(F.nullif(F.lower("provider"), F.lit("")), provider_of_host(F.col("_host")))
        given = lambda tokens: F.coalesce(F.lit(None).cast("string"), *(F.when(F.col("_provider") == p, F.lit(t.strip())) for p, t in (tokens or {}).items() if t and t.strip()))
        own = F.nullif(F.trim("auth_token"), F.lit(""))
        both = r.join(h, "_host", "left").withColumn("_provider", named).withColumns({"_own": own, "_global": given(global_tokens), "_env": given(environment)})
        with_name = lambda kind, c: F.concat(F.lit(f"{kind} "), c)
        source = F.when(F.col("_own").isNotNull(), "own").when(F.col("_t").isNotNull(), with_name("host", F.col("_host"))).when(F.col("_global").isNotNull(), with_name("stored", F.col("_provider"))).when(F.col("_env").isNotNull(), with_name("environment", F.col("_provider"))).otherwise("none")
        user = F.when(F.col("_own").isNotNull(), F.trim("auth_user")).when(F.col("_t").isNotNull(), F.col("_u")).otherwise(F.col("auth_user"))
        return both.select("id", user.alias("auth_user"), F.coalesce("_own", "_t", "_global", "_env").alias("auth_token"), source.alias("source"))

    def exclusive(self, job) -> bool:
        """Runs a job unless one is running, here or in another process; whether it ran."""
        if not self._busy.acquire(blocking=False):
            return False
        try:
            with self.lease.held() as token:
                if token is None:
                    return False
                job()
                return True
        finally:
            self._busy.release()
