"""What changed: files by time, repositories by commit, pushes by webhook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize, repository_key


def changed_files(found: DataFrame, known: DataFrame, slack: float = 0.01) -> DataFrame:
    """Rows of ``found`` (filepath, mtime, …) that ``known`` lacks, or has with a time that differs by ``slack`` or more."""
    cached = known.select(F.col("filepath").alias("_path"), F.col("mtime").alias("_mtime"))
    both = found.join(cached, F.col("filepath") == F.col("_path"), "left")
    return both.where(F.col("_mtime").isNull() | (F.abs(F.col("_mtime") - F.col("mtime")) >= slack)).drop("_path", "_mtime")


def gone_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``known`` whose file is not found any more, for an opt-in purge."""
    return known.join(found.select("filepath"), "filepath", "left_anti")


def stale_repositories(repositories: DataFrame, heads: DataFrame) -> DataFrame:
    """Repositories (id, commit_sha, …) to sync: the remote head (id, sha) is unknown or another."""
    both = repositories.join(heads.select(F.col("id").alias("_id"), F.col("sha").alias("_sha")), F.col("id") == F.col("_id"), "left")
    return both.where(F.col("_sha").isNull() | ~F.col("_sha").eqNullSafe(F.col("commit_sha"))).drop("_id", "_sha")


def poll(repositories: DataFrame, heads: DataFrame) -> DataFrame:
    """One row (checked, updated): auto-synced repositories with a known head, and those of them whose head is another."""
    both = repositories.where("auto_sync").join(heads.select(F.col("id").alias("_id"), F.col("sha").alias("_sha")), F.col("id") == F.col("_id"), "left")
    return both.agg(F.count_if(F.col("_sha").isNotNull()).alias("checked"), F.count_if(F.col("_sha").isNotNull() & ~F.col("_sha").eqNullSafe(F.col("commit_sha"))).alias("updated"))


def _path(payload: Column, *paths: str) -> Column:
    """The first of the JSON paths that is not empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths))


def pushes(events: DataFrame, payload: str = "payload") -> DataFrame:
    """``events`` with push_url and push_branch, of the payloads of several git hosts; null where there is none."""
    p = F.col(payload)
    ref = _path(p, "$.ref", "$.push.changes[0].new.name")
    of = lambda *names: _path(p, *(f"$.repository.{n}" for n in names))
    plain = of("clone_url", "git_url", "ssh_url", "html_url")
    has_html = F.coalesce(F.get_json_object(p, "$.repository.links.html"), F.lit("")).startswith("{")
    clones = F.from_json(F.get_json_object(p, "$.repository.links.clone"), "array<struct<href:string>>")
    first_clone = F.get(F.filter(F.transform(clones, lambda c: c["href"]), lambda h: h.isNotNull() & (h != "")), F.lit(0))
    linked = F.when(has_html, of("links.html.href")).otherwise(first_clone)
    is_repo = F.coalesce(F.get_json_object(p, "$.repository"), F.lit("")).startswith("{")
    url = F.when(is_repo, F.coalesce(plain, linked)).otherwise(_path(p, "$.project.git_http_url", "$.project.git_ssh_url", "$.project.web_url"))
    return events.withColumns({"push_url": F.when(url.isNotNull(), normalize(url)), "push_branch": F.regexp_replace(ref, r"^refs/heads/", "")})


def matched_pushes(events: DataFrame, repositories: DataFrame, id_: str = "event_id") -> DataFrame:
    """(event id, repo_id, repo_name, status) of each push: its first registered repository of that URL and, if given, branch.

    ``status``: ``sync_triggered``, or ``ignored`` where none matches or auto-sync is off, or ``invalid`` without a URL, or
    ``unauthorized`` where ``events`` have a column authentic that is false. The first repository of each URL and branch is found
    among the repositories, so events meet at most one row and are not sorted; a stream of events may be joined likewise.
    """
    row = F.struct(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"), F.coalesce("auto_sync", F.lit(True)).alias("_auto"))
    known = repositories.select(repository_key(F.col("url")).alias("_key"), F.col("branch").alias("_branch"), row.alias("_row")).where("_key IS NOT NULL")
    by_branch = known.where("_branch IS NOT NULL").groupBy("_key", "_branch").agg(F.min_by("_row", "_row.repo_id").alias("_row"))
    of_any = known.groupBy("_key").agg(F.min_by("_row", "_row.repo_id").alias("_row")).select("_key", F.lit(None).cast("string").alias("_branch"), "_row")
    first = by_branch.unionByName(of_any)
    authentic = F.col("authentic") if "authentic" in events.columns else F.lit(True)
    e = events.select(id_, "push_url", F.nullif("push_branch", F.lit("")).alias("push_branch"), repository_key(F.col("push_url")).alias("_pushed"), authentic.alias("_authentic"))
    on = (F.col("_pushed") == F.col("_key")) & F.col("push_branch").eqNullSafe(F.col("_branch")) & F.col("_authentic")
    both = e.join(first, on, "left")
    status = F.when(~F.col("_authentic"), "unauthorized").when(F.col("push_url").isNull(), "invalid").when(F.col("_row._auto"), "sync_triggered").otherwise("ignored")
    return both.select(id_, F.col("_row.repo_id").alias("repo_id"), F.col("_row.repo_name").alias("repo_name"), status.alias("status"))
