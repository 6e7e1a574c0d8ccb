"""Counts, inventories and overviews of repositories, files and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files_per_repo(files: DataFrame, repo: str = "repo") -> DataFrame:
    return files.groupBy(repo).agg(F.count("*").alias("file_count"))


def with_file_counts(registry: DataFrame, files: DataFrame, name: str = "name", repo: str = "repo") -> DataFrame:
    """``registry`` with file_count, 0 where a repository has no file. Files are counted before the join."""
    counts = files.groupBy(F.col(repo).alias("_repo")).agg(F.count("*").alias("file_count"))
    return registry.join(counts, F.col(name) == F.col("_repo"), "left").drop("_repo").withColumn("file_count", F.coalesce("file_count", F.lit(0)))


def inventory(repositories: DataFrame, paths: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, name, location, status, sha, file_count) of repositories and local paths."""
    git = repositories.select(F.lit("git").alias("kind"), "name", F.col("url").alias("location"), "status", F.substring("commit_sha", 1, 8).alias("sha"))
    local = paths.select(F.lit("local").alias("kind"), F.col("repo").alias("name"), F.col("path").alias("location"), F.when(F.col("enabled"), "enabled").otherwise("disabled").alias("status"), F.lit(None).cast("string").alias("sha"))
    return with_file_counts(git.unionByName(local), files)


def counts(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table. Each is one pass over no column."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one), F.lit(True))
    return out


def head(files: DataFrame, order: list[str], n: int = 40) -> DataFrame:
    """The first n files, each with the number of those not shown."""
    total = files.agg(F.count("*").alias("_total"))
    return files.orderBy(*order).limit(n).join(F.broadcast(total), F.lit(True)).withColumn("more", F.greatest(F.lit(0), F.col("_total") - n)).drop("_total")


def level_counts(logs: DataFrame, levels: list[str]) -> DataFrame:
    return logs.agg(F.count("*").alias("total"), *(F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in levels))


def description(repositories: DataFrame, paths: DataFrame, symbols: DataFrame, files: DataFrame, base: str) -> DataFrame:
    """One row, text: the base, then how many sources there are and the first ten, then counts of symbols and files if there are any."""
    names = repositories.where("status = 'synced'").select(F.lit(0).alias("o"), F.col("name").alias("n"))
    sources = names.unionByName(paths.where("enabled").select(F.lit(1).alias("o"), F.substring_index("path", "/", -1).alias("n")))
    # ten rows leave the tasks; the others are counted alone
    first = sources.orderBy("o", "n").limit(10).agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("first"))
    own = first.join(F.broadcast(counts(sources=sources, symbols=symbols, files=files)), F.lit(True))
    shown = F.array_join(F.transform("first", lambda s: s["n"]), ", ")
    active = F.when(F.col("sources") > 0, F.format_string("%d sources: %s.", "sources", shown))
    indexed = F.when(F.col("symbols") > 0, F.format_string("%d symbols in %d files.", "symbols", "files"))
    return own.select(F.concat_ws(" ", F.lit(base), active, indexed).alias("text"))


def listing(entries: DataFrame) -> DataFrame:
    """A folder's entries (name, is_dir) without hidden ones: folders, then files, each by lower-cased name."""
    return entries.where(~F.col("name").startswith(".")).orderBy(F.desc("is_dir"), F.lower("name"), "name")
