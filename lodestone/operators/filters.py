"""Predicates on chunks, symbols, files and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_like, contains_lower


def metadata(tag: str | None = None, **equal: str | None) -> Column:
    """The conjunction of equalities; an empty or None value sets no condition, and ``doc_type='all'`` neither.

    A null column never matches. ``tag`` must be among the array column tags.
    """
    out = F.lit(True)
    for name, value in equal.items():
        if value and not (name == "doc_type" and value == "all"):
            out &= F.col(name) == F.lit(value)
    if tag:
        out &= F.array_contains("tags", tag)
    return out


def limited(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows; a negative number is no limit."""
    return df if n < 0 else df.limit(n)


def find_symbol(symbols: DataFrame, name: str, repo: str | None = None, exact: bool = True, mode: str = "substring", limit: int = 20) -> DataFrame:
    """Symbols by name or full name, in the order repo, filepath, start_line."""
    same = (F.col("name") == name) | (F.col("full_symbol") == name)
    part = contains_like(F.col("name"), name, mode) | contains_like(F.col("full_symbol"), name, mode)
    return limited(symbols.where((same if exact else part) & metadata(repo=repo)).orderBy("repo", "filepath", "start_line"), limit)


def outline(symbols: DataFrame, path: str, repo: str | None = None) -> DataFrame:
    """The symbols of files whose path ends so, by line, with a line of text for each; an empty path fits every file."""
    text = F.format_string("%s (%s) lines %d-%d", "full_symbol", "kind", "start_line", "end_line")
    found = symbols.where(((F.col("filepath") == path) | contains_like(F.col("filepath"), path, "suffix")) & metadata(repo=repo))
    return found.withColumn("outline", text).orderBy("start_line", "filepath")


def logs(df: DataFrame, level: str | None = None, query: str | None = None, columns: tuple[str, ...] = ("message", "logger"), trim: bool = True) -> DataFrame:
    """Log rows of a level (``ALL`` or empty: any) that hold a text in one of the columns, whatever the case."""
    if level and level.upper() != "ALL":
        df = df.where(F.col("level") == level.upper())
    if query and (query.strip() or not trim):
        hit = F.lit(False)
        for c in columns:
            found = contains_lower(F.col(c), query) if trim else F.instr(F.lower(c), query.lower()) > 0
            hit |= F.coalesce(found, F.lit(False))
        df = df.where(hit)
    return df


def log_tail(df: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    """The last ``limit`` rows, newest first. 0 keeps all rows; a negative number drops the oldest so many."""
    newest = df.orderBy(F.desc(order))
    if limit > 0:
        return newest.limit(limit)
    if limit == 0:
        return newest
    oldest = df.orderBy(order).limit(-limit).select(F.max(order).alias("_cut"))
    return df.join(F.broadcast(oldest), F.col(order) > F.coalesce("_cut", F.lit(-1)), "inner").drop("_cut").orderBy(F.desc(order))
