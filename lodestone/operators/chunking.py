"""Chunks of texts: by length, and by Markdown heading; and front matter.

Chunking is a scan without a shuffle: a row's chunks depend on that row alone. Splitting by length walks lines with a
running size, which expressions can only fold slowly, so it runs on Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_HEADING = re.compile(r"#{1,6}\s+(.+)")


def by_length(text: str, most: int = 1500, overlap: int = 200) -> list[tuple[str, int, int]]:
    """(content, first line, last line): whole lines, up to ``most`` characters, each chunk opening with the last whole
    lines of the one before that fit ``overlap``. A line is never cut, so a chunk may be longer. Any Unicode line break counts.
    """
    lines = text.splitlines(keepends=True)
    if len(text) <= most:
        return [(text, 1, len(lines))]
    at = [0, *accumulate(map(len, lines))]  # at[i]: where line i starts
    out, first = [], 0
    for i in range(len(lines)):
        if i > first and at[i + 1] - at[first] > most:
            out.append((text[at[first] : at[i]], first + 1, i))
            first = bisect_left(at, at[i] - overlap, first, i)
    out.append((text[at[first] :], first + 1, len(lines)))
    return out


def by_heading(text: str, most: int = 1500, overlap: int = 200) -> list[tuple[str, int, int, str]]:
    """(content, first line, last line, heading): sections from one Markdown heading line to the next, then by length.

    What precedes the first heading has the heading ``Root``. Headings inside code fences count as headings.
    """
    sections: list[tuple[str, int, list[str]]] = [("Root", 1, [])]
    for number, line in enumerate(text.split("\n"), 1):
        if m := _HEADING.fullmatch(line):
            sections.append((m[1].strip(), number, []))
        sections[-1][2].append(line)
    out = []
    for heading, start, lines in sections:
        if lines:
            body = "\n".join(lines)
            out += [(c, a + start - 1, z + start - 1, heading) for c, a, z in by_length(body, most, overlap)]
    return out


def front_matter(text: str) -> tuple[dict, str]:
    """A leading YAML header as a dict, and the body after it; without a well-formed header, nothing and the whole text."""
    m = re.match(r"\A\s*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not m:
        return {}, text
    try:
        import yaml

        head = yaml.safe_load(m[1])
    except Exception:  # noqa: BLE001  a malformed header is no header
        return {}, text
    return (head, text[m.end() :].strip()) if isinstance(head, dict) else ({}, text)


def header_tags(head: dict) -> list[str] | None:
    """The tags of a header: a list, or a text split at commas; None without any."""
    tags = head.get("tags")
    if isinstance(tags, str):
        return [t.strip() for t in tags.split(",") if t.strip()]
    return [str(t) for t in tags] if isinstance(tags, list) else None


def headers(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with category, tags and body, by the front matter of its texts."""

    def rows(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for t in batch.column(text).to_pylist():
                head, body = front_matter(t or "")
                category = head.get("category")
                for column, x in zip(out, (None if category is None else str(category), header_tags(head), body)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.string())], names=[*batch.schema.names, "category", "tags", "body"])

    return df.mapInArrow(rows, StructType([*df.schema.fields, *StructType.fromDDL("category string, tags array<string>, body string").fields]))


_SCHEMA = "id long, chunk_no int, content string, start_line int, end_line int, heading string"


def split(df: DataFrame, id_: str = "doc_id", text: str = "text", most: int = 1500, overlap: int = 200, markdown: bool = False, blank: bool = True) -> DataFrame:
    """(id, chunk_no, content, start_line, end_line, heading) of every row; null texts as empty.

    ``blank=False`` leaves out chunks of white space alone; ``chunk_no`` counts what is left.
    """

    def rows(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                chunks = by_heading(t or "", most, overlap) if markdown else [(*c, None) for c in by_length(t or "", most, overlap)]
                chunks = [c for c in chunks if blank or c[0].strip()]
                for n, (content, a, z, heading) in enumerate(chunks):
                    for column, x in zip(out, (i, n, content, a, z, heading)):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "chunk_no", "content", "start_line", "end_line", "heading"])

    return df.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(rows, _SCHEMA)
