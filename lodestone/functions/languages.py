"""File kinds: extensions that are read, the language of a file, and whether it is code or prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that a scan reads, matched with case.
READ = (
    ".md", ".txt", ".yaml", ".yml", ".json", ".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs",
    ".cs", ".cpp", ".c", ".h", ".java", ".rb", ".php", ".sh", ".sql", ".html", ".css",
)

# The language of each extension, in lower case.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust",
    "cs": "c_sharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "hpp": "cpp", "java": "java", "rb": "ruby",
    "php": "php", "sh": "bash", "bash": "bash", "sql": "sql", "html": "html", "css": "css", "json": "json", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "md": "markdown", "txt": "text",
}
PROSE = ("markdown", "text", "json", "yaml", "toml")
PRUNED = ("node_modules", "vendor", "__pycache__", "venv", ".git")
PRUNED_IN_CLONES = (*PRUNED, "dist", "build")


def is_read(path: Column) -> Column:
    return path.rlike(r"(?s)\.(" + "|".join(e[1:] for e in READ) + r")\z")


def language(path: Column) -> Column:
    """The language of a path by its last extension; ``text`` where it is unknown."""
    name = F.substring_index(path, "/", -1)
    ext = F.lower(F.regexp_extract(name, r"(?s)[^.].*\.([^.]*)\z", 1))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, ext), F.lit("text"))


def doc_type(lang: Column) -> Column:
    return F.when(lang.isin(*PROSE), F.lit("doc")).otherwise(F.lit("code"))
