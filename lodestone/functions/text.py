"""Text expressions: keyword tokens, Unicode trimming, and matching as SQLite's LIKE does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords. Only words that the token pattern can produce, of three letters or more, are here.
STOPWORDS = (
    "about", "above", "after", "again", "against", "all", "and", "any", "are", "because", "been", "before", "being", "below", "between", "both",
    "but", "can", "cannot", "could", "did", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "her", "here", "hers", "herself", "him", "himself", "his", "how", "into", "its", "itself", "more", "most", "myself", "nor", "not",
    "off", "once", "only", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should", "some", "such", "than",
    "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "too", "under", "until",
    "very", "was", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "with", "would", "you", "your", "yours", "yourself",
    "yourselves", "true", "false", "none", "null", "file", "path", "type", "http", "https", "com", "net", "org", "yaml", "json", "txt", "root",
    "self", "def", "class", "return", "import",
)

#: Tokens of keywords: letters and digits of ASCII, underscore, hyphen.
KEYWORD_TOKEN = r"[a-zA-Z0-9_\-]+"
#: What str.strip removes at either end, as a Java character class (its \s alone lacks U+001C to U+001F).
SPACE_CLASS = r"[\s\x1c-\x1f\x85\xa0]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"(?U)^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def not_blank(c: Column) -> Column:
    return F.length(strip(c)) > 0


def keyword_tokens(text: Column) -> Column:
    """The keyword candidates of a text in order: lower-cased tokens of 3 or more characters, no stop-word, not all digits."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(KEYWORD_TOKEN), 0)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike(r"^[0-9]+\z"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sqlite_like(c: Column, pattern: str) -> Column:
    """``c LIKE pattern``: only ASCII letters match without case; ``%`` and ``_`` of the pattern are wildcards; ``\\`` is literal."""
    lowered = pattern.translate({i: i + 32 for i in range(65, 91)})
    return F.like(ascii_lower(c), F.lit(lowered), F.lit("\u0001"))


def contains_like(c: Column, part: str, mode: str = "substring") -> Column:
    """Substring (``%x%``), prefix (``x%``) or suffix (``%x``) match under ``sqlite_like``."""
    return sqlite_like(c, {"substring": f"%{part}%", "prefix": f"{part}%", "suffix": f"%{part}"}[mode])


def contains_lower(c: Column, query: str) -> Column:
    """Case-insensitive plain substring, without wildcards; the query is trimmed."""
    return F.instr(F.lower(c), query.strip().lower()) > 0


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_replace(F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)).otherwise(F.lit("")), r"(?<=[^/])/+\z", "")


def split_tags(c: Column) -> Column:
    """A comma-separated list as an array of trimmed tags without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda t: strip(t)), lambda t: t != "")


def mask_token(c: Column) -> Column:
    """``None`` for nothing, ``****`` up to 8 characters, else the first and last four."""
    return (
        F.when(c.isNull() | (c == ""), F.lit("None"))
        .when(F.length(c) <= 8, F.lit("****"))
        .otherwise(F.concat(F.substring(c, 1, 4), F.lit("..."), F.substring(c, -4, 4)))
    )


def slug(c: Column) -> Column:
    """A registry name: other characters than letters, digits, ``_`` and ``-`` become ``_``; lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"[^a-zA-Z0-9_\-]", "_"))


def interval_minutes(c: Column, default: int = 15) -> Column:
    """A polling interval: an integer, ``default`` where it is none, never below 0."""
    return F.greatest(F.lit(0), F.coalesce(c.try_cast("int"), F.lit(default)))
