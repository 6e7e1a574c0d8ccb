"""The library's expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"),
    "rrf_score": ("rank INT, k INT", "DOUBLE", "1D / (k + rank)"),
    "mask_token": ("t STRING", "STRING", "CASE WHEN t IS NULL OR t = '' THEN 'None' WHEN length(t) <= 8 THEN '****' ELSE concat(substr(t, 1, 4), '...', substr(t, -4)) END"),
    "normalize_git_url": ("u STRING", "STRING", "regexp_replace(trim(coalesce(u, '')), '^git@([^:\\s]+):(?=\\S)', 'https://$1/')"),
    "sanitize_url": ("u STRING", "STRING", "regexp_replace(coalesce(u, ''), '(?<=https?://)[^@/]+@', '***')"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; returns their names."""
    for name, (args, kind, body) in _FUNCTIONS.items():
        body = body.replace("\\", "\\\\")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(_FUNCTIONS)
