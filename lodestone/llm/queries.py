"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from . import decontamination, html_extraction, merkle_manifest, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, substring_parse, token_counts, toxicity, url_filters, vector_codes

QUERIES = {
    "op1_quality_classifier": quality_classifier.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_url_filters": url_filters.query,
    "op5_quality_rules": quality_rules.query,
    "op6_decontamination": decontamination.query,
    "op7_token_counts": token_counts.query,
    "op8_substring_parse": substring_parse.query,
    "op9_near_dedup": near_dedup.query,
    "op10_packing": packing.query,
    "op11_html_extraction": html_extraction.query,
    "op12_vector_codes": vector_codes.query,
    "op13_merkle_manifest": merkle_manifest.query,
}
ORACLE_SQL: dict[str, str] = {"op4_url_filters": url_filters.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL, "op13_merkle_manifest": merkle_manifest.ORACLE_SQL}
