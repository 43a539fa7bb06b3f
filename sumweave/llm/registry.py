"""The corpus operators' queries and, where SQL can express one, its SQL."""

from sumweave.llm import decontaminate, licenses, lm_score, mixing, near_dedup, private_data, quality, token_counts, token_files, url_filter

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_near_dedup": near_dedup.query,
    "op3_private_data": private_data.query,
    "op4_quality_rules": quality.query,
    "op5_token_files": token_files.query,
    "op6_source_mix": mixing.query,
    "op7_license_scan": licenses.query,
    "op8_lm_score": lm_score.query,
    "op9_decontamination": decontaminate.query,
    "op10_url_filter": url_filter.query,
}

ORACLE_SQL = {"op4_quality_rules": quality.SQL, "op10_url_filter": url_filter.sql()}
