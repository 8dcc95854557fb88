"""Queries of this subpackage and their DuckDB counterparts."""

from . import decontamination, exact_dedup, lm_scoring, near_dedup, packing, pii, quality, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_pii": pii.op7_pii,
    "op8_decontaminate": decontamination.op8_decontaminate,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op8_decontaminate": decontamination.OP8_SQL,
}
