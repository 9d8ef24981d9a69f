"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontamination, language_id, media, near_dedup, packing, sharding, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_media_columns": media.op6_media_columns,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language_id": language_id.op8_language_id,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_sharding": sharding.op10_sharding,
}
ORACLES = {"op10_sharding": sharding.oracle()}
