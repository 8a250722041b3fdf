"""The queries of the ten operators and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, exact_dedup, lang_id, lm_score, media, near_dedup, packing, pii, preferences, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_language_id": lang_id.op2_language_id,
    "op3_preferences": preferences.op3_preferences,
    "op4_media": media.op4_media,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_warc": warc.op6_warc,
    "op7_packing": packing.op7_packing,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_bpe": bpe.op9_bpe,
    "op10_pii": pii.op10_pii,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_preferences": preferences.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
}
