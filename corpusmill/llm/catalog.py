"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from . import (
    bpe,
    conversation_repair,
    langid,
    line_dedup,
    media,
    mixing,
    ngram_join,
    quality_rules,
    source_divergence,
    substring_dedup,
    suffix_dedup,
    toxicity,
    weak_quality,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_telephony_audio": media.query,
    "op3_line_dedup": line_dedup.query,
    "op4_weak_quality": weak_quality.query,
    "op5_toxicity": toxicity.query,
    "op6_quality_rules": quality_rules.query,
    "op7_language_id": langid.query,
    "op8_ngram_join": ngram_join.query,
    "op9_bpe": bpe.query,
    "op10_source_mixing": mixing.query,
    "op11_recompression": substring_dedup.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_source_divergence": source_divergence.query,
}

ORACLES = {
    "op3_line_dedup": line_dedup.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_source_divergence": source_divergence.SQL,
}
