"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import (
    byte_bpe, conversation_repair, embedding_dedup, exact_dedup, language_id, periodic_runs, quality_rules, secret_scan, simhash_dedup,
    source_mix, token_count, toxicity, url_filter,
)

QUERIES = {
    "op4_url_filter": url_filter.op4_url_filter,
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": language_id.op3_language_id,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_token_count": token_count.op9_token_count,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE_SQL = {
    "op1_secret_scan": secret_scan.SQL,
    "op4_url_filter": url_filter.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_embedding_dedup": embedding_dedup.SQL,
}
