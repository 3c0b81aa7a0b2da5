"""The operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tradewind.llm import (
    bpe, conversations, nearest, oracle, packing, quality, secrets, sharding, simhash, substring, token_files, vector_copies,
    warc, whitening,
)


def queries() -> dict:
    return {
        "op1_substring_dedup": substring.op1_substring_dedup,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_adaptive_scan": nearest.op3_adaptive_scan,
        "op4_warc_bundles": warc.op4_warc_bundles,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_simhash_neighbours": simhash.op6_simhash_neighbours,
        "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_token_files": token_files.op9_token_files,
        "op10_histogram_sort": sharding.op10_histogram_sort,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_sorted_projections": vector_copies.op13_sorted_projections,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
