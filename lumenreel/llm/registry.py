"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, conversation_repair, exact_dedup, html_text, language_id, merkle, packing, periodic_runs, simhash, substring_dedup, token_counts, toxicity, url_filter

_NAMED = {
    "op1_packing": packing,
    "op2_url_filter": url_filter,
    "op3_simhash": simhash,
    "op4_language_id": language_id,
    "op5_substring_dedup": substring_dedup,
    "op6_html_text": html_text,
    "op7_byte_bpe": byte_bpe,
    "op8_toxicity": toxicity,
    "op9_exact_dedup": exact_dedup,
    "op10_merkle": merkle,
    "op11_periodic_runs": periodic_runs,
    "op12_token_counts": token_counts,
    "op13_conversation_repair": conversation_repair,
}


def queries() -> dict:
    return {name: module.query for name, module in _NAMED.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: module.ORACLE for name, module in _NAMED.items() if hasattr(module, "ORACLE")}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
