"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from . import bpe, chat, decontaminate, divergence, jaccard, licenses, lines, mixing, negatives, pii, quality, secrets, tokens

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_token_counts": tokens.query,
    "op3_line_dedup": lines.query,
    "op4_personal_data": pii.query,
    "op5_chat_formatting": chat.query,
    "op6_decontamination": decontaminate.query,
    "op7_source_mixing": mixing.query,
    "op8_secret_scan": secrets.query,
    "op9_license_scan": licenses.query,
    "op10_ngram_join": jaccard.query,
    "op11_bpe_round_trip": bpe.query,
    "op12_source_divergence": divergence.query,
    "op13_hard_negatives": negatives.query,
}

#: Operators without an entry are held against brute force in tests/llm.
SQL = {
    "op1_quality_rules": quality.SQL,
    "op3_line_dedup": lines.SQL,
    "op5_chat_formatting": chat.SQL,
    "op7_source_mixing": mixing.SQL,
    "op10_ngram_join": jaccard.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_hard_negatives": negatives.SQL,
}
