"""The queries of this subpackage, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from lineform.llm import context_mixing, decontamination, ngram_join, oracles, personal_data, quality, secret_scan, sentencepieces, suffix_dedup, toxicity, transport_streams


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
        "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_sentencepiece_spans": sentencepieces.op5_sentencepiece_spans,
        "op6_transport_streams": transport_streams.op6_transport_streams,
        "op7_quality_votes": quality.op7_quality_votes,
        "op8_context_mixing": context_mixing.op8_context_mixing,
        "op9_personal_data": personal_data.op9_personal_data,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict:
    return dict(oracles.SQL)
