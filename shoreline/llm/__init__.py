"""Operators for preparing training text at scale; nothing outside this folder imports them."""

from __future__ import annotations

from shoreline.llm import byte_bpe, decontaminate, divergence, lm_scoring, mixing, near_dedup, passages, quality, sharding, snapshot_diff, token_counts, token_store, toxicity

MODULES = (passages, mixing, token_store, toxicity, lm_scoring, sharding, decontaminate, near_dedup, token_counts, quality, divergence, byte_bpe, snapshot_diff)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
