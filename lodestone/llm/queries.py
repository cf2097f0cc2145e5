"""The operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontamination, language_id, pii, quality_classifier, quality_rules, sharding, simhash, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_bpe": bpe.query,
    "op4_chat_formatting": chat.query,
    "op5_token_counts": token_counts.query,
    "op6_sharding": sharding.query,
    "op7_language_id": language_id.query,
    "op8_quality_rules": quality_rules.query,
    "op9_pii": pii.query,
    "op10_simhash_near_dedup": simhash.query,
}

ORACLE_SQL: dict[str, str] = {"op4_chat_formatting": chat.ORACLE, "op8_quality_rules": quality_rules.oracle()}
