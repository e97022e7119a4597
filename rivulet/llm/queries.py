"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import chat, embedding_dedup, licenses, lm_score, mixing, neardup, packing, quality, sharding, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_minhash_dedup": neardup.op4_minhash_dedup,
        "op5_chat_format": chat.op5_chat_format,
        "op6_sharding": sharding.op6_sharding,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_mixing": mixing.op8_mixing,
        "op9_lm_score": lm_score.op9_lm_score,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embedding_dedup.ORACLE,
        "op4_minhash_dedup": neardup.ORACLE,
        "op5_chat_format": chat.ORACLE,
        "op7_quality_rules": quality.oracle(),
        "op8_mixing": mixing.ORACLE,
    }
