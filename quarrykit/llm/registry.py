"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import chat_format, conversation_repair, decontaminate, embedding_whitening, exact_dedup, language_id, line_dedup, packing, quality_pu, simhash_dedup, source_mixing, substring_dedup, token_counts


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": _documents(simhash_dedup.digest),
        "op2_line_dedup": _documents(line_dedup.digest),
        "op3_substring_dedup": _documents(substring_dedup.digest),
        "op4_quality_pu": lambda spark, sf_dir: quality_pu.digest(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        ),
        "op5_chat_format": lambda spark, sf_dir: chat_format.digest(table(spark, sf_dir, "conversations")),
        "op6_decontaminate": lambda spark, sf_dir: decontaminate.digest(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        ),
        "op7_token_counts": _documents(token_counts.digest),
        "op8_exact_dedup": _documents(exact_dedup.exact_dedup),
        "op9_packing": _documents(packing.digest),
        "op10_language_id": _documents(language_id.digest),
        "op11_source_mixing": _documents(source_mixing.digest),
        "op12_conversation_repair": lambda spark, sf_dir: conversation_repair.digest(table(spark, sf_dir, "conversations")),
        "op13_embedding_whitening": lambda spark, sf_dir: embedding_whitening.digest(table(spark, sf_dir, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE,
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op5_chat_format": chat_format.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
    }
