"""Queries and oracle SQL of the library's own operators, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def modules() -> list:
    from .plans import build, chat, evidence, health, knowledge, pages, retrieval, snapshots, sources, technology, text

    return [text, retrieval, snapshots, chat, health, pages, evidence, technology, knowledge, build, sources]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in modules():
        found |= module.ORACLE
    return found
