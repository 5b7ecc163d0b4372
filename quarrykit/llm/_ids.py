"""Joins of large tables with ids: few ids go to all tasks, so that texts need not move; many are met by a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Ids (longs) that are sent to every task: at most some 64 MB of hash table.
FEW = 2_000_000


def _sent(ids: DataFrame) -> DataFrame:
    ids = durable(ids.select(F.col(ids.columns[0]).alias("__id")).where("__id IS NOT NULL").distinct())
    return F.broadcast(ids) if ids.count() <= FEW else ids


def only(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose id is among the one-column table ``ids``."""
    return rows.join(_sent(ids), rows[id_col].cast("long") == F.col("__id"), "left_semi")


def minus(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose id is not among ``ids`` (rows without an id stay)."""
    return rows.join(_sent(ids), rows[id_col].cast("long") == F.col("__id"), "left_anti")
