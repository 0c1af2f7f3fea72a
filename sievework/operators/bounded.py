"""Joins that broadcast only what is shown to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to this many keys are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def only(df: DataFrame, key: str, ids: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one column of distinct keys, stored: it is counted first)."""
    col = ids.columns[0]
    side = F.broadcast(ids) if at_most(ids, rows) else ids
    return df.join(side, df[key] == side[col], "left_semi")
