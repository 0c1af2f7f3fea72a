"""Connected components of a link table (no driver-side state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.dedup import connected


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of ``links``: label is the smallest node that can be reached.

    Null ends are dropped; self-links and repeated links change nothing; no links give no rows.
    """
    return connected(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v")))
