"""Latest version per key over append-only tables (AGG-13, WIN-3).

The reference runs one ``argMax(col, created_at)`` per column. Here the winning row of a key
is the first in the order ``(created_at, tiebreak...)`` descending, so a key's columns always
come from the same row even when timestamps tie. ``row_number() = 1`` is planned as a
WindowGroupLimit on both sides of the shuffle: each map task sends at most one row of a key,
so a key that holds a third of all versions does not land whole in one task, and columns that
the query does not read are pruned from the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str | Column],
    values: Sequence[str] | None = None,
    latest_alias: str | None = None,
) -> DataFrame:
    """One row per ``key``: the row with the greatest ``order`` tuple.

    ``values``: columns to keep (default: all non-key columns). ``latest_alias``:
    also output ``max(order[0])`` under that name (the reference's ``max(created_at)``).
    """
    keys = [key] if isinstance(key, str) else list(key)
    if values is None:
        values = [c for c in df.columns if c not in keys]
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranks = [c.alias(f"__o{i}") for i, c in enumerate(order_cols)]
    w = Window.partitionBy(*keys).orderBy(*[F.col(f"__o{i}").desc_nulls_last() for i in range(len(ranks))])
    rows = df.select(*keys, *values, *ranks).withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    extra = [F.col("__o0").alias(latest_alias)] if latest_alias else []
    return rows.select(*keys, *values, *extra)
