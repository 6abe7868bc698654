"""Latest row per key (PostgreSQL ``DISTINCT ON (k) ... ORDER BY k, created_at DESC``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, order: str = "created_at", tie: str | None = "id") -> DataFrame:
    """One row per ``key``: the greatest ``order`` with NULL first (PostgreSQL's
    DESC), then the greatest ``tie`` (the dashboard leaves ties undefined).

    ``row_number() == 1`` is planned as a ``WindowGroupLimit``: each map task
    keeps only its own latest row per key before the shuffle, so a key with a
    third of all rows ships one row per task, not all of its rows."""
    ordering = [F.col(order).desc_nulls_first()]
    if tie:
        ordering.append(F.col(tie).desc_nulls_first())
    w = Window.partitionBy(key).orderBy(*ordering)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
