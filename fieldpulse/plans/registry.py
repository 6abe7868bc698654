"""Registry of the driver keys: Spark callables over the bridge views and
their DuckDB oracle SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..params import DEFAULTS
from ..sources.bridge import AS_OF, RANGE_END, RANGE_START, bridge_tables
from ..streaming.registry import STREAM_ORACLE, STREAM_QUERIES
from .daily import DAILY_ORACLE, DAILY_QUERIES
from .oracle import ORACLE
from .queries import BATCH_QUERIES


def _run_batch(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = bridge_tables(spark, sf_dir)
    return BATCH_QUERIES[key](tables, as_of=AS_OF, start=RANGE_START, end=RANGE_END, params=DEFAULTS)


def all_queries() -> dict:
    return {k: partial(_run_batch, k) for k in BATCH_QUERIES} | DAILY_QUERIES | STREAM_QUERIES


def all_oracle_sql() -> dict[str, str]:
    return ORACLE | DAILY_ORACLE | STREAM_ORACLE
