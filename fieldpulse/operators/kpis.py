"""Counting operators of the dashboards: non-null counts, distinct counts,
grouped counts with the NULL group, enumerator counts, rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.text import full_name, joined_name
from .order import numbered


def count_non_null(df: DataFrame, col: str, alias: str) -> DataFrame:
    """``COUNT(col)``: one row, NULLs skipped (partial count per task, then a sum)."""
    return df.agg(F.count(col).cast("bigint").alias(alias))


def count_distinct(df: DataFrame, expr: Column, alias: str) -> DataFrame:
    """``COUNT(DISTINCT expr)``: one row, NULL ignored.  Spark deduplicates per
    task, shuffles the distinct values by hash, then counts: no single task
    sees more than its hash range of distinct values."""
    return df.agg(F.count_distinct(expr).cast("bigint").alias(alias))


def group_count(df: DataFrame, key: Column, key_name: str, alias: str = "total") -> DataFrame:
    """``SELECT key, COUNT(*) ... GROUP BY key``; the NULL key is its own group.
    Map-side partial counts make a hot key cost one row per task."""
    return df.groupBy(key.alias(key_name)).agg(F.count(F.lit(1)).cast("bigint").alias(alias))


def enumerator_counts(answers: DataFrame, users: DataFrame, id_name: str,
                      total_name: str = "total_encuestas") -> DataFrame:
    """Distinct submissions per enumerator with ``CONCAT(COALESCE..)`` names.

    The dashboard joins first and groups by (user, first, last).  As ``users.id``
    is unique, grouping by ``user_id`` first and joining the per-user result is
    the same and keeps the join small: both sides are bounded by the number of
    enumerators.  Spark picks broadcast only when the users side is measured
    small (plan statistics, then AQE on the real size); otherwise a sort-merge
    join.  A hot enumerator is safe: the distinct step shuffles on
    (user_id, survey_user_id), spreading its submissions over many tasks."""
    per_user = answers.groupBy("user_id").agg(
        F.count_distinct("survey_user_id").cast("bigint").alias(total_name))
    u = users.select(F.col("id").alias("user_id"),
                     full_name("first_name", "last_name").alias("nombre_completo"))
    return per_user.join(u, "user_id", "inner").select(
        F.col("user_id").alias(id_name), "nombre_completo", total_name).orderBy(F.desc(total_name), id_name)


def enumerator_counts_joined(day_answers: DataFrame, submissions: DataFrame, users: DataFrame,
                             survey_ids) -> DataFrame:
    """Three-way join submissions x users x answers, ``||`` names (NULL if a part is NULL),
    distinct submissions per user.

    Rewritten as: distinct submission ids among the answers, joined to the
    submissions of the survey set, counted per submission owner, then joined to
    users.  Same result because ``submissions.id`` and ``users.id`` are keys."""
    sids = day_answers.select(F.col("survey_user_id").alias("id")).distinct()
    subs = submissions.where(F.col("survey_id").isin(*survey_ids)).select("id", "user_id")
    owned = subs.join(sids, "id")  # both sides are distinct, so either may be the built one
    per_user = owned.groupBy("user_id").agg(F.count("id").cast("bigint").alias("total_encuestas_hoy"))
    u = users.select(F.col("id").alias("user_id"), F.col("username").alias("usuario_login"),
                     joined_name("first_name", "last_name").alias("usuario_nombre"))
    return per_user.join(u, "user_id", "inner").select(
        F.col("user_id").alias("usuario_id"), "usuario_login", "usuario_nombre", "total_encuestas_hoy"
    ).orderBy(F.desc("total_encuestas_hoy"), "usuario_id")


def rollup_distinct(df: DataFrame, key: Column, value: str, label: str,
                    key_name: str = "sector", alias: str = "total_encuestas") -> DataFrame:
    """``GROUP BY ROLLUP (key)`` with ``COUNT(DISTINCT value)`` and
    ``COALESCE(key, label)``.  Ordered by label; the grand total carries the same label as the NULL
    group, so ``level`` (``grouping_id()``: 0 = group, 1 = total) tells them apart.
    The total is a distinct count over all rows, not a sum of groups."""
    g = df.select(key.alias("_k"), F.col(value).alias("_v")).rollup("_k").agg(
        F.count_distinct("_v").cast("bigint").alias(alias),
        F.grouping_id().cast("int").alias("level"))
    return g.select(F.coalesce(F.col("_k"), F.lit(label)).alias(key_name), alias, "level").orderBy(key_name, "level", alias)


def ranked(df: DataFrame, *order) -> DataFrame:
    """Add ``rank``, the place in the given order, numbered range by range."""
    return numbered(df, *order)


def answer_kpis(answers: DataFrame, household_qids, sector_qids) -> DataFrame:
    """One row (total_encuestas, total_viviendas, total_sectores) from one pass
    over the answers: distinct submissions, distinct trimmed household answers,
    and sector groups, the NULL group included."""
    q, text = F.col("survey_question_id"), field(answers, "value_text")
    sector = q.isin(*sector_qids)
    return answers.agg(
        F.count_distinct("survey_user_id").cast("bigint").alias("total_encuestas"),
        F.count_distinct(F.when(q.isin(*household_qids), F.trim(text))).cast("bigint").alias("total_viviendas"),
        (F.count_distinct(F.when(sector, text)) + F.coalesce(F.max(F.when(sector & text.isNull(), 1)), F.lit(0)))
        .cast("bigint").alias("total_sectores"))
