"""Driver keys for the streaming indicators: the bridge answers arrive as files,
out of day order, in several micro-batches; the stream runs until it has read
all of them and the final table is returned.  Their oracle is the batch SQL of
the same indicator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULTS
from ..session import checkpoint_root
from ..sources.bridge import (CUSTOMER_SCHEMA, EVENTS_SCHEMA, answers_from_events, bridge_tables,
                              changes_from_answers, corrected_cte, duckdb_cte, users_from_customer)
from . import changes, monitor

#: Files that arrive one after the other, each with days from the whole period.
ARRIVALS = 5


def _answer_stream(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    arrivals = f"{root}/arrivals"
    (events.withColumn("arrival", F.pmod(F.dayofmonth("ts") * 7, F.lit(ARRIVALS)))
     .write.partitionBy("arrival").parquet(arrivals))
    files = len(spark.read.parquet(arrivals).inputFiles())
    stream = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max(1, files // ARRIVALS))
              .parquet(arrivals))
    return answers_from_events(stream)


def _run(spark: SparkSession, sf_dir: str, name: str, keys: list[str], build) -> DataFrame:
    root = f"{checkpoint_root(spark)}/replay-{uuid.uuid4().hex}"
    return monitor.run_to_table(build(_answer_stream(spark, sf_dir, root)), keys, name, root=root)


def stream_sector_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "sector_daily", ["day", "sector"], monitor.sector_daily)


def stream_submissions_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "submissions_daily", ["day"], monitor.submissions_daily)


def stream_households_daily_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streamed estimate beside the exact batch count of the day:
    ``within_error`` tells whether they differ by three standard errors, or one
    household where that is less than one, at most."""
    rsd = 0.05
    got = _run(spark, sf_dir, "households_daily", ["day"], lambda a: monitor.households_daily_approx(a, DEFAULTS, rsd))
    t = bridge_tables(spark, sf_dir)
    a = t.answers.where(F.col("survey_id").isin(*DEFAULTS.survey_ids)
                        & F.col("survey_question_id").isin(*DEFAULTS.household_qids))
    exact = a.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count_distinct(F.trim(F.get_json_object("data", "$.value"))).cast("bigint").alias("exact"))
    both = exact.join(got, "day", "full")
    return both.select("day", "exact", (F.abs(F.col("total_viviendas") - F.col("exact"))
                                        <= F.greatest(F.lit(1.0), 3 * rsd * F.col("exact"))).alias("within_error"))


def stream_latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "latest_answer", ["survey_user_id"], monitor.latest_answer)


def stream_enumerators_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = users_from_customer(spark.read.schema(CUSTOMER_SCHEMA).parquet(f"{sf_dir}/customer.parquet"))
    return _run(spark, sf_dir, "enumerators_daily", ["day", "user_id"],
                lambda a: monitor.enumerators_daily(a, users, DEFAULTS))


def _run_changes(spark: SparkSession, sf_dir: str, name: str, indicator: changes.Indicator) -> DataFrame:
    """The bridge's change feed in ARRIVALS files, one micro-batch each."""
    root = f"{checkpoint_root(spark)}/replay-{uuid.uuid4().hex}"
    feed = changes_from_answers(bridge_tables(spark, sf_dir).answers, ARRIVALS)
    feed.write.partitionBy("arrival").parquet(f"{root}/feed")
    files = len(spark.read.parquet(f"{root}/feed").inputFiles())
    stream = changes.read_change_stream(spark, f"{root}/feed/*", max(1, files // ARRIVALS))
    return changes.run_changes(stream, indicator, name, root=root)


def stream_sector_daily_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_changes(spark, sf_dir, "sector_daily", changes.sector_daily())


def stream_submissions_daily_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_changes(spark, sf_dir, "submissions_daily", changes.submissions_daily())


def stream_enumerators_daily_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = users_from_customer(spark.read.schema(CUSTOMER_SCHEMA).parquet(f"{sf_dir}/customer.parquet"))
    return _run_changes(spark, sf_dir, "enumerators_daily", changes.enumerators_daily(users))


def stream_latest_answer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_changes(spark, sf_dir, "latest_answer", changes.latest_answer())


STREAM_QUERIES = {
    "stream_sector_daily": stream_sector_daily,
    "stream_submissions_daily": stream_submissions_daily,
    "stream_households_daily_approx": stream_households_daily_approx,
    "stream_latest_answer": stream_latest_answer,
    "stream_enumerators_daily": stream_enumerators_daily,
    "stream_sector_daily_changes": stream_sector_daily_changes,
    "stream_submissions_daily_changes": stream_submissions_daily_changes,
    "stream_enumerators_daily_changes": stream_enumerators_daily_changes,
    "stream_latest_answer_changes": stream_latest_answer_changes,
}

_S = "(18, 30, 31)"
STREAM_ORACLE = {
    "stream_sector_daily": duckdb_cte() +
        "SELECT CAST(created_at AS DATE) AS day, data->>'$.value' AS sector, count(*)::BIGINT AS total "
        f"FROM survey_answer WHERE survey_id IN {_S} AND survey_question_id IN (477, 863) GROUP BY 1, 2",
    "stream_submissions_daily": duckdb_cte() +
        "SELECT CAST(created_at AS DATE) AS day, count(DISTINCT survey_user_id)::BIGINT AS total_encuestas "
        f"FROM survey_answer WHERE survey_id IN {_S} GROUP BY 1",
    "stream_households_daily_approx": duckdb_cte() +
        "SELECT CAST(created_at AS DATE) AS day, count(DISTINCT trim(data->>'$.value'))::BIGINT AS exact, "
        f"true AS within_error FROM survey_answer WHERE survey_id IN {_S} "
        "AND survey_question_id IN (614, 615, 616) GROUP BY 1",
    "stream_latest_answer": duckdb_cte() +
        "SELECT survey_user_id, id, survey_question_id, data, created_at FROM survey_answer "
        "QUALIFY row_number() OVER (PARTITION BY survey_user_id ORDER BY created_at DESC NULLS FIRST, id DESC) = 1",
    "stream_enumerators_daily": duckdb_cte() +
        ", per AS (SELECT day, user_id, count(*)::BIGINT AS total_encuestas FROM (SELECT DISTINCT "
        f"CAST(created_at AS DATE) AS day, user_id, survey_user_id FROM survey_answer WHERE survey_id IN {_S}) GROUP BY 1, 2) "
        "SELECT per.*, (SELECT coalesce(first_name, '') || ' ' || coalesce(last_name, '') FROM auth_user u WHERE u.id = per.user_id) "
        "AS nombre_completo FROM per WHERE EXISTS (FROM auth_user u WHERE u.id = per.user_id)",
}

# over the corrected survey the batch SQL is the same
STREAM_ORACLE |= {f"{k}_changes": STREAM_ORACLE[k].replace(duckdb_cte(), corrected_cte())
                  for k in ("stream_sector_daily", "stream_submissions_daily", "stream_enumerators_daily", "stream_latest_answer")}
