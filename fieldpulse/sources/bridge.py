"""Bridge views: give the driver's ``events`` and ``customer`` tables the
shapes of the survey tables (answers, submissions, users).

The expressions are SQL text so that the Spark side and the DuckDB oracle use
one definition; only the JSON key extraction differs between the engines.
Four consecutive events form one submission; survey 99 is out of scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ANSWER_COLUMNS, SUBMISSION_SCHEMA, Tables

SPARK_K = "get_json_object(props, '$.k')"
DUCKDB_K = "(props->>'$.k')"

# Fixed values of the bridge (FIXTURES.md section 3).
AS_OF = "2024-01-18"
RANGE_START = "2024-01-10"
RANGE_END = "2024-01-20"

BASE_SELECT = ["event_id", "ts", "event_type", "event_id - event_id % 4 AS sid", "CAST({k} AS INT) AS k"]

ANSWER_EXPRS = [
    "CAST(event_id AS BIGINT) AS id",
    "CAST(CASE sid % 20 WHEN 0 THEN 18 WHEN 4 THEN 30 WHEN 8 THEN 31 WHEN 12 THEN 18"
    " ELSE 99 END AS INT) AS survey_id",
    "CAST(sid AS BIGINT) AS survey_user_id",
    "CAST(sid % 150 AS BIGINT) AS user_id",
    "CAST(CASE event_type WHEN 'click' THEN 614 + k % 3 WHEN 'error' THEN 55"
    " WHEN 'purchase' THEN (CASE WHEN k % 2 = 0 THEN 600 ELSE 100 END)"
    " WHEN 'signup' THEN 477 ELSE 863 END AS BIGINT) AS survey_question_id",
    """CASE event_type
    WHEN 'click' THEN '{"value": "' || (CASE WHEN k % 3 = 0 THEN ' V-' ELSE 'V-' END) || CAST(k AS STRING) || '"}'
    WHEN 'error' THEN (CASE WHEN k % 10 = 0 THEN '{"value": ""}'
      ELSE '{"value": {"latitude": "4.' || CAST(k AS STRING) || '", "longitude": "-74.' || CAST(k AS STRING) || '"}}' END)
    WHEN 'purchase' THEN (CASE WHEN k % 11 = 0 THEN '{"value": "n/a"}'
      WHEN k % 5 = 0 THEN '{"value": {"cantidad": "' || CAST(k % 7 AS STRING) || '"}}'
      ELSE '{"value": "' || CAST(k % 7 AS STRING) || '"}' END)
    WHEN 'signup' THEN (CASE WHEN k % 17 = 0 THEN '{"value": null}'
      WHEN k % 13 = 0 THEN '{"value": {"label": "S' || CAST(k AS STRING) || '"}}'
      ELSE '{"value": "' || CAST(k % 12 AS STRING) || '"}' END)
    ELSE (CASE WHEN k % 4 = 0 THEN '{"value": ""}' WHEN k % 9 = 0 THEN '{}'
      ELSE '{"value": "' || CAST(k % 12 AS STRING) || '"}' END) END AS data""",
    "ts AS created_at",
]

SUBMISSION_SQL = ("SELECT survey_user_id AS id, min(survey_id) AS survey_id, min(user_id) AS user_id,"
                  " min(created_at) AS created_at FROM survey_answer GROUP BY survey_user_id")

USER_EXPRS = [
    "CAST(c_custkey AS BIGINT) AS id",
    "CAST(c_name AS STRING) AS username",
    "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS first_name",
    "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS last_name",
]


# The corrected survey: some answers are edited (some on a later day), some deleted.
EDITED = "id % 7 = 3"
DELETED = "id % 11 = 5"
EDIT_EXPRS = {
    "data": f"CASE WHEN {EDITED} AND survey_question_id IN (477, 863)"
            """ THEN '{"value": "C' || CAST(id % 5 AS STRING) || '"}' ELSE data END""",
    "created_at": f"CASE WHEN {EDITED} THEN created_at + INTERVAL 2 DAY ELSE created_at END",
}


def answer_sql(k_expr: str, events: str = "events") -> str:
    base = ", ".join(BASE_SELECT).format(k=k_expr)
    return f"SELECT {', '.join(ANSWER_EXPRS)} FROM (SELECT {base} FROM {events}) e"


def user_sql(customer: str = "customer") -> str:
    return f"SELECT {', '.join(USER_EXPRS)} FROM {customer}"


def duckdb_cte() -> str:
    """``WITH`` clause defining the three survey tables for the DuckDB oracle."""
    return ("WITH survey_answer AS (" + answer_sql(DUCKDB_K) + "), "
            "survey_surveyuser AS (" + SUBMISSION_SQL + "), "
            "auth_user AS (" + user_sql() + ") ")


def corrected_cte() -> str:
    """The same three tables with the corrections in ``survey_answer``."""
    cols = ", ".join(f"{EDIT_EXPRS.get(c, c)} AS {c}" for c in ANSWER_COLUMNS)
    base = duckdb_cte().replace("WITH survey_answer AS", "WITH first_answer AS", 1).replace(
        "FROM survey_answer GROUP BY", "FROM first_answer GROUP BY", 1)
    return base + f", survey_answer AS (SELECT {cols} FROM first_answer WHERE NOT ({DELETED})) "


def changes_from_answers(answers: DataFrame, arrivals: int) -> DataFrame:
    """The change feed (before, after, arrival) that ends in the corrected
    survey.  Changes of an answer arrive independently: an edit may come before its insert."""
    edited = answers.selectExpr("*", *[f"{e} AS new_{c}" for c, e in EDIT_EXPRS.items()])
    first = F.struct(*ANSWER_COLUMNS)
    last = F.struct(*[F.col(f"new_{c}" if c in EDIT_EXPRS else c).alias(c) for c in ANSWER_COLUMNS])
    none = F.lit(None).cast(answers.select(first.alias("a")).schema["a"].dataType)

    def change(kept: str, before: Column, after: Column, order: str) -> Column:
        arrival = F.expr(f"cast(pmod({order}, {arrivals}) as int)").alias("arrival")
        return F.when(F.expr(kept), F.struct(before.alias("before"), after.alias("after"), arrival))

    each = F.array(change("true", none, first, "id"), change(EDITED, first, last, "id div 3"),
                   change(DELETED, last, none, "id div 2"))
    return edited.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.*")


def _cast(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


# columns of the driver tables the bridge reads (explicit, so no footer inference)
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, props STRING"
CUSTOMER_SCHEMA = "c_custkey BIGINT, c_name STRING, c_mktsegment STRING"


def answers_from_events(events: DataFrame) -> DataFrame:
    base = events.selectExpr(*[s.format(k=SPARK_K) for s in BASE_SELECT])
    return base.selectExpr(*ANSWER_EXPRS)


def submissions_from_answers(answers: DataFrame) -> DataFrame:
    sub = answers.groupBy("survey_user_id").agg(
        F.min("survey_id").alias("survey_id"),
        F.min("user_id").alias("user_id"),
        F.min("created_at").alias("created_at"),
    ).withColumnRenamed("survey_user_id", "id")
    return _cast(sub, SUBMISSION_SCHEMA)


def users_from_customer(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(*USER_EXPRS)


def bridge_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Survey tables derived from ``events`` and ``customer`` under ``sf_dir``."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.schema(CUSTOMER_SCHEMA).parquet(f"{sf_dir}/customer.parquet")
    answers = answers_from_events(events)
    return Tables(answers, submissions_from_answers(answers), users_from_customer(customer))
