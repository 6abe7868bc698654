"""The three survey tables and their readers (parquet, catalog table, JDBC)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("survey_id", T.IntegerType()),
    T.StructField("survey_user_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("survey_question_id", T.LongType()),
    T.StructField("data", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

SUBMISSION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("survey_id", T.IntegerType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

USER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
])

ANSWER_COLUMNS = [f.name for f in ANSWER_SCHEMA.fields]


@dataclass(frozen=True)
class Tables:
    """Answers (one row per answer, JSON ``data``), submissions, users."""
    answers: DataFrame
    submissions: DataFrame
    users: DataFrame


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns the queries use; extra columns are pruned."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def read_parquet(spark: SparkSession, answers: str, submissions: str, users: str) -> Tables:
    return Tables(
        _conform(spark.read.parquet(answers), ANSWER_SCHEMA),
        _conform(spark.read.parquet(submissions), SUBMISSION_SCHEMA),
        _conform(spark.read.parquet(users), USER_SCHEMA),
    )


def read_catalog(spark: SparkSession, answers: str = "survey_answer",
                 submissions: str = "survey_surveyuser", users: str = "auth_user") -> Tables:
    return Tables(
        _conform(spark.table(answers), ANSWER_SCHEMA),
        _conform(spark.table(submissions), SUBMISSION_SCHEMA),
        _conform(spark.table(users), USER_SCHEMA),
    )


def read_jdbc(spark: SparkSession, url: str, properties: dict, *, answer_bounds: tuple[int, int],
              num_partitions: int, submission_bounds: tuple[int, int] | None = None,
              answers: str = "survey_answer", submissions: str = "survey_surveyuser",
              users: str = "auth_user") -> Tables:
    """Parallel JDBC read: answers and submissions are each split on their own
    ``id`` range (``answer_bounds``, ``submission_bounds``; typically
    ``SELECT min(id), max(id)`` of each table) into ``num_partitions`` and
    ``num_partitions // 4`` ranges, so no single task pulls a whole table.
    Rows outside the bounds are still read (by the first and last ranges), so
    stale bounds cost balance, never rows.  Without ``submission_bounds`` the
    answers' bounds are used.  URL and credentials come from the caller;
    nothing is stored here.  Date filters applied later on ``created_at`` are
    pushed to the database; JSON extraction is done in Spark (JDBC does not
    push it)."""
    lo, hi = answer_bounds
    slo, shi = submission_bounds or answer_bounds
    ans = spark.read.jdbc(url, answers, column="id", lowerBound=lo, upperBound=hi,
                          numPartitions=num_partitions, properties=properties)
    sub = spark.read.jdbc(url, submissions, column="id", lowerBound=slo, upperBound=shi,
                          numPartitions=max(1, num_partitions // 4), properties=properties)
    usr = spark.read.jdbc(url, users, properties=properties)
    return Tables(_conform(ans, ANSWER_SCHEMA), _conform(sub, SUBMISSION_SCHEMA),
                  _conform(usr, USER_SCHEMA))


# --------------------------------------------------------------------------- day-partitioned answers

def write_answer_table(answers: DataFrame, path: str, mode: str = "overwrite",
                       max_records_per_file: int = 5_000_000, parsed: bool = False) -> None:
    """Write answers as parquet partitioned by ``created_date``.

    No shuffle: each task sorts its own rows by day and writes one file per day
    it holds (an append-ordered source gives each task one or two days).  A day
    with a third of all rows is therefore written by many tasks, never one;
    ``max_records_per_file`` caps file size.  Day and range queries on the result
    prune to the folders of their dates.

    ``parsed=True`` also stores the answer fields (``functions.fields``) as
    columns: the JSON is parsed once here, and the dashboard queries on the
    table read those narrow columns instead of parsing ``data`` on every
    refresh (``data`` stays for the export)."""
    if parsed:
        from ..functions.fields import parse_fields
        answers = parse_fields(answers)
    (answers.withColumn("created_date", F.to_date("created_at"))
     .sortWithinPartitions("created_date", "survey_user_id")
     .write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("created_date").parquet(path))


def read_answer_table(spark: SparkSession, path: str, submissions: DataFrame, users: DataFrame) -> Tables:
    """Tables over a day-partitioned answers table (keeps ``created_date`` for
    pruning, and the stored answer fields when the table was written parsed)."""
    from ..functions.fields import FIELD_NAMES
    raw = spark.read.parquet(path)
    cols = [raw[f.name].cast(f.dataType).alias(f.name) for f in ANSWER_SCHEMA.fields]
    cols += [raw[n] for n in FIELD_NAMES if n in raw.columns]
    return Tables(raw.select(*cols, F.col("created_date").cast("date").alias("created_date")),
                  submissions, users)


# --------------------------------------------------------------------------- co-located answers and submissions

#: Suffixes of the tables that ``write_colocated`` makes.
ANSWERS, SUBMISSIONS = "answers", "submissions"


def write_colocated(answers: DataFrame, submissions: DataFrame, name: str, buckets: int, path: str | None = None,
                    mode: str = "overwrite", parsed: bool = False) -> None:
    """Catalog tables ``name_answers`` and ``name_submissions``, both dealt by the
    submission into ``buckets`` buckets and sorted by it.

    Whatever is worked out per submission (the households of the map, the latest
    answers, the wide rows, the joins with submissions) then needs no shuffle of
    answers: Spark reads a bucket of each table in one task.  Choose ``buckets`` so
    that a bucket's narrow columns fit a task (some 1 GB of answers); a submission
    is always in one bucket.  A task writes one file per bucket that it holds, so
    the rows are dealt by the submission once, here, and appended loads
    (``mode="append"``) add a file per bucket.  Files go under ``path`` or into the
    warehouse."""
    if parsed:
        from ..functions.fields import parse_fields
        answers = parse_fields(answers)
    for df, kind, key in ((answers, ANSWERS, "survey_user_id"), (submissions, SUBMISSIONS, "id")):
        w = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
        if path:
            w = w.option("path", f"{path.rstrip('/')}/{kind}")
        w.saveAsTable(f"{name}_{kind}")


def read_colocated(spark: SparkSession, name: str, users: DataFrame) -> Tables:
    """The tables of ``write_colocated``, with the stored answer fields when written parsed."""
    from ..functions.fields import FIELD_NAMES
    raw = spark.table(f"{name}_{ANSWERS}")
    cols = [raw[f.name].cast(f.dataType).alias(f.name) for f in ANSWER_SCHEMA.fields]
    return Tables(raw.select(*cols, *[raw[n] for n in FIELD_NAMES if n in raw.columns]),
                  _conform(spark.table(f"{name}_{SUBMISSIONS}"), SUBMISSION_SCHEMA), users)
