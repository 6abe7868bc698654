"""Structured Streaming form of the polled dashboards (the pages re-run their
queries every 10-15 s; here the same indicators are kept current incrementally).

Every answer counts, however late: no watermark, so a day stays open and a late
answer corrects its row, as re-running the query would.  Answers without a
``created_at`` belong to no day (as in the day queries) and are left out of the
daily indicators.

State (RocksDB on a cluster, see ``session.CLUSTER_SETTINGS``): T1 one row per
(day, sector), T2 one per (day, submission), T3 one fixed-size sketch per day,
T4 one per submission, T5 one per (day, enumerator, submission).  Answers that
are edited or deleted need ``changes``, whose counts are tables instead of state.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import in_ids
from ..functions.fields import FIELD_NAMES, field, parse_fields
from ..functions.text import full_name
from ..params import DEFAULTS, SurveyParams
from ..session import checkpoint_root
from ..sources.tables import ANSWER_SCHEMA
from .runs import RunStore, Table, last_row


def read_answer_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                       fields: bool = False) -> DataFrame:
    """Answers arriving as parquet files under ``path`` (schema fixed, never
    inferred).  ``fields=True`` reads files written with the parsed answer
    fields (``functions.fields``) as well, so the streams use them instead of
    parsing ``data`` again."""
    schema = ANSWER_SCHEMA
    if fields:
        typed = parse_fields(spark.createDataFrame([], ANSWER_SCHEMA)).schema
        schema = T.StructType(ANSWER_SCHEMA.fields + [typed[n] for n in FIELD_NAMES])
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def _dated(answers: DataFrame) -> DataFrame:
    return answers.where(F.col("created_at").isNotNull()).withColumn("day", F.to_date("created_at"))


def sector_daily(answers: DataFrame, params: SurveyParams = DEFAULTS) -> DataFrame:
    """T1: answers per (day, sector) for the survey set; NULL sector is a group."""
    a = answers.where(in_ids("survey_id", params.survey_ids) & in_ids("survey_question_id", params.sector_qids))
    return _dated(a).groupBy("day", field(a, "value_text").alias("sector")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("total"))


def submissions_daily(answers: DataFrame, params: SurveyParams = DEFAULTS) -> DataFrame:
    """T2: exact distinct submissions per day (dedup on (submission, day), then count)."""
    a = _dated(answers.where(in_ids("survey_id", params.survey_ids)))
    return a.dropDuplicates(["survey_user_id", "day"]).groupBy("day") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("total_encuestas"))


def households_daily_approx(answers: DataFrame, params: SurveyParams = DEFAULTS, rsd: float = 0.05) -> DataFrame:
    """T3: approximate distinct trimmed household answers per day (HyperLogLog++;
    state is a fixed-size sketch per day, whatever the number of households)."""
    a = answers.where(in_ids("survey_id", params.survey_ids) & in_ids("survey_question_id", params.household_qids))
    return _dated(a).groupBy("day").agg(
        F.approx_count_distinct(F.trim(field(a, "value_text")), rsd).cast("bigint").alias("total_viviendas"))


def latest_answer(answers: DataFrame) -> DataFrame:
    """T4: latest answer per submission (created_at DESC with NULL first, then id DESC)."""
    order = F.struct(F.col("created_at").isNull().alias("n"), F.col("created_at").alias("c"), F.col("id").alias("i"))
    row = F.struct("id", "survey_question_id", "data", "created_at")
    g = answers.groupBy("survey_user_id").agg(F.max_by(row, order).alias("r"))
    return g.select("survey_user_id", "r.id", "r.survey_question_id", "r.data", "r.created_at")


def enumerators_daily(answers: DataFrame, users: DataFrame, params: SurveyParams = DEFAULTS) -> DataFrame:
    """T5: distinct submissions per (day, enumerator) with names.  Stream-static
    inner join with the users table first (stateless), then dedup and count."""
    u = users.select(F.col("id").alias("user_id"), full_name("first_name", "last_name").alias("nombre_completo"))
    a = _dated(answers.where(in_ids("survey_id", params.survey_ids)).join(u, "user_id", "inner"))
    return a.dropDuplicates(["user_id", "survey_user_id", "day"]) \
        .groupBy("day", "user_id", "nombre_completo") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("total_encuestas"))


# --------------------------------------------------------------------------- output

@dataclass
class LiveTable:
    """An indicator stream and its output: ``query`` (stop it with
    ``query.stop()``) and ``view()``, the current result, read fresh on every call."""
    query: StreamingQuery
    store: RunStore

    def view(self) -> DataFrame:
        """The last written row of each key.  The store keeps fewer than twice as
        many rows as there are keys, however many batches there were."""
        return self.store.read("log").drop("_batch")


def start_live(stream: DataFrame, keys: list[str], name: str, *, every: str = "10 seconds",
               root: str | None = None, trigger: dict | None = None) -> LiveTable:
    """Start ``stream`` in update mode (by default with a processing-time trigger:
    a micro-batch at the pages' cadence, and only when new answers arrived).

    ``name`` under ``root`` (the shared checkpoint folder when not given) is the
    table: ``<root>/streams/<name>/checkpoint`` and ``.../store``, a ``RunStore`` of the
    rows that each micro-batch updated.  Starting the same name again resumes
    from its checkpoint and reads only new files.  A batch that is retried counts once."""
    spark = stream.sparkSession
    base = f"{root or checkpoint_root(spark)}/streams/{name}"
    log = Table(T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())]), keys, last_row(keys))

    def write(batch: DataFrame, batch_id: int):
        own = RunStore(batch.sparkSession, f"{base}/store", {"log": log})
        if not own.has(batch_id):
            own.commit(batch_id, {"log": own.write("log", batch.withColumn("_batch", F.lit(batch_id)))})

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(**(trigger or {"processingTime": every}))
         .queryName(f"{name}_{uuid.uuid4().hex[:8]}").start())
    return LiveTable(q, RunStore(spark, f"{base}/store", {"log": log}))


def run_to_table(stream: DataFrame, keys: list[str], name: str, *, root: str | None = None) -> DataFrame:
    """Process what has arrived since the last run of ``name``, stop, and return the current view."""
    live = start_live(stream, keys, name, root=root, trigger={"availableNow": True})
    live.query.awaitTermination()
    return live.view()
