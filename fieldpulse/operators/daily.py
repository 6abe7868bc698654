"""Daily state: what the range reports need of a day, small and mergeable.

A report over any range of dates is a merge of its days, so it reads the days'
state and no answers:

* ``submissions``: the submissions of each (day, survey, enumerator) as bitmaps
  of 32,768 consecutive ids each, exact: the bits of a range are the OR of its
  days' bits (A3, A5, F2);
* ``sectors``: answers of each (day, survey, question, sector), which add up (A5);
* ``households``: an HLL and a theta sketch of the trimmed household answers of
  each (day, survey), of fixed size: unions of any days (A4, T3), and by theta
  sketches also the households that two ranges share.

The state is parquet partitioned by day.  ``update_daily_state`` replaces whole
days, so a repeated or late load is harmless; on a day-partitioned answers table it
reads only the folders of those days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import field
from ..functions.filters import in_ids, require_range, where_range
from ..functions.text import full_name
from ..params import DEFAULTS, SurveyParams

#: 2^LG_K registers of an HLL sketch and entries of a theta sketch.
LG_K = 14
#: Standard errors of the sketches: of an HLL union, and of a theta sketch relative to the union it is taken from.
HLL_ERROR = 1.04 / 2 ** (LG_K / 2)
THETA_ERROR = 1.0 / 2 ** (LG_K / 2)

SCHEMAS = {
    "submissions": "survey_id INT, user_id BIGINT, bucket BIGINT, bits BINARY, day DATE",
    "sectors": "survey_id INT, survey_question_id BIGINT, sector STRING, total BIGINT, day DATE",
    "households": "survey_id INT, hll BINARY, theta BINARY, day DATE",
}


@dataclass(frozen=True)
class DailyState:
    submissions: DataFrame
    sectors: DataFrame
    households: DataFrame


def daily_frames(answers: DataFrame, params: SurveyParams = DEFAULTS) -> dict[str, DataFrame]:
    """The state's tables from answers.  All are partial aggregations: a hot day,
    survey or enumerator ships one row per task and bitmap.  Undated answers
    belong to no day."""
    a = answers.where(F.col("created_at").isNotNull()).withColumn("day", F.to_date("created_at"))
    sid, question, text = F.col("survey_user_id"), F.col("survey_question_id"), field(answers, "value_text")
    bits = a.where(sid.isNotNull()).groupBy("day", "survey_id", "user_id", F.bitmap_bucket_number(sid).alias("bucket"))
    sectors = a.where(question.isin(*params.sector_qids)).groupBy("day", "survey_id", "survey_question_id", text.alias("sector"))
    home = F.trim(text)
    homes = a.where(question.isin(*params.household_qids)).groupBy("day", "survey_id")
    return {
        "submissions": bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position(sid)).alias("bits")),
        "sectors": sectors.agg(F.count(F.lit(1)).alias("total")),
        "households": homes.agg(F.hll_sketch_agg(home, LG_K).alias("hll"), F.theta_sketch_agg(home, LG_K).alias("theta")),
    }


def _folder(path: str, table: str) -> str:
    return f"{path.rstrip('/')}/{table}"


def update_daily_state(answers: DataFrame, path: str, days: Iterable | None = None, params: SurveyParams = DEFAULTS) -> None:
    """Replace the state of ``days`` (all days that ``answers`` has when not given)
    by that of ``answers``.  A given day without answers left loses its state."""
    wanted = None if days is None else sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)) for d in days})
    if wanted == []:
        return
    rows = answers if wanted is None else where_range(answers, wanted[0], wanted[-1]).where(F.to_date("created_at").isin(wanted))
    for table, df in daily_frames(rows, params).items():
        if wanted:  # only written folders are replaced, so each given day writes a row, be it an empty one
            given = answers.sparkSession.createDataFrame([(d,) for d in wanted], "day date")
            df = df.unionByName(given, allowMissingColumns=True)
        schema = T.StructType.fromDDL(SCHEMAS[table])
        (df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(_folder(path, table)))


def read_daily_state(spark: SparkSession, path: str) -> DailyState:
    return DailyState(**{t: spark.read.schema(s).parquet(_folder(path, t)) for t, s in SCHEMAS.items()})


def _days(df: DataFrame, start, end, params: SurveyParams) -> DataFrame:
    s, e = require_range(start, end)
    return df.where(F.col("day").between(F.lit(s), F.lit(e)) & in_ids("survey_id", params.survey_ids))


def _bits_of(state: DailyState, start, end, params: SurveyParams, *keys: str) -> DataFrame:
    each = _days(state.submissions, start, end, params).where("bits is not null").groupBy(*keys, "bucket")
    return each.agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))


def enumerators_range(state: DailyState, users: DataFrame, start, end, params: SurveyParams = DEFAULTS) -> DataFrame:
    """Distinct submissions per enumerator in [start, end], exact, from the days' bitmaps."""
    n = _bits_of(state, start, end, params, "user_id").groupBy("user_id").agg(F.sum("n").cast("bigint").alias("total_encuestas"))
    u = users.select(F.col("id").alias("user_id"), full_name("first_name", "last_name").alias("nombre_completo"))
    return n.join(u, "user_id").select(F.col("user_id").alias("censista_id"), "nombre_completo", "total_encuestas") \
        .orderBy(F.desc("total_encuestas"), "censista_id")


def submissions_range(state: DailyState, start, end, params: SurveyParams = DEFAULTS) -> DataFrame:
    """Distinct submissions in [start, end], exact."""
    return _bits_of(state, start, end, params).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_encuestas"))


def sectors_range(state: DailyState, start, end, params: SurveyParams = DEFAULTS) -> DataFrame:
    """Answers per sector in [start, end], exact; NULL sector is a group."""
    rows = _days(state.sectors, start, end, params).where("total is not null")
    return rows.groupBy("sector").agg(F.sum("total").cast("bigint").alias("total"))


def households_range(state: DailyState, start, end, params: SurveyParams = DEFAULTS) -> DataFrame:
    """Estimate of the distinct household answers in [start, end] and its standard error."""
    union = _days(state.households, start, end, params).agg(F.hll_union_agg("hll").alias("u"))
    n = F.coalesce(F.hll_sketch_estimate("u"), F.lit(0)).cast("bigint")
    return union.select(n.alias("estimate"), (n * HLL_ERROR).alias("error"))


def _theta(state: DailyState, start, end, params: SurveyParams) -> Column:
    days = _days(state.households, start, end, params).where("theta is not null")
    return days.agg(F.theta_union_agg("theta", LG_K).alias("t")).scalar()


def households_shared(state: DailyState, first: tuple, second: tuple, params: SurveyParams = DEFAULTS) -> DataFrame:
    """Estimates of the distinct household answers of two ranges of dates, of
    those in both (households visited again) and in the first only, and the
    standard error of these, which goes with the size of both ranges' union."""
    row = state.households.sparkSession.range(1).select(_theta(state, *first, params).alias("a"), _theta(state, *second, params).alias("b"))
    size = lambda c: F.coalesce(F.theta_sketch_estimate(c), F.lit(0)).cast("bigint")
    union = F.coalesce(F.theta_union("a", "b", F.lit(LG_K)), "a", "b")  # null: a range without days
    return row.select(size(F.col("a")).alias("first"), size(F.col("b")).alias("second"), 
                      size(F.theta_intersection("a", "b")).alias("shared"),
                      size(F.coalesce(F.theta_difference("a", "b"), "a")).alias("first_only"),
                      (size(union) * THETA_ERROR).alias("error"))
