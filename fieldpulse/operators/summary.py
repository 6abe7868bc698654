"""Per-submission tables: summary (answers, first and last answer) and the wide
row (household, sector, persons)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.text import full_name
from ..params import DEFAULTS, SurveyParams


def submission_summary(answers: DataFrame, users: DataFrame) -> DataFrame:
    """One row per submission: survey, enumerator (id, login, name), number of
    answers, first and last answer time.  Partial aggregation per task, then a
    shuffle on the submission id; enumerators without a user row keep NULL names."""
    per = answers.groupBy("survey_user_id").agg(
        F.min("survey_id").alias("survey_id"),
        F.min("user_id").alias("usuario_id"),
        F.count(F.lit(1)).cast("bigint").alias("total_preguntas"),
        F.min("created_at").alias("primera_respuesta"),
        F.max("created_at").alias("ultima_respuesta"))
    u = users.select(F.col("id").alias("usuario_id"), F.col("username").alias("usuario_login"),
                     full_name("first_name", "last_name").alias("usuario_nombre"))
    return per.join(u, "usuario_id", "left").select(
        "survey_user_id", "survey_id", "usuario_id", "usuario_login", "usuario_nombre",
        "total_preguntas", "primera_respuesta", "ultima_respuesta")


def _latest_value(cond, value):
    """Value of the latest row (created_at DESC with NULL first, then id DESC)
    among rows where ``cond`` holds; the value may itself be NULL."""
    order = F.struct(F.col("created_at").isNull(), F.col("created_at"), F.col("id"))
    return F.max_by(value, F.when(cond, order))


def submission_wide(answers: DataFrame, params: SurveyParams = DEFAULTS) -> DataFrame:
    """One wide row per submission that answered a household, sector or persons
    question: the latest answer text of each.  A single aggregation with
    ``max_by`` (map-side partial), so a submission with many answers costs one
    partial row per task."""
    q = F.col("survey_question_id")
    is_h = q.isin(*params.household_qids)
    is_s = q.isin(*params.sector_qids)
    is_p = q.isin(params.persons_qid, params.persons_text_qid)
    sector = F.nullif(F.when(field(answers, "value_is_object"), field(answers, "value_label"))
                      .otherwise(field(answers, "value_text")), F.lit(""))
    text = field(answers, "value_text")
    return (answers.where(is_h | is_s | is_p)
            .groupBy("survey_user_id").agg(
                F.min("survey_id").alias("survey_id"),
                _latest_value(is_h, F.trim(text)).alias("vivienda"),
                _latest_value(is_s, sector).alias("sector"),
                _latest_value(is_p, text).alias("persona")))
