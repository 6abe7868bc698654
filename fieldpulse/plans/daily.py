"""Driver keys over kept daily tables (state of the reports, path profile): they are
built from the bridge's answers, and the reports read them alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import daily, profile
from ..operators.flatten import export_flat
from ..params import DEFAULTS
from ..session import checkpoint_root
from ..sources.bridge import RANGE_END, RANGE_START, bridge_tables, duckdb_cte
from ..sources.geojson import read_geojson
from ..sources.sinks import write_documents
from ..sources.tables import Tables
from . import oracle
from . import queries as Q

#: Two ranges that overlap in some days, for the households visited in both.
FIRST = (RANGE_START, "2024-01-15")
SECOND = ("2024-01-13", RANGE_END)


def _state(spark: SparkSession, sf_dir: str) -> tuple[daily.DailyState, Tables]:
    t = bridge_tables(spark, sf_dir)
    path = f"{checkpoint_root(spark)}/daily-{uuid.uuid4().hex}"
    daily.update_daily_state(t.answers, path)
    return daily.read_daily_state(spark, path), t


def enumerators_range_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, t = _state(spark, sf_dir)
    return daily.enumerators_range(state, t.users, RANGE_START, RANGE_END)


def submissions_range_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.submissions_range(_state(spark, sf_dir)[0], RANGE_START, RANGE_END)


def sectors_range_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.sectors_range(_state(spark, sf_dir)[0], RANGE_START, RANGE_END)


def _homes(t: Tables, start: str, end: str) -> DataFrame:
    a = t.answers.where(F.col("survey_id").isin(*DEFAULTS.survey_ids) & F.col("survey_question_id").isin(*DEFAULTS.household_qids)
                        & F.to_date("created_at").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return a.select(F.trim(F.get_json_object("data", "$.value")).alias("home")).where("home is not null").distinct()


def _within(estimate: str, exact: str) -> Column:
    """Three standard errors apart at most, or one where that is less than one."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1.0), 3 * F.col("error"))


def households_range_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact count beside the question whether the sketches' estimate lies within its bound."""
    state, t = _state(spark, sf_dir)
    exact = _homes(t, RANGE_START, RANGE_END).agg(F.count("*").alias("exact")).scalar()
    both = daily.households_range(state, RANGE_START, RANGE_END).withColumn("exact", exact)
    return both.select("exact", _within("estimate", "exact").alias("within_error"))


def households_shared_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households of two ranges, in both and in the first only, in the same way."""
    state, t = _state(spark, sf_dir)
    sides = _homes(t, *FIRST).withColumn("f", F.lit(1)).unionByName(_homes(t, *SECOND).withColumn("f", F.lit(2)))
    each = sides.groupBy("home").agg(F.sum("f").alias("f"))
    count = lambda *f: F.count(F.when(F.col("f").isin(*f), 1))
    exact = each.agg(count(1, 3).alias("n_first"), count(2, 3).alias("n_second"), count(3).alias("n_shared"),
                     count(1).alias("n_first_only"))
    both = daily.households_shared(state, FIRST, SECOND).withColumn("x", exact.select(F.struct("*")).scalar())
    names = ["first", "second", "shared", "first_only"]
    both = both.select("*", *[F.col(f"x.n_{n}").alias(f"n_{n}") for n in names])
    return both.select(*[f"n_{n}" for n in names], *[_within(n, f"n_{n}").alias(f"{n}_within_error") for n in names])


def export_all_profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole export, its columns taken from the kept path profile."""
    t = bridge_tables(spark, sf_dir)
    answers = t.answers.where(F.col("survey_id").isin(*DEFAULTS.survey_ids))
    path = f"{checkpoint_root(spark)}/paths-{uuid.uuid4().hex}"
    profile.update_path_profile(answers, path)
    return export_flat(answers, profile.known_paths(profile.read_path_profile(spark, path)))


def geojson_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households written as FeatureCollection documents, read back in byte ranges: the popups of all features."""
    path = f"{checkpoint_root(spark)}/geojson-{uuid.uuid4().hex}"
    write_documents(Q.household_documents(bridge_tables(spark, sf_dir)), path)
    return Q.household_popups(read_geojson(spark, path))


DAILY_QUERIES = {f.__name__: f for f in (enumerators_range_bitmap, submissions_range_bitmap, sectors_range_state,
                                         households_range_sketch, households_shared_sketch, export_all_profiled,
                                         geojson_documents)}


def _between(start: str, end: str) -> str:
    return f"survey_id IN {oracle.SURVEYS} AND CAST(created_at AS DATE) BETWEEN DATE '{start}' AND DATE '{end}'"


_RANGE = _between(RANGE_START, RANGE_END)
_HOME = f"SELECT DISTINCT trim(data->>'$.value') AS home FROM survey_answer WHERE survey_question_id IN {oracle.HOMES} AND "
DAILY_ORACLE = {
    "geojson_documents": oracle.ORACLE["geojson_features"],
    "export_all_profiled": oracle.ORACLE["export_all"],
    "enumerators_range_bitmap": oracle.ORACLE["enumerators_range"],
    "submissions_range_bitmap": duckdb_cte() +
        f"SELECT count(DISTINCT survey_user_id)::BIGINT AS total_encuestas FROM survey_answer WHERE {_RANGE}",
    "sectors_range_state": duckdb_cte() +
        "SELECT data->>'$.value' AS sector, count(*)::BIGINT AS total FROM survey_answer "
        f"WHERE {_RANGE} AND survey_question_id IN {oracle.SECTORS} GROUP BY 1",
    "households_range_sketch": duckdb_cte() + f"SELECT count(home)::BIGINT AS exact, true AS within_error FROM ({_HOME}{_RANGE})",
    "households_shared_sketch": duckdb_cte() +
        f", a AS ({_HOME}{_between(*FIRST)}), b AS ({_HOME}{_between(*SECOND)}) "
        "SELECT (SELECT count(home) FROM a)::BIGINT AS n_first, (SELECT count(home) FROM b)::BIGINT AS n_second, "
        "(SELECT count(home) FROM a SEMI JOIN b USING (home))::BIGINT AS n_shared, "
        "(SELECT count(home) FROM a ANTI JOIN b USING (home))::BIGINT AS n_first_only, "
        "true AS first_within_error, true AS second_within_error, true AS shared_within_error, true AS first_only_within_error",
}
