"""The composed dashboard queries, each a pure function of the three tables.

Signature: ``key(tables, *, as_of=None, start=None, end=None, params=DEFAULTS)``.
``as_of=None`` means today in ``params.zone``; pass a date for a fixed day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import in_ids, where_day, where_range
from ..functions.fields import field
from ..functions.text import digits_only, to_int
from ..operators import geo, kpis, zoom
from ..operators.flatten import export_flat
from ..operators.latest import latest_per_key
from ..operators.payload import dashboard_payload, list_pages, list_payload, value_payload
from ..operators.summary import submission_summary as _summary
from ..operators.summary import submission_wide as _wide
from ..params import DEFAULTS, HOUSEHOLD_PAYLOAD_QID, SurveyParams
from ..sources.geojson import features_from_text
from ..sources.sinks import geojson_text, scratch_table
from ..sources.tables import ANSWER_COLUMNS, Tables


def _answers(t: Tables, params: SurveyParams, as_of=None, day: bool = False) -> DataFrame:
    a = t.answers.where(in_ids("survey_id", params.survey_ids))
    return _day(a, as_of, params) if day else a


def _day(df: DataFrame, as_of, params: SurveyParams) -> DataFrame:
    return where_day(df, as_of, zone=params.zone)


# ------------------------------------------------------------------ today page

def submissions_today(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Submissions created on the day, no survey filter; NULL survey not counted."""
    return kpis.count_non_null(_day(t.submissions, as_of, params), "survey_id", "total_encuestas")


def households_today(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    a = _answers(t, params, as_of, day=True).where(in_ids("survey_question_id", params.household_qids))
    return kpis.count_distinct(a, F.trim(field(a, "value_text")), "total_viviendas")


def sectors_today(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    a = _answers(t, params, as_of, day=True).where(in_ids("survey_question_id", params.sector_qids))
    return kpis.group_count(a, field(a, "value_text"), "sector", "total")


def enumerators_today(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return kpis.enumerator_counts(_answers(t, params, as_of, day=True), t.users, "convencion")


def dashboard_today(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    kw = dict(as_of=as_of, params=params)
    row = kpis.answer_kpis(_answers(t, params, as_of, day=True), params.household_qids, params.sector_qids)
    return dashboard_payload(row, sectors_today(t, **kw), enumerators_today(t, **kw), "convencion",
                             params.payload_list, total=submissions_today(t, **kw))


# ------------------------------------------------------------------ all-time page

def submissions_all(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return kpis.count_distinct(_answers(t, params), F.col("survey_user_id"), "total_encuestas")


def households_all(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    a = _answers(t, params).where(in_ids("survey_question_id", params.household_qids))
    return kpis.count_distinct(a, F.trim(field(a, "value_text")), "total_viviendas")


def sectors_all(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    a = _answers(t, params).where(in_ids("survey_question_id", params.sector_qids))
    return kpis.group_count(a, field(a, "value_text"), "sector", "total")


def enumerators_all(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return kpis.enumerator_counts(_answers(t, params), t.users, "user_id")


def dashboard_all(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    row = kpis.answer_kpis(_answers(t, params), params.household_qids, params.sector_qids)
    return dashboard_payload(row, sectors_all(t, params=params), enumerators_all(t, params=params), "user_id",
                             params.payload_list)


def enumerators_all_ranked(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """The all-time enumerators with their place in the page's order."""
    return kpis.ranked(enumerators_all(t, params=params), F.desc("total_encuestas"), "user_id")


def enumerators_all_pages(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Every page of the all-time enumerators, ``params.page_size`` entries each."""
    rows = enumerators_all(t, params=params)
    return list_pages(rows, "censistas", rows.columns, [F.desc("total_encuestas"), F.col("user_id")], params.page_size)


def sectors_all_pages(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Every page of the all-time sectors."""
    rows = sectors_all(t, params=params)
    return list_pages(rows, "sectores", rows.columns, [F.col("sector").asc_nulls_first()], params.page_size)


# ------------------------------------------------------------------ report by date range

def enumerators_range(t: Tables, *, start=None, end=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Distinct submissions per enumerator in [start, end] (dates, both inclusive).
    Both bounds are required: ValueError before any plan is built."""
    return kpis.enumerator_counts(where_range(_answers(t, params), start, end), t.users, "censista_id")


def range_payload(t: Tables, *, start=None, end=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """The report's answer: ``{"resultados": [...]}``."""
    rows = enumerators_range(t, start=start, end=end, params=params)
    return list_payload(rows, "resultados", rows.columns, [F.desc("total_encuestas"), F.col("censista_id")],
                        params.payload_list)


# ------------------------------------------------------------------ export

def export_all(t: Tables, *, params: SurveyParams = DEFAULTS, paths=None, **_) -> DataFrame:
    return export_flat(_answers(t, params), paths)


def export_today(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, paths=None, **_) -> DataFrame:
    return export_flat(_answers(t, params, as_of, day=True), paths)


def preview_50(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """The first ``params.preview_size`` answers of the survey set by id (the page's
    preview).  The ids come from a top-k over the narrow columns; the rows are
    then read by a pushed filter on them, so ``data`` is read for those only."""
    top = _answers(t, params).select("id").orderBy("id").limit(params.preview_size)
    ids = [r.id for r in top.collect()]
    rows = _answers(t, params).where(F.col("id").isin(ids)) if ids else _answers(t, params).limit(0)
    return rows.select(*ANSWER_COLUMNS).orderBy("id").limit(params.preview_size)


def preview_columns(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> list[str]:
    """Column names of the preview, as the page lists them."""
    return list(ANSWER_COLUMNS)


# ------------------------------------------------------------------ joined ("realtime") variants

def _subs_in(t: Tables, ids) -> DataFrame:
    return t.submissions.where(in_ids("survey_id", ids)).select(F.col("id").alias("survey_user_id"))


def submissions_today_joined(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Distinct submissions answered on the day whose submission is in the survey set.
    Precondition: ``submissions.id`` is unique, so an inner join only filters and
    either side may be built: the day's distinct ids, not all submissions."""
    day = _day(t.answers, as_of, params).select("survey_user_id")
    ids = day.distinct().join(_subs_in(t, params.survey_ids), "survey_user_id")
    return ids.agg(F.count(F.lit(1)).cast("bigint").alias("total_encuestas"))


def sectors_rollup_today(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Distinct submissions per sector answer on the day, plus the grand total
    (labelled like the NULL group; ``level`` = 1 marks it).  No survey filter."""
    a = _day(t.answers, as_of, params).where(in_ids("survey_question_id", params.sector_qids))
    return kpis.rollup_distinct(a, field(a, "value_text"), "survey_user_id", params.no_sector)


def households_today_joined(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Distinct (untrimmed) household answers on the day, submissions of the joined set."""
    a = _day(t.answers, as_of, params).where(in_ids("survey_question_id", params.household_qids))
    a = a.join(_subs_in(t, params.joined_survey_ids), "survey_user_id")
    return kpis.count_distinct(a, field(a, "value_text"), "total_viviendas")


def persons_today(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Sum over submissions of the digits in the latest free-text persons answer
    of the day; no digits -> not counted; no rows -> 0."""
    a = _day(t.answers, as_of, params).where(F.col("survey_question_id") == params.persons_text_qid)
    a = a.select("id", "survey_user_id", "created_at", F.trim(field(a, "value_text")).alias("v"))
    latest = latest_per_key(a, "survey_user_id").join(_subs_in(t, params.joined_survey_ids), "survey_user_id")
    n = to_int(F.nullif(digits_only("v"), F.lit("")), params.on_bad)
    return latest.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_personas"))


def enumerators_today_joined(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    day = _day(t.answers, as_of, params)
    return kpis.enumerator_counts_joined(day, t.submissions, t.users, params.joined_survey_ids)


def sectors_rollup_ranked(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """The rollup with the place of each row in the page's order."""
    return kpis.ranked(sectors_rollup_today(t, as_of=as_of, params=params), "sector", "level", "total_encuestas")


def sectors_payload(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """``{"pregunta_id": ..., "sectores": [{sector, total}]}`` of the rollup."""
    rows = sectors_rollup_today(t, as_of=as_of, params=params).withColumnRenamed("total_encuestas", "total")
    return list_payload(rows, "sectores", ["sector", "total"], [F.col("sector"), F.col("level"), F.col("total")],
                        params.payload_list, pregunta_id=params.sector_qids[0])


def submissions_payload(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return value_payload(submissions_today_joined(t, as_of=as_of, params=params))


def households_payload(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return value_payload(households_today_joined(t, as_of=as_of, params=params), pregunta_id=HOUSEHOLD_PAYLOAD_QID)


def persons_payload(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return value_payload(persons_today(t, as_of=as_of, params=params))


def enumerators_payload(t: Tables, *, as_of=None, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """``{"encuestas": [...]}``: submissions per user of the day."""
    rows = enumerators_today_joined(t, as_of=as_of, params=params)
    return list_payload(rows, "encuestas", rows.columns, [F.desc("total_encuestas_hoy"), F.col("usuario_id")],
                        params.payload_list)


# ------------------------------------------------------------------ map tables

def household_points(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return geo.coordinate_points(t.answers, t.submissions, params)


def household_sector_points(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    prof = geo.household_profile(t.answers, t.submissions, params, parts=("sector",))
    return geo.sector_points(prof, params)


def household_person_points(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    prof = geo.household_profile(t.answers, t.submissions, params, parts=("persons",))
    return geo.person_points(prof)


def map_layers(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return geo.map_layers(geo.household_profile(t.answers, t.submissions, params), params)


def map_centre(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return geo.map_centre(geo.coordinate_points(t.answers, t.submissions, params), params)


def map_zoom(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Zoom over all drawn markers (submissions, households and sectors)."""
    return geo.map_zoom(geo.coordinate_points(t.answers, t.submissions, params), params)


def sector_polygons(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """The points are written once: they are counted per sector and joined with the counts."""
    return geo.sector_polygons(scratch_table(household_sector_points(t, params=params), "sector-points"))


def person_density_grid(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return geo.density_grid(household_person_points(t, params=params), params)


def density_pyramid(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Household clusters of the map at every zoom."""
    return zoom.density_pyramid(household_person_points(t, params=params))


def heat_kernel(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """The heat layer at the zooms that the page opens with."""
    return zoom.heat_kernel(household_person_points(t, params=params), params.heat_zooms, radius=params.heat_radius,
                            blur=params.heat_blur)


def heat_points(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return geo.heat_points(household_person_points(t, params=params))


def _household_geojson(t: Tables, params: SurveyParams) -> DataFrame:
    """Households as GeoJSON feature texts, parsed as the GeoJSON source does."""
    text = _households(t, params).select("vivienda_id", geojson_text(HOUSEHOLD_PROPERTIES).alias("text"))
    return features_from_text(text, "text", "vivienda_id")


#: Properties of a household's feature.
HOUSEHOLD_PROPERTIES = ["vivienda_id", "sector", "personas"]


def _households(t: Tables, params: SurveyParams) -> DataFrame:
    prof = geo.household_profile(t.answers, t.submissions, params)
    return prof.select("vivienda_id", "latitud", "longitud",
                       F.coalesce("sector", F.lit(params.no_sector)).alias("sector"),
                       F.coalesce("total_personas", F.lit(0)).alias("personas"))


def household_documents(t: Tables, *, params: SurveyParams = DEFAULTS, size: int = 50_000) -> DataFrame:
    """Households as GeoJSON FeatureCollection documents (for ``sinks.write_documents``)."""
    return geo.feature_documents(_households(t, params), HOUSEHOLD_PROPERTIES, "vivienda_id", size)


def geojson_features(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Household features with their popup text (``<b>key:</b> value<br>...``)."""
    return household_popups(_household_geojson(t, params))


def household_popups(features: DataFrame) -> DataFrame:
    vid = F.col("properties")["vivienda_id"].cast("bigint").alias("vivienda_id")
    return geo.feature_popups(features, vid).select("vivienda_id", "geometry_type", "popup")


def geojson_bounds(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    """Bounding box of the household features."""
    return geo.feature_bounds(_household_geojson(t, params))


# ------------------------------------------------------------------ per-submission tables

def submission_summary(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return _summary(t.answers, t.users)


def submission_wide(t: Tables, *, params: SurveyParams = DEFAULTS, **_) -> DataFrame:
    return _wide(t.answers, params)


BATCH_QUERIES = {
    "submissions_today": submissions_today,
    "households_today": households_today,
    "sectors_today": sectors_today,
    "enumerators_today": enumerators_today,
    "dashboard_today": dashboard_today,
    "submissions_all": submissions_all,
    "households_all": households_all,
    "sectors_all": sectors_all,
    "enumerators_all": enumerators_all,
    "dashboard_all": dashboard_all,
    "enumerators_all_ranked": enumerators_all_ranked,
    "enumerators_all_pages": enumerators_all_pages,
    "sectors_all_pages": sectors_all_pages,
    "range_payload": range_payload,
    "enumerators_range": enumerators_range,
    "export_all": export_all,
    "export_today": export_today,
    "preview_50": preview_50,
    "submissions_today_joined": submissions_today_joined,
    "sectors_rollup_today": sectors_rollup_today,
    "households_today_joined": households_today_joined,
    "persons_today": persons_today,
    "enumerators_today_joined": enumerators_today_joined,
    "sectors_rollup_ranked": sectors_rollup_ranked,
    "sectors_payload": sectors_payload,
    "enumerators_payload": enumerators_payload,
    "submissions_payload": submissions_payload,
    "households_payload": households_payload,
    "persons_payload": persons_payload,
    "household_points": household_points,
    "household_sector_points": household_sector_points,
    "household_person_points": household_person_points,
    "map_layers": map_layers,
    "map_centre": map_centre,
    "map_zoom": map_zoom,
    "sector_polygons": sector_polygons,
    "person_density_grid": person_density_grid,
    "density_pyramid": density_pyramid,
    "heat_kernel": heat_kernel,
    "heat_points": heat_points,
    "geojson_features": geojson_features,
    "geojson_bounds": geojson_bounds,
    "submission_summary": submission_summary,
    "submission_wide": submission_wide,
}
