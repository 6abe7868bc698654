"""Map tables: latest coordinates per submission, sector and person layers,
map layers, centre, zoom, sector polygons, density grid, GeoJSON features.

Everything stays a DataFrame; nothing is collected to draw a map.  The three
point tables are keyed by submission (``vivienda_id``) and hash-partitioned on
it by the latest-per-key step, so the left joins between them reuse that
partitioning instead of shuffling again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import nonzero_point
from ..functions.fields import field
from ..functions.text import is_digits, python_timestamp_text, to_decimal, to_int
from ..params import (CLOSE_ZOOM, DEFAULTS, HOUSEHOLD_RADIUS, MIN_POLYGON_POINTS,
                      PERSON_BASE_RADIUS, ZOOM_STEPS, SurveyParams)
from ..sources.sinks import geojson_feature
from .order import numbered

#: Parts of a sector's rows in the polygon join.
SALTS = 16


def _order():
    """Latest first: created_at DESC with NULL first (PostgreSQL DESC), then id DESC."""
    return F.struct(F.col("created_at").isNull().alias("n"), F.col("created_at").alias("c"),
                    F.col("id").alias("i"))


def household_profile(answers: DataFrame, submissions: DataFrame, params: SurveyParams = DEFAULTS,
                      parts=("sector", "persons")) -> DataFrame:
    """One row per household (submission) that has a coordinate answer:
    (vivienda_id, latitud, longitud, created_at[, sector][, total_personas]).

    The dashboard runs one ``DISTINCT ON`` subquery per attribute and left-joins
    them.  Here the latest coordinate, sector and persons answers come out of
    a single ``groupBy(survey_user_id)`` with one ``max_by`` per attribute (the
    value of the latest row among that attribute's rows): one scan, one
    shuffle, and map-side partial aggregation, so a submission with a third of
    all rows ships one partial row per task.  ``answers JOIN submissions`` only
    filters (``id`` is a key) and is applied last as a semi join on the same key.

    Missing sector stays NULL here (``sector_points`` labels it); missing persons
    stay NULL (``person_points`` makes it 0)."""
    q = F.col("survey_question_id")
    is_obj = field(answers, "value_is_object")
    lat = field(answers, "value_latitude")
    lon = field(answers, "value_longitude")
    is_coord = (q == params.coord_qid) & is_obj & lat.isNotNull() & lon.isNotNull()
    wanted = q == params.coord_qid
    cols = [F.col("survey_user_id"), is_coord.alias("_c"), _order().alias("_o"),
            F.when(is_coord, F.struct(to_decimal(lat, params.on_bad).alias("latitud"),
                                      to_decimal(lon, params.on_bad).alias("longitud"),
                                      F.col("created_at"))).alias("_coord")]
    aggs = [F.max_by("_coord", F.when(F.col("_c"), F.col("_o"))).alias("_coord")]
    if "sector" in parts:
        is_s = q.isin(*params.sector_qids)
        wanted = wanted | is_s
        sector = F.nullif(F.when(is_obj, field(answers, "value_label"))
                          .otherwise(field(answers, "value_text")), F.lit(""))
        cols += [is_s.alias("_s"), F.when(is_s, sector).alias("_sector")]
        aggs.append(F.max_by("_sector", F.when(F.col("_s"), F.col("_o"))).alias("sector"))
    if "persons" in parts:
        is_p = q == params.persons_qid
        wanted = wanted | is_p
        cols += [is_p.alias("_p"), F.when(is_p, persons_value(answers, params)).alias("_persons")]
        aggs.append(F.max_by("_persons", F.when(F.col("_p"), F.col("_o"))).alias("total_personas"))
    per = answers.where(wanted).select(*cols).groupBy("survey_user_id").agg(*aggs) \
        .where(F.col("_coord").isNotNull())
    subs = submissions.select(F.col("id").alias("survey_user_id"))
    per = per.join(subs, "survey_user_id", "left_semi")
    extra = [c for c in ("sector", "total_personas") if c in per.columns]
    return per.select(F.col("survey_user_id").alias("vivienda_id"), "_coord.latitud", "_coord.longitud",
                      "_coord.created_at", *extra)


def coordinate_points(answers: DataFrame, submissions: DataFrame,
                      params: SurveyParams = DEFAULTS) -> DataFrame:
    """Latest coordinate answer per submission: (vivienda_id, latitud, longitud, created_at).
    Only object values with both keys present; numbers as decimal(38,18)."""
    return household_profile(answers, submissions, params, parts=())


def persons_value(answers: DataFrame, params: SurveyParams = DEFAULTS):
    """Persons of a household: plain digits, else ``value.cantidad`` digits, else NULL."""
    v = field(answers, "value_text")
    cantidad = field(answers, "value_cantidad")
    return (F.when(field(answers, "value_has_key") & is_digits(v), to_int(v, params.on_bad))
            .when(field(answers, "value_is_object") & is_digits(cantidad), to_int(cantidad, params.on_bad)))


def sector_points(profile: DataFrame, params: SurveyParams = DEFAULTS) -> DataFrame:
    """Households with their latest sector; no sector -> 'SIN SECTOR'."""
    return profile.select("vivienda_id", "latitud", "longitud",
                          F.coalesce(F.col("sector"), F.lit(params.no_sector)).alias("sector"))


def person_points(profile: DataFrame) -> DataFrame:
    """Households with their latest persons count; none -> 0."""
    return profile.select("vivienda_id", "latitud", "longitud",
                          F.coalesce(F.col("total_personas"), F.lit(0)).alias("total_personas"))


def map_layers(profile: DataFrame, params: SurveyParams = DEFAULTS) -> DataFrame:
    """One row per drawn marker: (layer, vivienda_id, latitud, longitud, radius, label)
    for the household, sector and person layers.  Each household row is
    exploded into its three markers (a union of the layers without reading the
    profile three times).  Points with a NULL or zero coordinate are not drawn;
    sector markers have no radius."""
    vid = F.col("vivienda_id").cast("string")
    sector = F.coalesce(F.col("sector"), F.lit(params.no_sector))
    persons = F.coalesce(F.col("total_personas"), F.lit(0))
    marker = lambda layer, radius, label: F.struct(
        F.lit(layer).alias("layer"), radius.cast("int").alias("radius"), label.alias("label"))
    markers = F.array(
        marker("viviendas", F.lit(HOUSEHOLD_RADIUS),
               F.concat(F.lit("Vivienda "), vid, F.lit("<br>"), python_timestamp_text("created_at"))),
        marker("sectores", F.lit(None),
               F.concat(F.lit("Vivienda "), vid, F.lit("<br>Sector: "), sector)),
        marker("poblacion", F.lit(PERSON_BASE_RADIUS) + persons,
               F.concat(F.lit("Vivienda "), vid, F.lit("<br>Personas: "), persons.cast("string"))))
    return (profile.where(nonzero_point())
            .select("vivienda_id", "latitud", "longitud", F.explode(markers).alias("m"))
            .select("m.layer", "vivienda_id", "latitud", "longitud", "m.radius", "m.label"))


def _raw_mean(c):
    # exact decimal sum (order-independent), then one division in double
    return F.sum(c).cast("double") / F.count(c)


def _mean(c):
    # reported coordinates: 9 decimals (~0.1 mm), stable across engines
    return F.round(_raw_mean(c), 9)


def map_centre(coords: DataFrame, params: SurveyParams = DEFAULTS) -> DataFrame:
    """Mean of the non-zero latitudes and, separately, of the non-zero longitudes;
    (4.65, -74.1) when there is none.  One row, one pass."""
    lat = F.when(F.col("latitud") != 0, F.col("latitud"))
    lon = F.when(F.col("longitud") != 0, F.col("longitud"))
    clat, clon = params.default_centre
    return coords.agg(F.coalesce(_mean(lat), F.lit(clat)).alias("latitud"),
                      F.coalesce(_mean(lon), F.lit(clon)).alias("longitud"))


def map_zoom(points: DataFrame, params: SurveyParams = DEFAULTS) -> DataFrame:
    """Centre of all markers and a zoom from the largest distance to it.

    ``points`` are the households (decimal ``latitud``/``longitud``).  The page
    draws each one on three layers: all submissions and households, where a zero
    coordinate is not drawn, and sectors, without that test.  So a point counts
    once, or three times if neither coordinate is zero; markers are never made.
    Two partial aggregates: the centre (one value), then the distance to it."""
    drawn = nonzero_point()
    pts = points.where(F.col("latitud").isNotNull() & F.col("longitud").isNotNull())
    n = F.count(F.lit(1)) + 2 * F.count(F.when(drawn, 1))
    mean = lambda c: (F.sum(c).cast("double")
                      + 2 * F.coalesce(F.sum(F.when(drawn, F.col(c))).cast("double"), F.lit(0.0))) / n
    centre = pts.select(F.struct(mean("latitud").alias("a"), mean("longitud").alias("b"), n.alias("n"))).scalar()
    dlat_ = F.col("latitud").cast("double") - centre.getField("a")
    dlon_ = F.col("longitud").cast("double") - centre.getField("b")
    stats = pts.agg(F.round(F.max(F.sqrt(dlat_ * dlat_ + dlon_ * dlon_)), 9).alias("max_dist")).select(
        "max_dist", F.coalesce(centre.getField("n"), F.lit(0)).cast("bigint").alias("n_markers"),
        F.round(centre.getField("a"), 9).alias("clat"), F.round(centre.getField("b"), 9).alias("clon"))
    zoom = F.lit(CLOSE_ZOOM)
    for threshold, z in reversed(ZOOM_STEPS):
        zoom = F.when(F.col("max_dist") > threshold, F.lit(z)).otherwise(zoom)
    dlat, dlon = params.default_centre
    empty = F.col("n_markers") == 0
    return stats.select(
        "n_markers",
        F.when(empty, F.lit(dlat)).otherwise(F.col("clat")).alias("latitud"),
        F.when(empty, F.lit(dlon)).otherwise(F.col("clon")).alias("longitud"),
        "max_dist",
        F.when(empty, F.lit(params.default_zoom)).otherwise(zoom).cast("int").alias("zoom"))


def sector_polygons(sector_pts: DataFrame) -> DataFrame:
    """Vertices of the sectors that have at least 3 points, one row per vertex:
    (sector, vivienda_id, latitud, longitud, n_points); vertex order is
    ``vivienda_id``.  A long table instead of one array per sector, so a sector
    holding a third of all households never becomes one huge row.  Per-sector
    counts are pre-aggregated (one row per sector per task) and joined back on
    (sector, salt): each count is repeated per salt, so the households of a hot
    sector spread over SALTS tasks."""
    counts = (sector_pts.groupBy("sector").agg(F.count(F.lit(1)).cast("bigint").alias("n_points"))
              .where(F.col("n_points") >= MIN_POLYGON_POINTS)
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = sector_pts.withColumn("_salt", F.pmod(F.xxhash64("vivienda_id"), F.lit(SALTS)).cast("int"))
    return salted.join(counts, ["sector", "_salt"], "inner").select(
        "sector", "vivienda_id", "latitud", "longitud", "n_points")


def heat_points(person_pts: DataFrame) -> DataFrame:
    """Heat-map triples: (latitud, longitud, total_personas) of the drawn points."""
    return person_pts.where(nonzero_point()).select("latitud", "longitud", "total_personas")


def density_grid(person_pts: DataFrame, params: SurveyParams = DEFAULTS) -> DataFrame:
    """Heat-map / cluster re-aim: persons and points per grid cell.
    Cell index = floor(coordinate * cells_per_degree), exact in decimal."""
    cpd = params.cells_per_degree
    pts = person_pts.where(nonzero_point())
    return pts.groupBy(F.floor(F.col("latitud") * cpd).cast("bigint").alias("cell_lat"),
                       F.floor(F.col("longitud") * cpd).cast("bigint").alias("cell_lon")).agg(
        F.sum("total_personas").cast("bigint").alias("personas"),
        F.count(F.lit(1)).cast("bigint").alias("puntos"),
        _mean(F.col("latitud")).alias("centro_lat"),
        _mean(F.col("longitud")).alias("centro_lon"))


# --------------------------------------------------------------------------- GeoJSON

def feature_popups(features: DataFrame, *extra) -> DataFrame:
    """Feature properties as popup text ``<b>k:</b> v<br>...`` (map order):
    (feature_id, *extra, geometry_type, popup).  ``extra`` columns of the same
    feature (e.g. a property cast to its type) come along in the same
    projection, without joining back on ``feature_id``."""
    entries = F.map_entries(F.col("properties"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(
        F.lit("<b>"), e["key"], F.lit(":</b> "), F.coalesce(e["value"], F.lit("null")))), "<br>")
    return features.select("feature_id", *extra, F.col("geometry.type").alias("geometry_type"),
                           text.alias("popup"))


def feature_documents(points: DataFrame, properties: list[str], order: str, size: int = 50_000) -> DataFrame:
    """(page, text): the points as GeoJSON FeatureCollection documents of ``size``
    features, in the given order.  Points are numbered over ranges of the order and a
    document is gathered by its number, so no task holds more than its documents."""
    placed = numbered(points, order, name="_rank")
    features = F.sort_array(F.collect_list(F.struct("_rank", geojson_feature(properties).alias("f"))))
    pages = placed.groupBy((F.floor((F.col("_rank") - 1) / size) + 1).cast("bigint").alias("page")).agg(features.alias("_f"))
    document = F.struct(F.lit("FeatureCollection").alias("type"), F.transform("_f", lambda x: x["f"]).alias("features"))
    return pages.select("page", F.to_json(document, {"ignoreNullFields": "false"}).alias("text"))


def feature_bounds(features: DataFrame) -> DataFrame:
    """Bounding box of all feature coordinates (``getBounds``): one row
    (min_lat, min_lon, max_lat, max_lon).  Vertices are exploded first so the
    min/max run as partial aggregates, never one array in one task."""
    verts = features.select(F.explode("vertices").alias("v"))
    return verts.agg(F.min("v.lat").alias("min_lat"), F.min("v.lon").alias("min_lon"),
                     F.max("v.lat").alias("max_lat"), F.max("v.lon").alias("max_lon"))
