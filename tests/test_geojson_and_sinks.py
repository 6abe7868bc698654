import json
import os
import tempfile

from fieldpulse.operators.flatten import export_flat
from fieldpulse.operators.geo import feature_bounds, feature_popups
from fieldpulse.plans import queries as Q
from fieldpulse.sources.bridge import AS_OF, bridge_tables
from fieldpulse.sources.geojson import read_geojson
from fieldpulse.sources.sinks import with_created_date, write_export, write_payload

FC = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"name": "A", "n": 3},
     "geometry": {"type": "Polygon", "coordinates": [[[-74.1, 4.6], [-74.0, 4.6], [-74.0, 4.7], [-74.1, 4.6]]]}},
    {"type": "Feature", "properties": {"name": "B"}, "geometry": {"type": "Point", "coordinates": [-73.9, 4.8]}},
    {"type": "Feature", "properties": {},
     "geometry": {"type": "MultiPolygon", "coordinates": [[[[-75.0, 4.0], [-74.9, 4.0], [-74.9, 4.1], [-75.0, 4.0]]]]}}]}


def test_feature_collection(spark):
    d = tempfile.mkdtemp(prefix="gj-")
    with open(os.path.join(d, "m.geojson"), "w") as f:
        json.dump(FC, f, indent=2)
    feats = read_geojson(spark, d)
    assert feats.count() == 3
    pops = {r["geometry_type"]: r["popup"] for r in feature_popups(feats).collect()}
    assert pops["Polygon"] == "<b>name:</b> A<br><b>n:</b> 3" and pops["MultiPolygon"] == ""
    b = feature_bounds(feats).collect()[0]
    assert (b["min_lat"], b["min_lon"], b["max_lat"], b["max_lon"]) == (4.0, -75.0, 4.8, -73.9)


def test_feature_sequence(spark):
    d = tempfile.mkdtemp(prefix="gjs-")
    with open(os.path.join(d, "m.geojsonl"), "w") as f:
        for feat in FC["features"]:
            f.write(json.dumps(feat) + "\n")
    feats = read_geojson(spark, d, sequence=True)
    assert feats.count() == 3
    assert feature_bounds(feats).collect()[0]["max_lat"] == 4.8


def test_export_and_payload_written_in_parallel(spark):
    t = bridge_tables(spark, "/root/testdata/sf0.001")
    out = tempfile.mkdtemp(prefix="exp-")
    exp = with_created_date(export_flat(Q._answers(t, Q.DEFAULTS)))
    write_export(exp, out + "/csv", "csv", partition_by=["created_date"])
    back = spark.read.option("header", True).csv(out + "/csv")
    assert back.count() == exp.count()
    write_export(exp, out + "/pq", "parquet")
    assert spark.read.parquet(out + "/pq").count() == exp.count()
    write_payload(Q.dashboard_today(t, as_of=AS_OF), out + "/payload")
    line = spark.read.text(out + "/payload").collect()[0][0]
    assert set(json.loads(line)) == {"kpis", "censistas", "sectores", "convenciones"}


def test_geometry_collections_are_in_the_bounds(spark, tmp_path):
    from fieldpulse.operators.geo import feature_bounds
    from fieldpulse.sources.geojson import read_geojson
    point = lambda x, y: '{"type": "Point", "coordinates": [%s, %s]}' % (x, y)
    inner = '{"type": "GeometryCollection", "geometries": [%s]}' % point(60, 50)
    outer = '{"type": "GeometryCollection", "geometries": [%s, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, %s]}' % (point(-5, 6), inner)
    lines = ['{"type": "Feature", "properties": {"a": 1}, "geometry": %s}' % g for g in (outer, point(0, 0))]
    (tmp_path / "f.json").write_text("\n".join(lines) + '\n{"type": "Feature", "properties": {}, "geometry": null}\n')
    feats = read_geojson(spark, str(tmp_path), sequence=True)
    assert feats.count() == 3
    b = feature_bounds(feats).first()
    assert (b.min_lat, b.min_lon, b.max_lat, b.max_lon) == (0.0, -5.0, 50.0, 60.0)


def test_households_written_and_read_back(spark, tmp_path):
    from fieldpulse.plans import queries as Q
    from fieldpulse.sources.bridge import bridge_tables
    from fieldpulse.sources.geojson import read_geojson
    from fieldpulse.sources.sinks import write_geojson_points
    t = bridge_tables(spark, "/root/testdata/sf0.001")
    write_geojson_points(Q.household_sector_points(t), str(tmp_path / "h"), ["vivienda_id", "sector"])
    back = read_geojson(spark, str(tmp_path / "h"), sequence=True)
    got = {(int(r.properties["vivienda_id"]), r.properties["sector"], r.vertices[0].lat) for r in back.collect()}
    assert got == {(r.vivienda_id, r.sector, float(r.latitud)) for r in Q.household_sector_points(t).collect()}
