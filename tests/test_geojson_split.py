"""One FeatureCollection document read by many tasks; nested collections of any depth."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators.geo import feature_bounds
from fieldpulse.sources.geojson import features_from_text, read_geojson


def _feature(rng, i):
    texts = ["}", "{", "]}", '"', '\\"', "\\", "a\\\\", '"features": [{', 'x","features":[{"y', "é日😀", "line\nbreak", "", "},{"]
    props = {f"k{k}": rng.choice([rng.choice(texts), i, None, {"a": [1, {"b": rng.choice(texts)}]}, [{"features": [{"z": 1}]}]])
             for k in range(rng.randrange(4))}
    point = lambda: [rng.randrange(-180, 180) / 2, rng.randrange(-90, 90) / 2]
    ring = [point() for _ in range(4)]
    geometry = rng.choice([
        None, {"type": "Point", "coordinates": point()}, {"type": "Point", "coordinates": [*point(), 250.5]},
        {"type": "LineString", "coordinates": ring}, {"type": "Polygon", "coordinates": [ring, ring[:3]]},
        {"coordinates": [[ring]], "type": "MultiPolygon"}, {"type": "MultiPoint", "coordinates": []},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": point()}, {"type": "LineString", "coordinates": ring}]}])
    out = {"type": "Feature", "properties": props, "geometry": geometry}
    if rng.random() < 0.3:
        out["id"] = i
    keys = list(out)
    rng.shuffle(keys)
    return {k: out[k] for k in keys}


def _plain(r):
    """A feature with its nested JSON texts parsed: the readers keep different white space in them."""
    def parsed(t):
        try:
            return json.loads(t)
        except (TypeError, ValueError):
            return t
    geometry = r.geometry and [parsed(v) for v in r.geometry]
    return r.feature_id, r.properties and {k: parsed(v) for k, v in r.properties.items()}, geometry, r.vertices


def _same(spark, path, **conf):
    for k, v in conf.items():
        spark.conf.set(k.replace("_", "."), v)
    try:
        many = read_geojson(spark, path)
        got = sorted(many.collect(), key=lambda r: r.feature_id)
    finally:
        for k in conf:
            spark.conf.unset(k.replace("_", "."))
    want = sorted(read_geojson(spark, path, split=False).collect(), key=lambda r: r.feature_id)
    assert [_plain(r) for r in got] == [_plain(r) for r in want]
    return got


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("block", ["300", "4000"])
def test_many_tasks_read_what_one_reads(spark, tmp_path, indent, block):
    rng = random.Random(8)
    features = [_feature(rng, i) for i in range(120)]
    head = {"type": "FeatureCollection", "name": 'a "features": [{ b', "crs": {"type": "name", "properties": {"name": "x"}},
            "other": [{"features": [{"no": 1}]}, {"type": "x"}], "bbox": [1, 2, 3, 4]}
    tail = {"made": {"by": [{"type": "y"}]}, "more": [{"type": "z"}, {}]}
    (tmp_path / "a.geojson").write_text(json.dumps(head | {"features": features} | tail, indent=indent, ensure_ascii=False))
    (tmp_path / "b.geojson").write_text(json.dumps({"features": features[:3], "type": "FeatureCollection"}, indent=indent) + "\n")
    (tmp_path / "c.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    got = _same(spark, str(tmp_path), spark_sql_files_maxPartitionBytes=block, spark_sql_files_openCostInBytes="0")
    assert len(got) == 123


def test_more_tasks_than_one(spark, tmp_path):
    rng = random.Random(9)
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [_feature(rng, i) for i in range(300)]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert read_geojson(spark, str(tmp_path)).count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_feature_larger_than_a_byte_range(spark, tmp_path):
    big = {"type": "Feature", "properties": {"t": "}{" * 3000},
           "geometry": {"type": "LineString", "coordinates": [[i / 10, 1] for i in range(500)]}}
    small = {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [7, 8]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [small, big, small]}))
    got = _same(spark, str(tmp_path), spark_sql_files_maxPartitionBytes="1000", spark_sql_files_openCostInBytes="0")
    assert [len(r.vertices) for r in got] == [1, 500, 1]


def test_collections_nested_deeper_than_any_limit(spark):
    def nest(depth):
        if not depth:
            return {"type": "Point", "coordinates": [-60.5, 40.25]}
        return {"type": "GeometryCollection", "geometries": [nest(depth - 1), {"type": "Point", "coordinates": [depth, -depth]}]}

    rows = [(d, json.dumps({"type": "Feature", "properties": {}, "geometry": nest(d)})) for d in (0, 1, 4, 12, 60)]
    feats = features_from_text(spark.createDataFrame(rows, "id int, text string"), "text", "id")
    assert {r.feature_id: len(r.vertices) for r in feats.collect()} == {str(d): d + 1 for d, _ in rows}
    b = feature_bounds(feats).first()
    assert tuple(b) == (-60.0, -60.5, 40.25, 60.0)


def test_numbers_and_missing_geometry(spark):
    rows = [("1", '{"type":"Feature","properties":null,"geometry":null}'), ("2", '{"type":"Feature"}'), ("3", None),
            ("4", '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5e1, -2E-1, 9]}}'),
            ("5", '{"type":"Feature","geometry":{"type":"Point","coordinates":[]}}')]
    feats = features_from_text(spark.createDataFrame(rows, "id string, text string"), "text", "id")
    got = {r.feature_id: r.vertices and [tuple(v) for v in r.vertices] for r in feats.collect()}
    assert got == {"1": None, "2": None, "3": None, "4": [(-0.2, 15.0)], "5": []}
    assert feats.select(F.explode("vertices")).count() == 1


def test_documents_are_written_by_many_tasks_and_read_back(spark, tmp_path):
    from fieldpulse.operators.geo import feature_documents
    from fieldpulse.sources.sinks import write_documents
    points = spark.range(230).selectExpr("id AS vivienda_id", "cast(id / 10 as decimal(12,6)) AS latitud",
                                         "cast(-id / 4 as decimal(12,6)) AS longitud", "concat('S}\"', id % 7) AS sector").repartition(4)
    documents = feature_documents(points, ["vivienda_id", "sector"], "vivienda_id", size=50)
    write_documents(documents, f"{tmp_path}/d")
    files = [f for f in (tmp_path / "d").iterdir() if f.name.startswith("part-")]
    loaded = sorted((json.loads(f.read_text()) for f in files), key=lambda d: d["features"][0]["properties"]["vivienda_id"])
    assert [len(d["features"]) for d in loaded] == [50, 50, 50, 50, 30]
    assert [f["properties"]["vivienda_id"] for d in loaded for f in d["features"]] == list(range(230))
    back = read_geojson(spark, f"{tmp_path}/d")
    got = {int(r.properties["vivienda_id"]): (r.properties["sector"], tuple(r.vertices[0])) for r in back.collect()}
    assert got == {i: (f'S}}"{i % 7}', (i / 10, -i / 4)) for i in range(230)}
    assert feature_documents(points.where("false"), ["vivienda_id"], "vivienda_id").count() == 0
