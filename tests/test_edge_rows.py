"""Edge rows of FIXTURES.md section 4, exact expected output."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from survey_rows import D, ts
from fieldpulse.operators import geo
from fieldpulse.operators.flatten import export_flat, leaf_paths
from fieldpulse.operators.latest import latest_per_key
from fieldpulse.params import SurveyParams
from fieldpulse.plans import queries as Q


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_sector_null_missing_empty_and_label_groups(make):
    data = ['{"value": null}', '{}', '{"value": ""}', '{"value": {"label": "S1"}}', '{"value": "A"}', '{"value": "A"}']
    t = make.tables([(i, 18, 10 + i, 1, 477, d, ts()) for i, d in enumerate(data)])
    got = dict(((r["sector"], r["total"]) for r in Q.sectors_today(t, as_of=D).collect()))
    assert got == {None: 2, "": 1, '{"label":"S1"}': 1, "A": 2}
    dash = Q.dashboard_today(t, as_of=D).collect()[0]
    assert dash["total_sectores"] == 4            # the NULL group counts
    # the label is used only by the latest-sector rule
    prof = geo.household_profile(t.answers, t.submissions)
    assert prof.count() == 0                      # no coordinates -> no household rows
    lat = geo.sector_points  # noqa: F841 (covered in test_latest_sector_label)


def test_latest_sector_label_and_default(make):
    coord = '{"value": {"latitude": "4.5", "longitude": "-74.5"}}'
    t = make.tables([
        (1, 18, 100, 1, 55, coord, ts(h=8)), (2, 18, 100, 1, 477, '{"value": {"label": "S1"}}', ts(h=9)),
        (3, 18, 101, 1, 55, coord, ts(h=8)), (4, 18, 101, 1, 863, '{"value": ""}', ts(h=9)),
        (5, 18, 102, 1, 55, coord, ts(h=8)),
    ])
    got = rows(Q.household_sector_points(t), "vivienda_id", "sector")
    assert got == [(100, "S1"), (101, "SIN SECTOR"), (102, "SIN SECTOR")]


def test_households_trim_and_tab(make):
    vals = ['{"value": " V-1 "}', '{"value": "V-1"}', '{"value": "V-1\\t"}']
    t = make.tables([(i, 18, 10 + i, 1, 614, v, ts()) for i, v in enumerate(vals)])
    assert Q.households_today(t, as_of=D).collect()[0][0] == 2          # trim: " V-1 " == "V-1"; tab kept
    assert Q.households_today_joined(t, as_of=D).collect()[0][0] == 3   # no trim


def test_names_null_forms(make):
    ans = [(1, 18, 100, 2, 614, '{"value": "a"}', ts()), (2, 18, 101, 3, 614, '{"value": "b"}', ts())]
    users = [(2, "u2", None, None), (3, "u3", "x", None)]
    t = make.tables(ans, users=users)
    assert rows(Q.enumerators_today(t, as_of=D), "convencion", "nombre_completo") == [(2, " "), (3, "x ")]
    assert rows(Q.enumerators_today_joined(t, as_of=D), "usuario_id", "usuario_nombre") == [(2, None), (3, None)]


def test_day_is_half_open_and_range_inclusive(make):
    t = make.tables([
        (1, 18, 100, 1, 614, '{"value": "a"}', ts(0, 0, 0, 0)),
        (2, 18, 101, 1, 614, '{"value": "b"}', ts(0, 23, 59, 59, 999999)),
        (3, 18, 102, 1, 614, '{"value": "c"}', ts(1, 0, 0, 0)),
        (4, 18, 103, 1, 614, '{"value": "d"}', ts(-1, 23, 59, 59, 999999)),
    ])
    assert Q.households_today(t, as_of=D).collect()[0][0] == 2
    assert Q.enumerators_range(t, start=D, end=D).collect()[0]["total_encuestas"] == 2
    assert Q.enumerators_range(t, start=D - dt.timedelta(1), end=D + dt.timedelta(1)).collect()[0][2] == 4
    assert Q.enumerators_range(t, start=D + dt.timedelta(1), end=D).count() == 0   # start > end: empty
    with pytest.raises(ValueError):
        Q.enumerators_range(t, start=D, end=None)


def test_latest_null_first_then_larger_id(spark):
    df = spark.createDataFrame([(1, 7, ts()), (2, 7, ts()), (3, 7, None), (4, 8, ts()), (5, 8, ts())],
                               "id long, k long, created_at timestamp_ntz")
    got = rows(latest_per_key(df, "k"), "k", "id")
    assert got == [(7, 3), (8, 5)]


def test_coordinates_zero_null_string_and_bad(make):
    def c(lat, lon):
        return '{"value": {"latitude": "%s", "longitude": "%s"}}' % (lat, lon)
    ans = [
        (1, 18, 100, 1, 55, c("0", "-74.1"), ts()),                        # zero: kept as a point, not drawn
        (2, 18, 101, 1, 55, '{"value": {"longitude": "-74.1"}}', ts()),    # NULL latitude: not a point
        (3, 18, 102, 1, 55, '{"value": "4.1,-74.1"}', ts()),               # not an object
        (4, 18, 103, 1, 55, c("4.25", "-74.5"), ts()),
    ]
    t = make.tables(ans)
    assert rows(Q.household_points(t), "vivienda_id") == [(100,), (103,)]
    layers = Q.map_layers(t).collect()
    assert {r["vivienda_id"] for r in layers} == {103} and len(layers) == 3
    centre = Q.map_centre(t).collect()[0]
    assert (centre["latitud"], centre["longitud"]) == (4.25, -74.3)    # zero latitude skipped, longitudes both
    bad = make.tables(ans + [(5, 18, 104, 1, 55, c("abc", "-74"), ts())])
    with pytest.raises(Exception):
        Q.household_points(bad).collect()
    got = rows(Q.household_points(bad, params=SurveyParams(on_bad="null")), "vivienda_id", "latitud")
    assert (104, None) in got


def test_persons_rules_and_overflow(make):
    vals = ['"3"', '{"cantidad": "4"}', '"n/a"', '"2.5"', '"-3"', '"12 personas"']
    coord = '{"value": {"latitude": "4.5", "longitude": "-74.5"}}'
    ans = []
    for i, v in enumerate(vals):
        sid = 100 + i
        ans.append((10 * i + 1, 18, sid, 1, 55, coord, ts(h=8)))
        ans.append((10 * i + 2, 18, sid, 1, 100, '{"value": %s}' % v, ts(h=9)))
        ans.append((10 * i + 3, 18, sid, 1, 600, '{"value": %s}' % v, ts(h=9)))
    t = make.tables(ans)
    got = rows(Q.household_person_points(t), "vivienda_id", "total_personas")
    assert got == [(100, 3), (101, 4), (102, 0), (103, 0), (104, 0), (105, 0)]
    # free-text rule: digits only; "2.5" -> 25, "-3" -> 3, "12 personas" -> 12, "n/a" not counted;
    # an object value's text is its JSON, whose digits count: {"cantidad":"4"} -> 4
    assert Q.persons_today(t, as_of=D).collect()[0][0] == 3 + 4 + 25 + 3 + 12
    over = make.tables(ans + [(999, 18, 200, 1, 600, '{"value": "99999999999"}', ts())])
    with pytest.raises(Exception):
        Q.persons_today(over, as_of=D).collect()
    assert Q.persons_today(over, as_of=D, params=SurveyParams(on_bad="null")).collect()[0][0] == 47


def test_flatten_shapes_and_no_clash(make):
    datas = [None, "{}", "not json", '"s"', '{"a": {"b": {"c": 1}}}', '{"t": [1, 2]}', '{"id": 5}',
             '{"value": "x"}', '{"value": {"latitude": "4.1"}}']
    t = make.tables([(i, 18, 100 + i, 1, 1, d, ts()) for i, d in enumerate(datas)])
    paths = leaf_paths(t.answers)
    assert paths == [("a", "b", "c"), ("id",), ("t",), ("value",), ("value", "latitude")]
    out = export_flat(t.answers)
    assert [c for c in out.columns if c.startswith("data.")] == [
        "data.a.b.c", "data.id", "data.t", "data.value", "data.value.latitude"]
    got = {r["id"]: r for r in out.collect()}
    assert got[4]["data.a.b.c"] == "1" and got[6]["data.id"] == "5" and got[6]["id"] == 6
    assert got[5]["data.t"] == "[1,2]"
    assert got[7]["data.value"] == "x" and got[7]["data.value.latitude"] is None
    assert got[8]["data.value"] is None and got[8]["data.value.latitude"] == "4.1"
    assert all(got[i]["data.value"] is None for i in (0, 1, 2, 3))



def test_flatten_deep_nesting_and_mixed_kinds(make):
    deep = "1"
    for k in reversed([f"k{i}" for i in range(20)]):
        deep = '{"%s": %s}' % (k, deep)
    datas = [deep, '{"value": "x"}', '{"value": {"label": "S1"}}', '{"value": {}}', '{"value": []}']
    t = make.tables([(i, 18, 100 + i, 1, 1, d, ts()) for i, d in enumerate(datas)])
    paths = leaf_paths(t.answers, levels=4)     # 20 levels: what lies deeper is walked on
    assert paths == [tuple(f"k{i}" for i in range(20)), ("value",), ("value", "label")]
    out = {r["id"]: r for r in export_flat(t.answers, paths).collect()}
    assert out[0]["data." + ".".join(f"k{i}" for i in range(20))] == "1"
    assert out[1]["data.value"] == "x" and out[2]["data.value.label"] == "S1"
    assert out[3]["data.value"] is None and out[4]["data.value"] == "[]"

def test_survey_outside_set_and_missing_user(make):
    ans = [(1, 99, 100, 1, 614, '{"value": "a"}', ts()), (2, 18, 101, 9, 614, '{"value": "b"}', ts()),
           (3, 30, 102, 1, 614, '{"value": "c"}', ts())]
    t = make.tables(ans, users=[(1, "u1", "A", "B")])
    assert Q.submissions_all(t).collect()[0][0] == 2
    assert rows(Q.enumerators_all(t), "user_id", "total_encuestas") == [(1, 1)]   # user 9 dropped by the join


def test_no_rows_on_the_day(make):
    t = make.tables([(1, 18, 100, 1, 614, '{"value": "a"}', ts(-3))])
    dash = Q.dashboard_today(t, as_of=D).collect()[0]
    assert (dash["total_encuestas"], dash["total_viviendas"], dash["total_sectores"]) == (0, 0, 0)
    assert '"censistas":[]' in dash["payload"] and '"sectores":[]' in dash["payload"]
    assert Q.persons_today(t, as_of=D).collect()[0][0] == 0
    c = Q.map_centre(t).collect()[0]
    assert (c["latitud"], c["longitud"]) == (4.65, -74.1)
    z = Q.map_zoom(t).collect()[0]
    assert (z["n_markers"], z["latitud"], z["longitud"], z["zoom"]) == (0, 4.65, -74.1, 8)


def test_sector_polygon_needs_three_points(make):
    ans = []
    for i, sec in enumerate(["A", "A", "B", "B", "B"]):
        sid = 100 + i
        ans.append((10 * i + 1, 18, sid, 1, 55, '{"value": {"latitude": "4.%d", "longitude": "-74.%d"}}' % (i + 1, i + 1), ts(h=8)))
        ans.append((10 * i + 2, 18, sid, 1, 477, '{"value": "%s"}' % sec, ts(h=9)))
    t = make.tables(ans)
    got = rows(Q.sector_polygons(t), "sector", "vivienda_id", "n_points")
    assert got == [("B", 102, 3), ("B", 103, 3), ("B", 104, 3)]


def test_rollup_total_shares_label(make):
    ans = [(1, 18, 100, 1, 477, '{"value": "A"}', ts()), (2, 18, 100, 1, 863, '{"value": "B"}', ts()),
           (3, 18, 101, 1, 477, '{"value": null}', ts()), (4, 18, 102, 1, 477, '{"value": "A"}', ts())]
    t = make.tables(ans)
    got = rows(Q.sectors_rollup_today(t, as_of=D), "sector", "total_encuestas", "level")
    assert got == [("A", 2, 0), ("B", 1, 0), ("SIN SECTOR", 1, 0), ("SIN SECTOR", 3, 1)]


def test_zoom_buckets(spark):
    def zoom(pts):
        df = spark.createDataFrame(pts, "latitud decimal(38,18), longitud decimal(38,18)")
        return geo.map_zoom(df).collect()[0]["zoom"]
    from decimal import Decimal as Dm
    assert zoom([(Dm("4.0"), Dm("-74.0")), (Dm("5.2"), Dm("-74.0"))]) == 8     # max dist 0.6
    assert zoom([(Dm("4.0"), Dm("-74.0")), (Dm("4.4"), Dm("-74.0"))]) == 11    # 0.2
    assert zoom([(Dm("4.0"), Dm("-74.0")), (Dm("4.12"), Dm("-74.0"))]) == 13   # 0.06
    assert zoom([(Dm("4.0"), Dm("-74.0")), (Dm("4.01"), Dm("-74.0"))]) == 14


# --------------------------------------------------------------------------- order and clock

def test_lists_come_in_the_pages_order(make):
    ans = [(i, 18, 100 + i, u, 477, '{"value": "%s"}' % s, ts()) for i, (u, s) in enumerate(
        [(3, "B"), (3, "A"), (2, "B"), (2, "C"), (1, "A"), (9, "B"), (9, "B"), (9, "A"), (5, "C")])]
    ans += [(50, 18, 200, 1, 477, '{"value": null}', ts())]
    t = make.tables(ans)
    want = [(9, 3), (1, 2), (2, 2), (3, 2), (5, 1)]      # ties by id
    assert [(r.user_id, r.total_encuestas) for r in Q.enumerators_all(t).collect()] == want
    assert [(r.convencion, r.total_encuestas) for r in Q.enumerators_today(t, as_of=D).collect()] == want
    assert [(r.censista_id, r.total_encuestas) for r in Q.enumerators_range(t, start=D, end=D).collect()] == want
    assert [(r.usuario_id, r.total_encuestas_hoy) for r in Q.enumerators_today_joined(t, as_of=D).collect()] == want
    got = [tuple(r) for r in Q.sectors_rollup_today(t, as_of=D).collect()]
    assert got == [("A", 3, 0), ("B", 4, 0), ("C", 2, 0), ("SIN SECTOR", 1, 0), ("SIN SECTOR", 10, 1)]
    assert [r.rank for r in sorted(Q.enumerators_all_ranked(t).collect(), key=lambda r: (-r.total_encuestas, r.user_id))] == [1, 2, 3, 4, 5]


def test_payload_shapes_and_bounded_lists(make):
    import dataclasses
    import json

    from fieldpulse.params import DEFAULTS
    ans = [(i, 18, 100 + i, i % 4, 477, '{"value": "S%d"}' % (i % 3), ts()) for i in range(9)]
    t = make.tables(ans)
    load = lambda df: json.loads(df.first().payload)
    report = load(Q.range_payload(t, start=D, end=D))
    assert [r["censista_id"] for r in report["resultados"]] == [0, 1, 2, 3] and report["resultados"][0]["total_encuestas"] == 3
    sectors = load(Q.sectors_payload(t, as_of=D))
    assert sectors["pregunta_id"] == 477 and sectors["sectores"][-1] == {"sector": "SIN SECTOR", "total": 9}
    assert [r["total_encuestas_hoy"] for r in load(Q.enumerators_payload(t, as_of=D))["encuestas"]] == [3, 2, 2, 2]
    two = dataclasses.replace(DEFAULTS, payload_list=2)
    dash = Q.dashboard_all(t, params=two).first()
    short = json.loads(dash.payload)
    assert [r["user_id"] for r in short["censistas"]] == [0, 1] and [r["sector"] for r in short["sectores"]] == ["S0", "S1"]
    assert dash.total_sectores == 3 and short["kpis"]["total_sectores"] == 3     # KPIs still count everything


def test_today_is_the_projects_date(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from fieldpulse.functions.filters import local_date
    late = F.timestamp_seconds(F.lit(int(dt.datetime(2024, 1, 19, 4, 30, tzinfo=dt.timezone.utc).timestamp())))
    for zone in ("UTC", "Asia/Tokyo", "America/Bogota"):
        before = spark.conf.get("spark.sql.session.timeZone")
        try:
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = spark.range(1).select(local_date(late, "America/Bogota"), local_date(late, "UTC")).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert tuple(got) == (dt.date(2024, 1, 18), dt.date(2024, 1, 19))   # 23:30 in Bogota


def test_today_without_a_date(make):
    import datetime as dt
    from zoneinfo import ZoneInfo
    now = dt.datetime.now(ZoneInfo("America/Bogota")).replace(tzinfo=None)
    noon = dt.datetime(now.year, now.month, now.day, 12)
    ans = [(1, 18, 100, 1, 477, '{"value": "A"}', noon), (2, 18, 101, 1, 477, '{"value": "A"}', noon - dt.timedelta(days=2)),
           (3, 18, 102, 1, 477, '{"value": "A"}', noon + dt.timedelta(days=2))]
    t = make.tables(ans)
    assert Q.submissions_today(t).first()[0] == 1 and Q.submissions_today_joined(t).first()[0] == 1
    assert [r.total for r in Q.sectors_today(t).collect()] == [1]
    from fieldpulse.functions.filters import scope_filter
    assert scope_filter(t.answers, "today").count() == 1 and scope_filter(t.answers, "all").count() == 3
    with pytest.raises(ValueError):
        scope_filter(t.answers, "week")


def test_summary_of_a_missing_user_has_no_name(make):
    t = make.tables([(1, 18, 100, 9, 614, '{"value": "b"}', ts())], users=[(1, "u1", "A", "B")])
    r = Q.submission_summary(t).first()
    assert r.usuario_id == 9 and r.usuario_login is None and r.usuario_nombre is None


def test_preview(make):
    import dataclasses

    from fieldpulse.params import DEFAULTS
    t = make.tables([(i, 18 if i % 2 else 99, 100 + i, 1, 614, '{"value": "b"}', ts()) for i in range(40)])
    three = dataclasses.replace(DEFAULTS, preview_size=3)
    assert [r.id for r in Q.preview_50(t, params=three).collect()] == [1, 3, 5]
    assert Q.preview_50(t).columns == Q.preview_columns(t)
    assert Q.preview_50(make.tables([(1, 99, 1, 1, 1, "{}", ts())])).count() == 0


def test_zoom_counts_the_pages_markers(spark):
    """A point with a zero coordinate is on the sector layer only."""
    from decimal import Decimal as Dm
    df = spark.createDataFrame([(Dm("4"), Dm("-74")), (Dm("0"), Dm("-74"))], "latitud decimal(38,18), longitud decimal(38,18)")
    z = geo.map_zoom(df).first()
    assert (z.n_markers, z.latitud, z.longitud, z.max_dist) == (4, 3.0, -74.0, 3.0)


# --------------------------------------------------------------------------- export on any key

ODD = ['{"it\'s": "q", "": "empty", "*": "star", "a.b": "dotted", "a": {"b": "nested", "": {"*": 1}}}',
       '{"Value": "upper", "value": "lower", "n": 1.50, "e": 1e5, "big": 12345678901234567890, "t": true, "z": null}',
       '{"value": "{\\"looks\\": \\"like an object\\"}", "list": [1, {"x": 2}]}']


def test_export_reads_any_key_and_can_be_written(spark, make, tmp_path):
    from fieldpulse.operators.flatten import column_names
    from fieldpulse.sources.sinks import write_export
    t = make.tables([(i, 18, 100 + i, 1, 1, d, ts()) for i, d in enumerate(ODD)])
    paths = leaf_paths(t.answers)
    names = dict(zip(paths, column_names(paths), strict=True))
    out = export_flat(t.answers)
    got = {r["id"]: r.asDict() for r in out.collect()}
    value = lambda i, *path: got[i][names[path]]
    assert value(0, "it's") == "q" and value(0, "") == "empty" and value(0, "*") == "star"
    assert value(0, "a.b") == "dotted" and value(0, "a", "b") == "nested" and value(0, "a", "", "*") == "1"
    assert value(1, "Value") == "upper" and value(1, "value") == "lower"
    # numbers as a parser prints them, large integers whole
    assert value(1, "n") == "1.5" and value(1, "e") == "100000.0" and value(1, "big") == "12345678901234567890"
    assert value(1, "t") == "true" and value(1, "z") is None
    assert value(2, "value") == '{"looks": "like an object"}' and value(2, "list") == '[1,{"x":2}]'
    assert len({n.lower() for n in out.columns}) == len(out.columns)
    for fmt in ("parquet", "csv"):
        write_export(out, f"{tmp_path}/{fmt}", fmt)
        # CSV writes NULL and empty text alike; quotes are escaped by doubling them in neither reader nor writer
        back = spark.read.parquet(f"{tmp_path}/parquet") if fmt == "parquet" else spark.read.csv(f"{tmp_path}/csv", header=True)
        assert back.columns == out.columns
        assert {str(r["id"]): r[names[("a", "b")]] for r in back.collect()} == {"0": "nested", "1": None, "2": None}
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/parquet").collect())) == sorted(map(str, out.collect()))


def test_export_with_paths_runs_no_job(make, monkeypatch):
    from fieldpulse.operators import flatten
    t = make.tables([(1, 18, 100, 1, 1, ODD[0], ts())])
    monkeypatch.setattr(flatten, "leaf_paths", lambda *a, **k: pytest.fail("paths were given"))
    assert flatten.export_flat(t.answers, [("a", "b")]).columns[-1] == "data.a.b"


def test_too_many_paths_is_an_error(make):
    t = make.tables([(i, 18, 100, 1, 1, '{"k%d": 1}' % i, ts()) for i in range(12)])
    with pytest.raises(ValueError, match="more than 10"):
        leaf_paths(t.answers, max_paths=10)
    assert len(leaf_paths(t.answers, max_paths=12)) == 12
