"""Kept path profile and wide exports."""

import datetime as dt
import json
import tempfile

from fieldpulse.operators import profile
from fieldpulse.operators.flatten import export_flat, leaf_paths
from survey_rows import D, ts


def _answers(make, texts):
    return make.tables([(i, 18, 100 + i, 1, 477, t, when) for i, (t, when) in enumerate(texts)]).answers


DEEP = json.dumps({"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": {"j": {"k": [1]}}}}}}}}}}})
TEXTS = [('{"value": "x"}', ts()), ('{"value": {"latitude": "4", "n": 1.5}}', ts(-1)), ('{"value": null, "ok": true}', ts(-1)),
         (DEEP, ts(-2)), ('{"a.b": 1, "A": {}}', None), (None, ts()), ("not json", ts()), ("[1]", ts()), ('{"value": ["x"]}', ts())]


def test_profile_has_the_paths_that_discovery_finds(spark, make):
    answers = _answers(make, TEXTS)
    found = profile.path_profile(answers)
    assert sorted({tuple(r.path) for r in found.collect()}) == leaf_paths(answers)
    kinds = {(".".join(r.path), r.kind, r.day): r.answers for r in found.collect()}
    day = lambda n: D + dt.timedelta(n)
    assert kinds[("value", "STRING", day(0))] == 1 and kinds[("value", "ARRAY", day(0))] == 1
    assert kinds[("value", "VOID", day(-1))] == 1 and kinds[("value.n", "DECIMAL", day(-1))] == 1
    assert kinds[("a.b.c.d.e.f.g.h.i.j.k", "ARRAY", day(-2))] == 1 and ("a.b", "BIGINT", None) in kinds


def test_exports_of_a_range_and_replaced_days(spark, make):
    path = tempfile.mkdtemp(prefix="fieldpulse-profile-")
    answers = _answers(make, TEXTS)
    profile.update_path_profile(answers, path)
    kept = profile.read_path_profile(spark, path)
    assert profile.known_paths(kept) == leaf_paths(answers)
    assert profile.known_paths(kept, D - dt.timedelta(1), str(D)) == [("ok",), ("value",), ("value", "latitude"), ("value", "n")]
    later = _answers(make, [('{"new": 1}', ts()), ('{"z": 1}', ts(-5))])
    profile.update_path_profile(later, path, [D, str(D - dt.timedelta(1))])
    kept = profile.read_path_profile(spark, path)
    assert ("z",) not in profile.known_paths(kept) and profile.known_paths(kept, D - dt.timedelta(1)) == [("new",)]


def test_an_export_is_planned_without_reading_answers(spark, make):
    """The plan is made from the profile; a source that fails when read is not touched."""
    path = tempfile.mkdtemp(prefix="fieldpulse-profile-")
    answers = _answers(make, TEXTS)
    profile.update_path_profile(answers, path)
    broken = answers.selectExpr("*").withColumn("data", answers["data"]).where("raise_error('answers were read') is null")
    planned = export_flat(broken, profile.known_paths(profile.read_path_profile(spark, path)))
    assert planned.columns == export_flat(answers).columns


def test_more_paths_than_discovery_takes(spark, make):
    """12,000 keys: the export in groups holds every value."""
    n = 12_000
    texts = [(json.dumps({f"k{j}": f"v{j}" for j in range(i, n, 3)}), ts()) for i in range(3)]
    answers = _answers(make, texts)
    path, out = tempfile.mkdtemp(prefix="fieldpulse-profile-"), tempfile.mkdtemp(prefix="fieldpulse-wide-")
    profile.update_path_profile(answers, path)
    paths = profile.known_paths(profile.read_path_profile(spark, path))
    assert len(paths) == n
    groups = profile.write_wide_export(answers, paths, out, "csv", size=3000)
    assert groups == 4
    seen = set()
    for g in range(1, groups + 1):
        frame = spark.read.option("header", True).csv(f"{out}/group={g}").toPandas().set_index("id")
        cols = [c for c in frame.columns if c.startswith("data.")]
        assert len(cols) == 3000 and ("survey_id" in frame.columns) == (g == 1)
        for c in cols:
            j = int(c.removeprefix("data.k"))
            assert [v for v in frame[c] if v is not None] == [f"v{j}"] and frame.loc[str(j % 3), c] == f"v{j}"
        seen.update(cols)
    assert len(seen) == n


def test_groups_have_the_names_of_the_whole_layout(spark, make):
    answers = _answers(make, TEXTS)
    whole = export_flat(answers)
    parts = list(profile.export_groups(answers, leaf_paths(answers), size=2))
    names = [c for p in parts for c in p.columns if c.startswith("data.")]
    assert names == [c for c in whole.columns if c.startswith("data.")]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.join(p.select("id", *[f"`{c}`" for c in p.columns if c.startswith("data.")]), "id")
    assert sorted(map(repr, joined.select(*[f"`{c}`" for c in whole.columns]).collect())) == sorted(map(repr, whole.collect()))


def test_no_answers(spark, make):
    answers = _answers(make, TEXTS).where("false")
    path = tempfile.mkdtemp(prefix="fieldpulse-profile-")
    profile.update_path_profile(answers, path, [D])
    assert profile.known_paths(profile.read_path_profile(spark, path)) == []
    assert [p.count() for p in profile.export_groups(answers, [])] == [0]
