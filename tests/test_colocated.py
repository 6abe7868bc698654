"""Answers and submissions in buckets by submission: the same results without a shuffle of answers."""

import re

import pytest

from fieldpulse.operators import geo
from fieldpulse.plans import queries as Q
from fieldpulse.sources.bridge import AS_OF, bridge_tables
from fieldpulse.sources.tables import read_colocated, write_colocated
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
KW = dict(as_of=AS_OF, start="2024-01-10", end="2024-01-20")


@pytest.fixture(scope="module")
def tables(spark):
    return bridge_tables(spark, SF)


@pytest.fixture(scope="module", params=[False, True], ids=["raw", "parsed"])
def colocated(spark, tables, request, tmp_path_factory):
    name = f"survey_{'parsed' if request.param else 'raw'}"
    write_colocated(tables.answers, tables.submissions, name, 5, str(tmp_path_factory.mktemp(name)), parsed=request.param)
    yield read_colocated(spark, name, tables.users)
    for kind in ("answers", "submissions"):
        spark.sql(f"DROP TABLE {name}_{kind}")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _exchanged(df):
    """Keys that rows are shuffled by, in the initial plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)


@pytest.mark.parametrize("parts", [(), ("sector",), ("sector", "persons")])
def test_profile_without_an_exchange(colocated, tables, no_broadcast, parts):
    got = geo.household_profile(colocated.answers, colocated.submissions, parts=parts)
    assert _exchanged(got) == []
    assert _exchanged(geo.household_profile(tables.answers, tables.submissions, parts=parts)) != []
    want = geo.household_profile(tables.answers, tables.submissions, parts=parts)
    rows = lambda df: digest(df.columns, [tuple(r) for r in df.collect()])[0]
    assert rows(got) == rows(want)


@pytest.mark.parametrize("key", ["household_points", "household_sector_points", "household_person_points", "submission_wide",
                                 "submissions_today_joined", "heat_points"])
def test_keys_without_an_exchange_of_answers(colocated, no_broadcast, key):
    assert _exchanged(Q.BATCH_QUERIES[key](colocated, **KW)) == []


def test_joined_keys_shuffle_totals_only(colocated, no_broadcast):
    """Per-enumerator counts and distinct values are shuffled, submissions and their answers meet where they lie."""
    users = _exchanged(Q.enumerators_today_joined(colocated, **KW))
    assert users and all(k.startswith(("user_id", "id#", "total")) or "user_id" in k for k in users) and not any("survey_user_id" in k for k in users)
    homes = _exchanged(Q.households_today_joined(colocated, **KW))
    assert not any("survey_user_id" in k or re.fullmatch(r"id#\d+L?", k) for k in homes)


@pytest.mark.parametrize("key", ["submissions_today_joined", "enumerators_today_joined", "households_today_joined", "persons_today",
                                 "map_layers", "map_centre", "sector_polygons", "submission_summary", "submission_wide",
                                 "dashboard_all", "dashboard_today", "enumerators_range", "preview_50"])
def test_same_results(colocated, tables, key):
    a, b = Q.BATCH_QUERIES[key](colocated, **KW), Q.BATCH_QUERIES[key](tables, **KW)
    assert a.columns == b.columns
    assert digest(a.columns, [tuple(r) for r in a.collect()])[0] == digest(b.columns, [tuple(r) for r in b.collect()])[0]


def test_appended_loads(spark, tables, tmp_path):
    """A second load adds to the buckets; the plan stays without an exchange."""
    half = tables.answers.where("id % 2 = 0"), tables.answers.where("id % 2 = 1")
    write_colocated(half[0], tables.submissions, "survey_grown", 4, str(tmp_path))
    write_colocated(half[1], tables.submissions.where("false"), "survey_grown", 4, str(tmp_path), mode="append")
    try:
        t = read_colocated(spark, "survey_grown", tables.users)
        got, want = Q.household_person_points(t), Q.household_person_points(tables)
        assert _exchanged(got) == []
        assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(want.columns, [tuple(r) for r in want.collect()])[0]
    finally:
        for kind in ("answers", "submissions"):
            spark.sql(f"DROP TABLE survey_grown_{kind}")
