"""Streaming = batch: answers split into several files, one file per
micro-batch (availableNow), final tables equal the batch results."""

import tempfile

import pytest
from pyspark.sql import functions as F

from fieldpulse.plans import queries as Q
from fieldpulse.sources.bridge import bridge_tables
from fieldpulse.streaming import monitor

SF = "/root/testdata/sf0.001"
ROOT = tempfile.mkdtemp(prefix="fieldpulse-stream-out-")


@pytest.fixture(scope="module")
def stream_dir(spark):
    t = bridge_tables(spark, SF)
    d = tempfile.mkdtemp(prefix="fieldpulse-stream-in-")
    a = t.answers
    # four files in time order: days 1-8, 9-15, 16-22, 23-31
    for i, (lo, hi) in enumerate([(1, 8), (9, 15), (16, 22), (23, 31)]):
        part = a.where(F.dayofmonth("created_at").between(lo, hi))
        part.coalesce(1).write.mode("overwrite").parquet(f"{d}/part{i}")
    return d, t


def _stream(spark, d):
    return monitor.read_answer_stream(spark, f"{d}/part*", max_files_per_trigger=1)


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sector_daily_equals_batch(spark, stream_dir):
    d, t = stream_dir
    got = monitor.run_to_table(monitor.sector_daily(_stream(spark, d)), ["day", "sector"], "t_sector", root=ROOT)
    want = t.answers.where(F.col("survey_id").isin(18, 30, 31) & F.col("survey_question_id").isin(477, 863)) \
        .groupBy(F.to_date("created_at").alias("day"), F.get_json_object("data", "$.value").alias("sector")) \
        .agg(F.count(F.lit(1)).alias("total"))
    assert _sorted(got.select("day", "sector", "total")) == _sorted(want)


def test_submissions_daily_equals_batch(spark, stream_dir):
    d, t = stream_dir
    got = monitor.run_to_table(monitor.submissions_daily(_stream(spark, d)), ["day"], "t_subs", root=ROOT)
    want = t.answers.where(F.col("survey_id").isin(18, 30, 31)) \
        .groupBy(F.to_date("created_at").alias("day")).agg(F.count_distinct("survey_user_id").alias("n"))
    assert _sorted(got) == _sorted(want)


def test_latest_answer_equals_batch(spark, stream_dir):
    d, t = stream_dir
    got = monitor.run_to_table(monitor.latest_answer(_stream(spark, d)), ["survey_user_id"], "t_latest", root=ROOT)
    from fieldpulse.operators.latest import latest_per_key
    want = latest_per_key(t.answers, "survey_user_id").select(
        "survey_user_id", "id", "survey_question_id", "data", "created_at")
    assert _sorted(got) == _sorted(want)


def test_enumerators_daily_equals_batch(spark, stream_dir):
    d, t = stream_dir
    got = monitor.run_to_table(monitor.enumerators_daily(_stream(spark, d), t.users), ["day", "user_id"], "t_enum", root=ROOT)
    days = sorted({r[0] for r in got.select("day").collect()})
    for day in days[:3]:
        batch = {r[0]: r[2] for r in Q.enumerators_today(t, as_of=day).collect()}
        stream = {r["user_id"]: r["total_encuestas"] for r in got.where(F.col("day") == day).collect()}
        assert batch == stream


def test_households_approx_close(spark, stream_dir):
    d, t = stream_dir
    got = monitor.run_to_table(monitor.households_daily_approx(_stream(spark, d)), ["day"], "t_hh", root=ROOT)
    for r in got.collect():
        exact = Q.households_today(t, as_of=r["day"]).collect()[0][0]
        assert abs(r["total_viviendas"] - exact) <= max(2, 0.15 * exact)


def test_late_rows_count_and_undated_rows_do_not(spark, make):
    import datetime as dt
    import time

    from survey_rows import D, ts
    d = tempfile.mkdtemp(prefix="fieldpulse-late-")
    s = '{"value": "A"}'
    batches = [
        [(1, 18, 100, 1, 477, s, ts(-10)), (2, 18, 104, 1, 477, s, ts(-8))],
        [(3, 18, 108, 1, 477, s, ts(0)), (6, 18, 120, 1, 477, s, None)],
        [(4, 18, 112, 1, 477, s, ts(-10)), (5, 18, 116, 1, 477, s, ts(0))],    # ten days late
    ]
    for i, rows_ in enumerate(batches):
        make.tables(rows_).answers.coalesce(1).write.parquet(f"{d}/b{i}")
        time.sleep(1.1)   # file order = arrival order
    read = lambda: monitor.read_answer_stream(spark, f"{d}/b*", max_files_per_trigger=1)
    users = make.tables(batches[0]).users
    root = tempfile.mkdtemp(prefix="fieldpulse-late-out-")
    want = {D - dt.timedelta(10): 2, D - dt.timedelta(8): 1, D: 2}
    for name, frame, keys, total in (
            ("s", monitor.sector_daily(read()), ["day", "sector"], "total"),
            ("n", monitor.submissions_daily(read()), ["day"], "total_encuestas"),
            ("e", monitor.enumerators_daily(read(), users), ["day", "user_id"], "total_encuestas")):
        got = monitor.run_to_table(frame, keys, name, root=root)
        assert {r["day"]: r[total] for r in got.collect()} == want


def test_restart_reads_only_new_files(spark, stream_dir):
    import shutil
    d, t = stream_dir
    arrivals, root = tempfile.mkdtemp(prefix="fieldpulse-restart-in-"), tempfile.mkdtemp(prefix="fieldpulse-restart-")

    def run():
        stream = monitor.read_answer_stream(spark, f"{arrivals}/part*")
        live = monitor.start_live(monitor.submissions_daily(stream), ["day"], "t_restart", root=root,
                                  trigger={"availableNow": True})
        live.query.awaitTermination()
        return live, sum(p["numInputRows"] for p in live.query.recentProgress)

    shutil.copytree(f"{d}/part2", f"{arrivals}/part2")
    _, first = run()
    shutil.copytree(f"{d}/part0", f"{arrivals}/part0")          # older days, while no query runs
    live, second = run()
    n = [spark.read.parquet(f"{d}/part{i}").count() for i in (2, 0)]
    assert [first, second] == n
    both = spark.read.parquet(f"{d}/part0", f"{d}/part2")
    assert _sorted(live.view()) == _sorted(monitor.submissions_daily(both))
    again, third = run()
    assert third == 0 and _sorted(again.view()) == _sorted(monitor.submissions_daily(both))


def test_live_table_follows_new_answers(spark, stream_dir):
    import shutil
    d, t = stream_dir
    live_in, root = tempfile.mkdtemp(prefix="fieldpulse-live-in-"), tempfile.mkdtemp(prefix="fieldpulse-live-")
    shutil.copytree(f"{d}/part0", f"{live_in}/part0")
    stream = monitor.read_answer_stream(spark, f"{live_in}/part*")
    live = monitor.start_live(monitor.submissions_daily(stream), ["day"], "t_live", every="1 second", root=root)
    try:
        live.query.processAllAvailable()
        first = {r["day"] for r in live.view().collect()}
        shutil.copytree(f"{d}/part1", f"{live_in}/part1")      # new answers arrive while it runs
        live.query.processAllAvailable()
        got = _sorted(live.view())
    finally:
        live.query.stop()
    days = F.dayofmonth("created_at").between(1, 15)
    want = _sorted(monitor.submissions_daily(t.answers.where(days)))
    assert got == want and len(first) < len(got)


def test_stream_over_parsed_fields_equals_batch(spark, stream_dir):
    from fieldpulse.functions.fields import parse_fields
    d, t = stream_dir
    parsed = tempfile.mkdtemp(prefix="fieldpulse-parsed-in-")
    for i in range(4):
        parse_fields(spark.read.parquet(f"{d}/part{i}")).coalesce(1).write.parquet(f"{parsed}/part{i}")
    stream = monitor.read_answer_stream(spark, f"{parsed}/part*", max_files_per_trigger=1, fields=True)
    assert "value_text" in stream.columns
    got = monitor.run_to_table(monitor.sector_daily(stream), ["day", "sector"], "t_parsed", root=ROOT)
    assert _sorted(got) == _sorted(monitor.sector_daily(t.answers))
