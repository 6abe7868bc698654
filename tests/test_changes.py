"""Corrected and deleted answers (change feed), and the run store behind the live tables."""

import dataclasses
import datetime as dt
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.plans import queries as Q
from fieldpulse.streaming import changes, monitor
from fieldpulse.streaming.runs import RunStore, Table, last_row, signed_sum
from survey_rows import D, ts

SECTOR = '{"value": "A"}'


# --------------------------------------------------------------------------- run store

def _sums():
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    return {"t": Table(schema, ["k"], signed_sum(["k"]))}


def _store(spark, tables=None, base=None):
    return RunStore(spark, base or tempfile.mkdtemp(prefix="fieldpulse-runs-"), tables or _sums())


def _commit(store, batch_id, counts):
    rows = [(k, n) for k, n in counts.items() if n]
    df = store.spark.createDataFrame(rows, "k string, n long").coalesce(1)
    store.commit(batch_id, {"t": store.write("t", df)})


def _total(store):
    return {r.k: r.n for r in store.read("t").collect()}


def test_runs_stay_few_and_small(spark):
    store, rng, want, sizes = _store(spark), random.Random(5), Counter(), []
    for b in range(24):
        batch = Counter({f"k{rng.randrange(30)}": rng.choice([-1, 1, 2]) for _ in range(rng.randrange(1, 9))})
        _commit(store, b, batch)
        want.update(batch)
        runs = [n for _, n in store.manifest()["runs"]["t"]]
        assert all(2 * b < a for a, b in zip(runs, runs[1:], strict=False))
        sizes.append(sum(runs))
        assert sum(runs) <= 2 * max(runs, default=0)
    assert _total(store) == {k: n for k, n in want.items() if n}
    assert max(sizes) <= 60 and len(store.manifest()["runs"]["t"]) <= 5
    folders = [s for s in store._fs.listStatus(store._path("runs"))]
    assert len(folders) <= 8 * 6  # runs of the manifests that stay readable


def test_a_batch_counts_once(spark):
    store = _store(spark)
    _commit(store, 0, {"a": 1, "b": 2})
    _commit(store, 0, {"a": 1, "b": 2})
    assert store.has(0) and not store.has(1) and _total(store) == {"a": 1, "b": 2}


def test_keys_that_sum_to_nothing_go(spark):
    store = _store(spark)
    _commit(store, 0, {"a": 1, "b": 2})
    _commit(store, 1, {"a": -1, "b": -2})
    assert _total(store) == {} and store.manifest()["runs"]["t"] == []


@pytest.mark.parametrize("dies_at", ["write", "swap", "merge"])
def test_a_writer_that_dies_loses_nothing(spark, monkeypatch, dies_at):
    """Before the manifest names the batch's run, after the batch but before the merge, or before the merged run is named."""
    store = _store(spark)
    _commit(store, 0, {"a": 1, "b": 2, "c": 5})
    calls = Counter()

    def die(name, nth):
        real = getattr(RunStore, name)

        def run(self, *args):
            calls[name] += 1
            if calls[name] == nth:
                raise OSError("lost")
            return real(self, *args)
        monkeypatch.setattr(RunStore, name, run)

    die(*{"write": ("_swap", 1), "swap": ("settle", 1), "merge": ("_swap", 2)}[dies_at])
    with pytest.raises(OSError):
        _commit(store, 1, {"a": 4, "d": 1})
    monkeypatch.undo()
    done = dies_at != "write"
    again = _store(spark, base=store.base)
    assert _total(again) == ({"a": 5, "b": 2, "c": 5, "d": 1} if done else {"a": 1, "b": 2, "c": 5})
    _commit(again, 1, {"a": 4, "d": 1})  # the stream repeats the batch
    _commit(again, 2, {"e": 1})
    assert _total(again) == {"a": 5, "b": 2, "c": 5, "d": 1, "e": 1}
    named = {r[0].rsplit("/", 1)[1] for n in again._versions()[-8:] for r in again._read(n)["runs"]["t"]}
    assert {s.getPath().getName() for s in again._fs.listStatus(again._path("runs"))} == named


def test_tables_are_committed_together(spark, monkeypatch):
    tables = {"t": _sums()["t"], "u": _sums()["t"]}
    store = _store(spark, tables)
    run = lambda t, k: store.write(t, spark.createDataFrame([(k, 1)], "k string, n long"))
    t = run("t", "a")
    assert _total(store) == {}          # written, not yet committed
    store.commit(0, {"t": t, "u": run("u", "b")})
    assert [r.k for r in store.read("t").collect()] == ["a"] and [r.k for r in store.read("u").collect()] == ["b"]


def test_last_row(spark):
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("k", "v", "_batch")])
    store = _store(spark, {"t": Table(schema, ["k"], last_row(["k"]))})
    for b, rows in enumerate([[(1, 10), (2, 20), (None, 5)], [(2, None)], [(1, 11), (None, 6)]]):
        df = spark.createDataFrame([(k, v, b) for k, v in rows], schema)
        store.commit(b, {"t": store.write("t", df)})
    assert {r.k: r.v for r in store.read("t").collect()} == {1: 11, 2: None, None: 6}


# --------------------------------------------------------------------------- change feed

def _feed(spark, batches):
    """Batches of (before, after) answer tuples as files, one micro-batch each."""
    import os
    d = tempfile.mkdtemp(prefix="fieldpulse-feed-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, changes.CHANGE_SCHEMA).coalesce(1).write.parquet(f"{d}/b{i}")
        for f in os.listdir(f"{d}/b{i}"):  # arrival order
            os.utime(f"{d}/b{i}/{f}", (1_700_000_000 + 100 * i,) * 2)
    return changes.read_change_stream(spark, f"{d}/b*", max_files_per_trigger=1)


def answer(i, sub, day=0, user=1, q=477, data=SECTOR, survey=18, h=10):
    return (i, survey, sub, user, q, data, None if day is None else ts(day, h))


A, B, C = answer(1, 100), answer(2, 100, h=12), answer(3, 104, user=2)
BATCHES = [
    [(None, A), (None, B), (None, C), (None, answer(4, 108, -3, 2)), (None, answer(5, 112, q=55, data='{"value": ""}'))],
    [(A, answer(1, 100, data='{"value": "Z"}')),                    # edited: another sector
     (B, answer(2, 100, -1, h=12)),                                 # moved to the day before
     (answer(9, 120), answer(9, 120, data='{"value": null}'))],     # edited before its insert arrives
    [(None, answer(9, 120)), (C, None), (None, answer(6, 116, -60, 2)),   # deleted; 60 days late
     (None, answer(7, 124, None)), (None, answer(8, 124, survey=99))],    # undated; out of scope
    [(answer(4, 108, -3, 2), None), (None, answer(4, 108, -3, 2)),        # deleted and inserted again
     (answer(5, 112, q=55, data='{"value": ""}'), None)],
]


def _final():
    live = Counter()
    for before, after in (c for b in BATCHES for c in b):
        live[after] += after is not None
        live[before] -= before is not None
    assert set(live.values()) <= {0, 1}
    return [r for r, n in live.items() if r and n]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def final(make):
    return make.tables(_final(), users=[(1, "u1", "F1", None), (2, "u2", None, "L2")])


@pytest.mark.parametrize("name", ["sector", "submissions", "enumerators", "latest"])
def test_equals_batch_on_the_final_table(spark, final, name):
    own, batch = {
        "sector": (changes.sector_daily(), monitor.sector_daily(final.answers)),
        "submissions": (changes.submissions_daily(), monitor.submissions_daily(final.answers)),
        "enumerators": (changes.enumerators_daily(final.users), monitor.enumerators_daily(final.answers, final.users)),
        "latest": (changes.latest_answer(), monitor.latest_answer(final.answers)),
    }[name]
    got = changes.run_changes(_feed(spark, BATCHES), own, name, root=tempfile.mkdtemp(prefix="fieldpulse-changes-"))
    assert _rows(got.select(*batch.columns)) == _rows(batch) and got.count()


def test_hand_counted(spark, final):
    root = tempfile.mkdtemp(prefix="fieldpulse-changes-")
    got = changes.run_changes(_feed(spark, BATCHES), changes.sector_daily(), "s", root=root)
    day = lambda n: D + dt.timedelta(n)
    assert {(r.day, r.sector): r.total for r in got.collect()} == {
        (day(0), "Z"): 1, (day(-1), "A"): 1, (day(0), None): 1, (day(-60), "A"): 1, (day(-3), "A"): 1}
    got = changes.run_changes(_feed(spark, BATCHES), changes.submissions_daily(), "n", root=root)
    assert {r.day: r.total_encuestas for r in got.collect()} == {day(0): 2, day(-1): 1, day(-60): 1, day(-3): 1}


def test_same_as_polling_after_each_batch(spark, make):
    """What the page would show after every batch that leaves whole answers, and no state in Spark's store."""
    root, at = tempfile.mkdtemp(prefix="fieldpulse-changes-"), []
    for upto in (1, 4):
        live = changes.start_changes(_feed(spark, BATCHES[:upto]), changes.submissions_daily(), f"p{upto}", root=root,
                                     trigger={"availableNow": True})
        live.query.awaitTermination()
        assert all(not p["stateOperators"] for p in live.query.recentProgress)
        at.append(_rows(live.view()))
    first = make.tables([a for _, a in BATCHES[0]])
    assert at[0] == _rows(monitor.submissions_daily(first.answers)) != at[1]
    last = make.tables(_final())
    assert at[1] == _rows(monitor.submissions_daily(last.answers))
    for day, n in at[1]:
        on = last.answers.where(F.to_date("created_at") == F.lit(day))
        assert Q.submissions_all(dataclasses.replace(last, answers=on)).first()[0] == n


def test_snapshots_as_a_feed(spark, make):
    old, new = make.tables([a for _, a in BATCHES[0]]).answers, make.tables(_final()).answers
    rows = changes.changes_between(old, new).collect()
    kinds = Counter((r.before is not None, r.after is not None) for r in rows)
    assert kinds == {(False, True): 4, (True, False): 2, (True, True): 2}
    moved = changes.signed(changes.changes_between(old, new)).groupBy("id").agg(F.sum("sign").alias("n"))
    assert {r.id: r.n for r in moved.collect()} == {1: 0, 2: 0, 3: -1, 5: -1, 6: 1, 7: 1, 8: 1, 9: 1}


def test_other_survey_set(spark):
    p = dataclasses.replace(Q.DEFAULTS, survey_ids=(99,), sector_qids=(477,))
    got = changes.run_changes(_feed(spark, BATCHES), changes.sector_daily(p), "o", root=tempfile.mkdtemp())
    assert [tuple(r) for r in got.collect()] == [(D, "A", 1)]


@pytest.mark.parametrize("name", ["sector", "submissions", "enumerators"])
def test_appended_answers_without_state(spark, make, name):
    """An append-only stream: an answer 60 days late corrects its day, and Spark's state store holds no row of any day."""
    import os
    d = tempfile.mkdtemp(prefix="fieldpulse-append-")
    batches = [[answer(10 * b + k, 200 + 4 * b + k // 3, -b * 7, user=1 + k % 2) for k in range(8)] for b in range(5)]
    batches.append([answer(90, 204, -60), answer(91, 205, -7, 2), answer(92, 300, None)])
    for i, rows in enumerate(batches):
        make.tables(rows).answers.coalesce(1).write.parquet(f"{d}/b{i}")
        for f in os.listdir(f"{d}/b{i}"):
            os.utime(f"{d}/b{i}/{f}", (1_700_000_000 + 100 * i,) * 2)
    t = make.tables([r for b in batches for r in b])
    own, batch = {"sector": (changes.sector_daily(), monitor.sector_daily(t.answers)),
                  "submissions": (changes.submissions_daily(), monitor.submissions_daily(t.answers)),
                  "enumerators": (changes.enumerators_daily(t.users), monitor.enumerators_daily(t.answers, t.users))}[name]
    stream = changes.inserted(monitor.read_answer_stream(spark, f"{d}/b*", max_files_per_trigger=1))
    live = changes.start_changes(stream, own, name, root=tempfile.mkdtemp(prefix="fieldpulse-append-out-"), trigger={"availableNow": True})
    live.query.awaitTermination()
    progress = [p for p in live.query.recentProgress if p["numInputRows"]]
    assert len(progress) == 6 and not any(p["stateOperators"] for p in progress)
    got = live.view()
    assert _rows(got.select(*batch.columns)) == _rows(batch)
    assert D - dt.timedelta(60) in {r.day for r in got.collect()}
