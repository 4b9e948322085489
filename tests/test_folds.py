"""State of streams: timers release actions in order, late ones are set apart, state survives a restart and stays bounded."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tessera.plans import streams
from tessera.streaming import folds, logs

DAY = datetime.datetime(2024, 1, 1)
LOG = "k long, seq long, before_hash string, after_hash string, ts timestamp_ntz"


def put(spark, path, rows, schema=LOG):
    """One more file, later than those before it."""
    time.sleep(1.05)
    spark.createDataFrame([(*r[:-1], None if r[-1] is None else DAY + datetime.timedelta(minutes=r[-1])) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, base, delay):
    stream = logs.read_stream(spark, f"{base}/log", LOG, files_per_batch=1)
    out, query = folds.run_sinks(folds.fold_stream(stream, "k", delay), f"{base}/out", f"{base}/checkpoint")
    return sorted((r.k, r.seq, r.link_ok, r.time_ok, r.sink) for r in out.collect())


def test_timers_late_actions_and_restart(spark, tmp_path):
    base = str(tmp_path)
    put(spark, f"{base}/log", [(1, 1, "", "a", 0), (1, 2, "a", "b", 5), (2, 1, "", "x", 3), (3, 1, "", "n", None)])
    put(spark, f"{base}/log", [(1, 4, "c", "d", 60), (1, 3, "b", "c", 30), (2, 2, "y", "z", 61), (2, 3, "x", "w", 2)])
    got = run(spark, base, 60_000)
    # of the second file what is at 2 comes after the watermark (4); seq 3 is judged before seq 4, as its time says
    want = [(1, 1, True, True, "accepted"), (1, 2, True, True, "accepted"), (1, 3, True, True, "accepted"), (1, 4, True, True, "accepted"), (2, 1, True, True, "accepted"), (2, 3, None, None, "quarantine"), (3, 1, None, None, "quarantine")]
    assert got == want
    assert [(r.k, r.seq) for r in folds.waiting(spark, f"{base}/checkpoint", "k").collect()] == [(2, 2)]
    put(spark, f"{base}/log", [(1, 5, "d", "e", 90), (1, 6, "e", "f", 7), (2, 4, "x", "v", 100)])
    got = run(spark, base, 60_000)  # another query from the same checkpoint
    assert got == sorted([*want, (2, 2, False, True, "refused"), (1, 5, True, True, "accepted"), (1, 6, None, None, "quarantine")])
    ends = folds.closed(spark, f"{base}/checkpoint", "k").collect()
    assert [tuple(r) for r in ends] == [(2, 4, True, True, "accepted")]
    late = spark.read.parquet(f"{base}/out").where("sink = 'quarantine'")
    assert sorted((r.k, r.seq) for r in late.collect()) == [(1, 6), (2, 3), (3, 1)]


def test_equal_times_and_refused_actions_do_not_move_the_head():
    rows = [(1, 1, "", "a"), (1, 2, "a", "b"), (2, 3, "q", "c"), (3, 4, "a", "d"), (4, 5, "d", "e")]
    found, head = folds.judged(folds.NO_HEAD, rows)
    assert found == [(1, True, True), (2, True, False), (3, False, True), (4, True, True), (5, True, True)] and head == (4, "e")


def test_counted_disorder(spark, tmp_path):
    path = f"{tmp_path}/log"
    put(spark, path, [(1, 1, "", "", 0), (1, 2, "", "", 50)])
    assert folds.counted_disorder(spark, path) == 2
    put(spark, path, [(1, 3, "", "", 20), (1, 4, "", "", 90)])
    put(spark, path, [(1, 5, "", "", 80)])
    assert folds.counted_disorder(spark, path) == 30 * 60_000 + 2
    assert folds.counted_spread(spark.read.parquet(path), "k") == 90 * 60_000 + 2


@pytest.fixture
def one_by_one(monkeypatch):
    read = logs.read_stream
    monkeypatch.setattr(logs, "read_stream", lambda *a, **_: read(*a, files_per_batch=1))


def test_state_stays_bounded(spark, tmp_path):
    path, schema = f"{tmp_path}/log", "event_id long, event_type string, ts timestamp_ntz"
    for k in range(10):  # ten batches a day apart, each id twice within the hour
        put(spark, path, [(100 * k + i, "ab"[i % 2], 1440 * k + i % 30 + 30 * j) for i in range(50) for j in (0, 1)], schema)
    delay = max(folds.counted_disorder(spark, path), folds.counted_spread(spark.read.parquet(path), "event_id"))
    stream = logs.read_stream(spark, path, schema, files_per_batch=1).withColumn("ts", F.col("ts").cast("timestamp"))
    out, counted = folds.run_bounded(folds.without_repeats(stream, "event_id", "ts", delay), f"{tmp_path}/o1", f"{tmp_path}/c1")
    assert sorted(r.event_id for r in out.collect()) == [100 * k + i for k in range(10) for i in range(50)]
    assert counted["rows_dropped"] == 0 and counted["most_state"] <= 100
    out, counted = folds.run_bounded(folds.window_counts(stream, "event_type", "ts", "1 hour", delay), f"{tmp_path}/o2", f"{tmp_path}/c2")
    assert counted["rows_dropped"] == 0 and counted["most_state"] <= 4
    still = folds.open_windows(spark, f"{tmp_path}/c2", "event_type")
    assert still.count() == 2 and out.unionByName(still).agg(F.sum("n")).first()[0] == 1000
    put(spark, path, [(9999, "a", 0)], schema)
    _, counted = folds.run_bounded(folds.window_counts(stream, "event_type", "ts", "1 hour", delay), f"{tmp_path}/o2", f"{tmp_path}/c2")
    assert counted["rows_dropped"] == 1


def test_queries_do_not_depend_on_batches(spark, tmp_path, one_by_one):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    for k, days in enumerate(((20, 3), (11, 0), (19, 25))):
        put(spark, f"{tmp_path}/events.parquet", [(10 * k + i, None, u, "ab"[i % 2], 1440 * d) for i, d in enumerate(days) for u in (1,)], "event_id long, x string, user_id long, event_type string, ts timestamp_ntz")
    got = streams.stream_folds(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {r.sink for r in got} == {"accepted", "refused"} and [r.seq for r in got if r.sink == "refused"] == [0]
    assert sorted(r.event_id for r in streams.stream_bounded_repeats(spark, str(tmp_path)).collect()) == [0, 1, 10, 11, 20, 21]
    assert sorted(r.start.day for r in streams.stream_windows(spark, str(tmp_path)).collect()) == [1, 4, 12, 20, 21, 26]


def test_actions_of_a_key_wait_packed(spark, tmp_path):
    base, n = str(tmp_path), 450
    chain = lambda k, at: (k, at, f"{at - 1}" if at else "", f"{at}", at)
    for half in (0, 1):
        put(spark, f"{base}/log", [chain(k, at) for at in range(half, n, 2) for k in (1, 2)])
    assert run(spark, base, 86_400_000) == []
    held = spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", "pending").load()
    assert held.count() < 50  # one for each action before
    want = sorted((k, at, True, True, "accepted") for k in (1, 2) for at in range(n))
    assert sorted(tuple(r) for r in folds.closed(spark, f"{base}/checkpoint", "k").collect()) == want
    put(spark, f"{base}/log", [(3, 1, "", "a", 20 * 1440), (1, n + 1, "", "z", None)])
    got = run(spark, base, 86_400_000)  # both files' timers of a key go off at once
    assert got == sorted([*want, (1, n + 1, None, None, "quarantine")], key=lambda r: r[:2])
