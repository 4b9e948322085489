"""The streams over files out of time order, one file to a batch, against the whole tables."""

import datetime

import pytest

from tessera.plans import more, queries
from tessera.streaming import logs

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def one_by_one(monkeypatch):
    read = logs.read_stream
    monkeypatch.setattr(logs, "read_stream", lambda *a: read(*a, files_per_batch=1))


def test_events_out_of_order(spark, tmp_path, one_by_one):
    times = [DAY + datetime.timedelta(days=d, hours=h) for d in (20, 3, 11, 0, 19) for h in (1, 5)]
    for i, ts in enumerate(times):
        spark.createDataFrame([(i, "ab"[i % 2], ts)], "event_id long, event_type string, ts timestamp_ntz").write.mode("append").parquet(f"{tmp_path}/events.parquet")
    rows = queries.stream_without_repeats(spark, str(tmp_path)).collect()
    assert sorted((r.event_id, r.event_type) for r in rows) == [(i, "ab"[i % 2]) for i in range(len(times))]
    rows = more.stream_activity(spark, str(tmp_path)).collect()
    assert sorted((r.start, r.event_type, r.n) for r in rows) == [(DAY + datetime.timedelta(days=d), k, 1) for d in (0, 3, 11) for k in "ab"]


def test_turns_out_of_order(spark, tmp_path, one_by_one):
    for turn in (5, 2, 4, 0, 1, 3):
        spark.createDataFrame([(c, turn, "user", "t") for c in (1, 2)], "conv_id long, turn int, role string, text string").write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    rows = queries.stream_chain(spark, str(tmp_path)).collect()
    assert sorted(rows) == sorted((c, t, t != 4, True) for c in (1, 2) for t in range(6))
