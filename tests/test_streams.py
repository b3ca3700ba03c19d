"""Windows over streams of times without a zone."""

from __future__ import annotations

from datetime import datetime

import pytest

from tallyloom.plans import streams
from tallyloom.streaming import windows


@pytest.fixture
def events(spark, tmp_path):
    """(stream, rows) of events around the hours that New York's clocks skip and repeat; the session is there."""
    times = ["2024-03-10 01:59:59.999999", "2024-03-10 02:30:00", "2024-03-10 03:10:00", "2024-11-03 00:50:00", "2024-11-03 01:10:00.000001", "2024-11-03 02:05:00", "1970-01-01 00:00:00"]
    rows = spark.createDataFrame([(k, datetime.fromisoformat(t), k % 2, "x", float(k)) for k, t in enumerate(times)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    rows.write.parquet(str(tmp_path / "events"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")), spark.read.parquet(str(tmp_path / "events"))
    spark.conf.set("spark.sql.session.timeZone", before)


def same(spark, stream, batch):
    got = streams.drain(spark, stream)
    assert got.dtypes == batch.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    return got


def test_tumbling_stream_equals_batch(spark, events):
    stream, rows = events
    got = same(spark, windows.tumbling(streams.closed(spark, stream), keys=["event_type"]), windows.tumbling(rows, keys=["event_type"]))
    assert got.where("window_start = timestamp_ntz'2024-03-10 02:00:00'").count() == 1  # an hour that the zone hasn't


def test_sliding_stream_equals_batch(spark, events):
    stream, rows = events
    same(spark, windows.tumbling(streams.closed(spark, stream), "2 hours", slide="1 hour"), windows.tumbling(rows, "2 hours", slide="1 hour"))


def test_session_stream_equals_batch(spark, events):
    stream, rows = events
    same(spark, windows.sessions(streams.closed(spark, stream)), windows.sessions(rows))
