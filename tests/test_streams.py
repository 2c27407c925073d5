"""Streams against the batch result, stopped and started again from their checkpoint."""

import datetime as dt

import pandas as pd
import pytest

from tickloom.streaming import events, state

START = dt.datetime(2024, 1, 1)


def put(spark, folder, rows, schema, name):
    """Adds one file to a stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return (str(tmp_path / n) for n in ("in", "out", "checkpoint"))


def drain(stream, out, checkpoint, mode="append"):
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def event(i, minutes, user=1, kind="a", value=None):
    return (i, START + dt.timedelta(minutes=minutes), user, kind, float(i if value is None else value), "{}")


def test_sliding_windows_equal_the_batch(spark, tmp_path):
    rows = [event(i, 7 * i % 900, kind="ab"[i % 2]) for i in range(300)]
    far = [event(10_000, 10_000), event(10_001, 20_000)]  # move the watermark past all windows
    feed, out, checkpoint = folders(tmp_path)
    stream = events.timed(spark.readStream.schema(events.EVENTS).option("recursiveFileLookup", "true").parquet(feed))
    for name, part in (("one", rows[:120]), ("two", rows[120:]), ("three", far[:1]), ("four", far[1:])):
        put(spark, feed, part, events.EVENTS, name)
        drain(state.sliding_bars(stream, late="20 hours"), out, checkpoint)  # a new query each time: it starts from the checkpoint
    got = {tuple(r) for r in spark.read.parquet(out).where("start < '2024-01-05'").collect()}
    want = {tuple(r) for r in state.sliding_bars(events.timed(spark.createDataFrame(rows, events.EVENTS))).collect()}
    assert got == want and len(want) > 100


def test_one_event_per_key_and_day(spark, tmp_path):
    feed, out, checkpoint = folders(tmp_path)
    rows = [event(1, 5), event(2, 60), event(3, 1441), event(4, 10, user=2), event(5, 20, kind="b")]
    stream = events.timed(spark.readStream.schema(events.EVENTS).option("recursiveFileLookup", "true").parquet(feed))
    put(spark, feed, rows, events.EVENTS, "one")
    drain(state.once_per_day(stream, ["user_id", "event_type"]), out, checkpoint)
    put(spark, feed, [event(6, 90), event(7, 1500), event(8, 30, user=3)], events.EVENTS, "two")
    drain(state.once_per_day(stream, ["user_id", "event_type"]), out, checkpoint)
    got = {(r.user_id, r.event_type, r.day.day) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "a", 1), (1, "a", 2), (2, "a", 1), (1, "b", 1), (3, "a", 1)} and spark.read.parquet(out).count() == 5
    batch = state.once_per_day(events.timed(spark.createDataFrame(rows, events.EVENTS)), ["user_id", "event_type"])
    assert {(r.user_id, r.event_type, r.day.day, r.event_id) for r in batch.collect()} == {(1, "a", 1, 1), (1, "a", 2, 3), (2, "a", 1, 4), (1, "b", 1, 5)}


def test_running_values_after_a_restart(spark, tmp_path):
    schema = "symbol string, ts timestamp, close double, signal string"
    days = {s: [(s, START + dt.timedelta(days=i), 100.0 + (7 * i * k) % 13, ["HOLD", "BUY", "HOLD", "SELL", "HOLD", "EXIT"][(i * k) % 6]) for i in range(40)] for k, s in ((1, "A"), (5, "B"))}
    feed, out, checkpoint = folders(tmp_path)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(feed)
    for name, a, b in (("one", 0, 15), ("two", 15, 16), ("three", 10, 40)):  # the third brings days again
        put(spark, feed, [r for rows in days.values() for r in rows[a:b]], schema, name)
        drain(state.running(stream, late="30 days"), out, checkpoint)
    got = spark.read.parquet(out).toPandas().sort_values(["symbol", "ts"])
    for s, rows in days.items():
        mine = got[got["symbol"] == s]
        close = pd.Series([r[2] for r in rows])
        assert mine["ewm"].tolist() == pytest.approx(close.ewm(span=12, adjust=False).mean().tolist())
        held, want = 0, []
        for r in rows:
            held = 1 if r[3] == "BUY" else 0 if r[3] in ("SELL", "EXIT") else held
            want.append(held)
        assert mine["position"].tolist() == want
