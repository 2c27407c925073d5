"""State kept between the batches of a stream: sliding windows from panes, one event per key and day, running means and positions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_bars(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """symbol, start, open, high, low, close, volume, total of windows of width that begin every slide; width is a multiple of
    slide. Events are summed up in panes of one slide, once, and panes are added up to windows, so state and shuffle hold panes and
    not a copy of each event per window. The same for a stream (in append mode) and for a table."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    key = F.struct("ts", "event_id")
    panes = events.groupBy(F.window("ts", slide).alias("pane"), F.col("event_type").alias("symbol")).agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.min_by("value", key).alias("open"), F.max_by("value", key).alias("close"),
        F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("volume"), F.sum("value").alias("total"),
    )
    return panes.groupBy(F.window(F.window_time("pane"), width, slide).alias("window"), "symbol").agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"), F.sum("volume").alias("volume"), F.sum("total").alias("total"),
    ).select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume", "total")


def once_per_day(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key and day that a stream brings; state of a key is dropped once the watermark passes it. Of a
    table, the event with the least time and event_id."""
    dated = events.withColumn("day", F.to_date("ts"))
    if events.isStreaming:
        return dated.withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "day"])
    rest = [c for c in dated.columns if c not in (*keys, "day")]
    return dated.groupBy(*keys, "day").agg(F.min_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_first")).select(*keys, "day", "_first.*")


RUNNING = "symbol string, ts timestamp, ewm double, position int"


def running(bars: DataFrame, span: int = 12, late: str = "0 seconds", idle: str = "30 days") -> DataFrame:
    """symbol, ts, ewm, position of a stream of bars(symbol, ts, close, signal): the exponential mean of closes that starts
    at the first, and 1 from a BUY to the next SELL or EXIT. A symbol's state is three values; it is dropped, and the
    symbol starts anew, when the watermark is `idle` past its last bar. Bars at or before a symbol's last one are passed over."""
    alpha, idle_ms = 2.0 / (span + 1), int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mean, position, last = state.get if state.exists else (None, 0, -1)
        out = []
        bars = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for ts, close, signal in zip(bars["ts"], bars["close"], bars["signal"]):
            at = ts.value // 1000
            if at <= last:
                continue
            mean = close if mean is None else alpha * close + (1 - alpha) * mean
            position = 1 if signal == "BUY" else 0 if signal in ("SELL", "EXIT") else position
            last = at
            out.append((key[0], ts, mean, position))
        if last >= 0:
            state.update((mean, position, last))
            state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["symbol", "ts", "ewm", "position"])

    grouped = bars.select("symbol", "ts", "close", "signal").withWatermark("ts", late).groupBy("symbol")
    return grouped.applyInPandasWithState(step, RUNNING, "ewm double, position int, last long", "append", GroupStateTimeout.EventTimeTimeout)
