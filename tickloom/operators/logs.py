"""Append-only logs as tables: idempotent appends, backfills and leagues read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bars_order, ratio
from . import arena
from .backtest import run_positions


def fresh_rows(log: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the log lacks, one per key: appending them twice adds nothing."""
    return rows.dropDuplicates(keys).join(log, keys, "left_anti")


def beyond_mark(log: DataFrame, rows: DataFrame, by: list[str], day: str) -> DataFrame:
    """The rows later than the log's last day for their group."""
    marks = log.groupBy(*by).agg(F.max(day).alias("_mark"))
    return rows.join(marks, by, "left").where(F.col("_mark").isNull() | (F.col(day) > F.col("_mark"))).drop("_mark")


def signal_rows(signals: DataFrame) -> DataFrame:
    """symbol, log_date, composite, verdict, close_at_signal of each symbol's days."""
    return signals.select("symbol", F.to_date("ts").alias("log_date"), "composite", F.col("signal").alias("verdict"), F.col("close").alias("close_at_signal"))


def backfill(log: DataFrame, bars: DataFrame, ahead: int = 5) -> DataFrame:
    """fwd_return_pct: the close `ahead` bars after the day of each row. The row's place among the bars is found by one sorted
    pass, not by comparing it with every later bar."""
    later = bars.withColumn("_fwd", F.lead("close", ahead - 1).over(bars_order())).select("symbol", F.to_date("ts").alias("log_date"), F.col("_fwd").alias("_next"))
    both = log.withColumn("_log", F.lit(True)).unionByName(later, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy(F.col("log_date").desc(), F.col("_log").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    # Going back in time with a day's log row before its bar, the last bar seen is the first after that day.
    seen = F.last(F.when(F.col("_log").isNull(), F.struct("_next")), ignorenulls=True).over(order)
    both = both.withColumn("_seen", seen).where("_log")
    return both.withColumn("fwd_return_pct", (ratio("_seen._next", "close_at_signal") - 1) * 100).drop("_log", "_next", "_seen")


def weekly_league(positions: DataFrame, min_days: int = 10) -> DataFrame:
    """League points of each week's returns by replay of logged positions, added up per symbol and strategy."""
    once = positions.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol", "strategy", "ts").orderBy("position"))).where("_rn = 1").drop("_rn")
    run = run_positions(once)
    long = run.groupBy("symbol", "strategy").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_days).drop("_n")
    weeks = run.join(long, ["symbol", "strategy"], "left_semi").groupBy("symbol", "strategy", F.date_trunc("week", "ts").alias("week")).agg(F.max_by("equity", "ts").alias("equity"))
    order = Window.partitionBy("symbol", "strategy").orderBy("week")
    rets = weeks.withColumn("ret", F.round(ratio("equity", F.lag("equity").over(order)) - 1, 9))
    placed = arena.league(rets, ("symbol", "week"), "ret")
    return placed.groupBy("symbol", "strategy").agg(F.sum("league_points").cast("long").alias("league_points"), F.count(F.lit(1)).alias("weeks"))


def journal_rows(trades: DataFrame) -> DataFrame:
    """Open entries of a journal: symbol, entry, entry_price, status."""
    return trades.select("symbol", "entry", "entry_price", F.lit("OPEN").alias("status"))


def close_rows(journal: DataFrame, exits: DataFrame) -> DataFrame:
    """The journal with the open entries that have an exit(symbol, entry, exit, exit_price) closed; closed ones stay."""
    done = exits.select("symbol", "entry", "exit", "exit_price")
    out = journal.join(done, ["symbol", "entry"], "left")
    status = F.when(F.col("exit").isNotNull(), "CLOSED").otherwise(F.col("status"))
    return out.withColumns({"return_pct": (ratio("exit_price", "entry_price") - 1) * 100, "status": status})


def without_rows(log: DataFrame, struck: DataFrame, keys: list[str]) -> DataFrame:
    return log.join(struck, keys, "left_anti")
