"""Strategies: 0/1 positions decided with the bars so far. STRATEGIES is the registry; a strategy is a function from bars
with the columns of prepare() to a position column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import so_far, back, ratio, rolling
from . import indicators as ind
from .signals import composite


def latch(enter: Column, leave: Column) -> Column:
    """1 from an entry until an exit; entry and exit exclude each other on a bar."""
    mark = F.when(enter, 1.0).when(leave, 0.0)
    return F.coalesce(F.last(mark, ignorenulls=True).over(so_far()), F.lit(0.0))


def prepare(df: DataFrame) -> DataFrame:
    """Bars with the columns that the built-in strategies read."""
    df = ind.stoch_bb(df).withColumnRenamed("signal", "stochbb_signal")
    df = composite(df).withColumnRenamed("signal", "composite_signal")
    df = df.withColumn("ma_fast", rolling(F.avg, "close", 10)).withColumn("ma_slow", rolling(F.avg, "close", 30))
    return ind.rsi(ind.macd(df))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


STRATEGIES: dict[str, Callable[[], Column]] = {
    "buy_hold": lambda: F.lit(1.0),
    "ma_crossover": lambda: _flag(F.col("ma_fast") > F.col("ma_slow")),
    "rsi_reversion": lambda: latch(F.col("rsi") < 30, F.col("rsi") > 55),
    "macd_trend": lambda: _flag(F.col("macd") > F.col("macd_signal")),
    "bollinger_breakout": lambda: latch(F.col("close") > F.col("upper"), F.col("close") < F.col("mid")),
    "momentum_roc": lambda: _flag(ratio("close", back("close", 20)) - 1 > 0),
    "stoch_bb": lambda: latch(F.col("stochbb_signal") == "BUY", F.col("stochbb_signal") == "SELL"),
    "composite": lambda: latch(F.col("composite_signal") == "BUY", F.col("composite_signal").isin("SELL", "EXIT")),
}
BENCHMARK = "buy_hold"


def register(name: str, strategy: Callable[[], Column]) -> None:
    STRATEGIES[name] = strategy


def positions(df: DataFrame) -> DataFrame:
    """symbol, ts, close, strategy, position of every strategy: all are columns of one pass, then unpivoted."""
    wide = prepare(df).select("symbol", "ts", "close", *(make().cast("double").alias(name) for name, make in STRATEGIES.items()))
    return wide.unpivot(["symbol", "ts", "close"], list(STRATEGIES), "strategy", "position")
