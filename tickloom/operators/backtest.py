"""Backtests: the vectorised one as window expressions, the event-driven one as a state machine per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio


def order():
    return Window.partitionBy("symbol", "strategy").orderBy("ts")


def so_far():
    return order().rowsBetween(Window.unboundedPreceding, 0)


#: Bars, and blocks of each level, whose product is taken first.
FAN = 16


def running_product(df: DataFrame, factor: Column, name: str, levels: int = 3) -> DataFrame:
    """Adds the product of factor over the bars up to each (n from 0), from blocks of FAN, FAN ** 2, ... bars, the largest first. A bar
    takes as many roundings as there are digits in its number, not bars before it: that shows where an account falls below the
    normal range of a double (2e-308) and a product of bar after bar keeps few digits."""
    end, of = F.col("n") + 1, ["symbol", "strategy"]
    upto = lambda group: Window.partitionBy(*of, group).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    full = lambda k: end % FAN**k == 0
    df = df.withColumn("_b0", factor)
    for k in range(1, levels + 1):
        df = df.withColumn(f"_b{k}", F.when(full(k), F.product(f"_b{k - 1}").over(upto(F.floor(F.col("n") / FAN**k)))))
    df = df.withColumn(f"_p{levels}", F.product(f"_b{levels}").over(so_far()))
    for k in reversed(range(levels)):
        start = F.when(full(k + 1), F.col(f"_p{k + 1}")).otherwise(F.col(f"_b{k}"))
        df = df.withColumn(f"_p{k}", F.product(start).over(upto(F.floor(end / FAN ** (k + 1)))))
    return df.withColumn(name, F.col("_p0")).drop(*(f"_{c}{k}" for c in "bp" for k in range(levels + 1)))


def run_positions(positions: DataFrame, fee_buy_bps: float = 20, fee_sell_bps: float = 30, slippage_bps: float = 5, capital: float = 100.0) -> DataFrame:
    """Adds n (bar number from 0), net (return after costs) and equity. A position decided on a bar earns from the next."""
    before = lambda c, k=1: F.coalesce(F.lag(c, k).over(order()), F.lit(0.0))
    df = positions.withColumn("position", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("position", F.lit(0.0)))))
    df = df.withColumn("n", F.row_number().over(order()) - 1).withColumn("_ret", F.coalesce(ratio("close", F.lag("close").over(order())) - 1, F.lit(0.0)))
    df = df.withColumn("_delta", before("position") - before("position", 2))
    cost = F.greatest("_delta", F.lit(0.0)) * (fee_buy_bps + slippage_bps) / 1e4 + F.greatest(-F.col("_delta"), F.lit(0.0)) * (fee_sell_bps + slippage_bps) / 1e4
    df = df.withColumn("net", before("position") * F.col("_ret") - cost)
    df = running_product(df, 1 + F.col("net"), "_grown")
    return df.withColumn("equity", F.when(F.col("n") == 0, F.lit(capital)).otherwise(F.col("_grown") * capital)).drop("_ret", "_delta", "_grown")


def trades_of(run: DataFrame) -> DataFrame:
    """symbol, strategy, entry, exit, return_pct, exit_reason: runs of bars in position, both ends included."""
    prev = F.lag("position").over(order())
    df = run.withColumn("_prev", prev).where("n >= 1")
    start = (F.col("position") > 0) & ((F.col("n") == 1) | (F.col("_prev") == 0))
    leave = (F.col("position") == 0) & (F.col("_prev") > 0) & (F.col("n") >= 2)
    df = df.withColumn("_trade", F.sum(start.cast("int")).over(so_far())).where((F.col("position") > 0) | leave)
    df = df.groupBy("symbol", "strategy", "_trade").agg(
        F.min("ts").alias("entry"), F.max("ts").alias("exit"), ((F.product(1 + F.col("net")) - 1) * 100).alias("return_pct"), F.min("position").alias("_least"),
    )
    return df.withColumn("exit_reason", F.when(F.col("_least") == 0, "signal").otherwise("open")).drop("_trade", "_least")


def metrics(run: DataFrame, trades: DataFrame, trading_days: float = 252.0) -> DataFrame:
    """One row per symbol and strategy."""
    df = run.withColumn("_daily", ratio("equity", F.lag("equity").over(order())) - 1).withColumn("_dd", F.col("equity") / F.max("equity").over(so_far()) - 1)
    base = df.groupBy("symbol", "strategy").agg(
        (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("_total"), F.avg("_daily").alias("_mean"), F.stddev_samp("_daily").alias("_sd"),
        (F.min("_dd") * 100).alias("max_drawdown_pct"), (F.avg("position") * 100).alias("exposure_pct"), F.count("_daily").alias("_n"),
    )
    months = df.where("_daily IS NOT NULL").groupBy("symbol", "strategy", F.trunc("ts", "month").alias("_month")).agg((F.product(1 + F.col("_daily")) - 1).alias("_ret"))
    span = F.months_between(F.max("_month"), F.min("_month")) + 1  # months without bars count, as no gain
    months = months.groupBy("symbol", "strategy").agg((F.count_if(F.col("_ret") > 1e-12) / span * 100).alias("consistency_pct"))
    r = F.col("return_pct")
    won, lost = F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0)))
    dealt = trades.groupBy("symbol", "strategy").agg(
        F.count(F.lit(1)).alias("n_trades"), (F.avg((r > 0).cast("double")) * 100).alias("win_rate_pct"), F.avg(r).alias("avg_trade_return_pct"),
        F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).when(won > 0, 3.0).otherwise(0.0).alias("profit_factor"),
    )
    df = base.where("_n >= 2").join(months, ["symbol", "strategy"], "left").join(dealt, ["symbol", "strategy"], "left")
    sharpe = F.when(F.col("_sd") > 0, F.col("_mean") / F.nullif(F.col("_sd"), F.lit(0.0)) * F.sqrt(F.lit(trading_days)))
    return df.select("symbol", "strategy", (F.col("_total") * 100).alias("total_return_pct"), sharpe.alias("sharpe_ratio"), "max_drawdown_pct", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "win_rate_pct", "profit_factor", "avg_trade_return_pct", "consistency_pct", "exposure_pct")


def tick_size(price: Column) -> Column:
    """Exchange tick by price tier (fixed values)."""
    return F.when(price < 200, 1).when(price < 500, 2).when(price < 2000, 5).when(price < 5000, 10).otherwise(25)


def lower_limit(price: Column) -> Column:
    """Daily lower price limit by price tier (fixed values)."""
    return F.when(price < 200, 0.25).when(price < 5000, 0.20).otherwise(0.15)


def locked_at_limit(df: DataFrame) -> DataFrame:
    """Adds locked: the close fell by the lower limit and stands at the low, so nobody buys."""
    df = df.withColumn("_pc", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))
    fell = ratio("close", "_pc") - 1 <= -lower_limit(F.col("_pc")) + 1e-9
    at_low = F.abs(F.col("close") - F.col("low")) <= 1e-8 + 1e-5 * F.abs("low")
    return df.withColumn("locked", F.coalesce(fell & at_low, F.lit(False))).drop("_pc")


def walk_forward(df: DataFrame, folds: int = 4, train_ratio: float = 0.7) -> DataFrame:
    """fold and part: equal runs of each symbol's bars (the last takes the rest), the first train_ratio of each for
    training. Folds with too few bars to train or test on are left out."""
    by = Window.partitionBy("symbol")
    df = df.withColumn("_i", F.row_number().over(by.orderBy("ts")) - 1).withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_size", F.floor(F.col("_n") / folds))
    df = df.withColumn("fold", F.least(F.floor(F.col("_i") / F.nullif(F.col("_size"), F.lit(0))), F.lit(folds - 1)).cast("int"))
    length = F.when(F.col("fold") == folds - 1, F.col("_n") - (folds - 1) * F.col("_size")).otherwise(F.col("_size"))
    cut = F.floor(length * train_ratio)
    df = df.where((cut > 30) & (length - cut > 10))
    return df.withColumn("part", F.when(F.col("_i") - F.col("fold") * F.col("_size") < cut, "train").otherwise("test")).drop("_i", "_n", "_size")
