"""Portfolios as aggregates over return rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import portable_int
from .stats import pairs, returns

def common_days(df: DataFrame) -> DataFrame:
    """Bars of the days on which every symbol has one."""
    k = df.select("symbol").distinct().count()
    full = df.groupBy("ts").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).select("ts")
    return df.join(full, "ts", "left_semi")


def portfolio_stats(df: DataFrame, trading_days: float = 252.0) -> DataFrame:
    """name, n_days, annual return and volatility, Sharpe ratio and worst drawdown of two portfolios over the common days,
    rebalanced every day: equal weights, and weights by inverse variance. All of it is aggregation: weights are a row per
    symbol, portfolios a row per day."""
    rets = returns(common_days(df))
    inverse = rets.groupBy("symbol").agg((1 / F.nullif(F.var_samp("ret"), F.lit(0.0))).alias("w"))
    total = inverse.agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("k"))
    kind = lambda name, w: F.struct(F.lit(name).alias("name"), w.alias("w"))
    weights = inverse.join(F.broadcast(total)).select("symbol", F.inline(F.array(kind("equal", 1 / F.col("k")), kind("inverse_variance", F.col("w") / F.col("total")))))
    days = rets.join(weights, "symbol").groupBy("name", "ts").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    order = Window.partitionBy("name").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("value", F.product(1 + F.col("ret")).over(order))
    days = days.withColumn("fall", F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(order)) - 1)
    out = days.groupBy("name").agg(F.count(F.lit(1)).alias("n_days"), (F.avg("ret") * trading_days).alias("annual_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(trading_days))).alias("annual_vol"), (F.min("fall") * 100).alias("max_drawdown_pct"))
    return out.withColumn("sharpe", F.col("annual_return") / F.nullif("annual_vol", F.lit(0.0)))


def random_portfolios(df: DataFrame, n: int = 4000, trading_days: float = 252.0) -> DataFrame:
    """portfolio, annual_return, annual_vol, sharpe of n portfolios with weights drawn evenly from all that add up to one
    (normalised exponentials of numbered draws). A portfolio's variance is summed over pairs of symbols, so the rows are n
    times the covariance matrix, spread by portfolio."""
    rets = returns(common_days(df))
    means = rets.groupBy("symbol").agg((F.avg("ret") * trading_days).alias("mean"), F.var_samp("ret").alias("cov"))
    nth = means.withColumn("nth", F.row_number().over(Window.orderBy("symbol")) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))  # one row per symbol
    drawn = nth.select("symbol", "mean", "nth", "k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("portfolio"))
    drawn = drawn.withColumn("x", -F.ln((portable_int(F.col("portfolio") * F.col("k") + F.col("nth") + 1) + 0.5) / 2147483647.0))
    drawn = drawn.withColumn("w", F.col("x") / F.sum("x").over(Window.partitionBy("portfolio"))).select("portfolio", "symbol", "mean", "w")
    cov = pairs(rets).groupBy("a", "b").agg((2 * F.covar_samp("ra", "rb")).alias("cov")).unionByName(means.select(F.col("symbol").alias("a"), F.col("symbol").alias("b"), "cov"))
    side = lambda s: drawn.select("portfolio", F.col("symbol").alias(s), F.col("w").alias(f"w{s}"))
    risk = side("a").join(cov, "a").join(side("b"), ["portfolio", "b"]).groupBy("portfolio").agg(F.sqrt(F.sum(F.col("wa") * F.col("wb") * F.col("cov")) * trading_days).alias("annual_vol"))
    gain = drawn.groupBy("portfolio").agg(F.sum(F.col("w") * F.col("mean")).alias("annual_return"))
    return gain.join(risk, "portfolio").withColumn("sharpe", F.col("annual_return") / F.nullif("annual_vol", F.lit(0.0)))
