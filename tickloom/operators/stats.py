"""Statistical checks of signals and panels of returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bars_order, change, normal_cdf, ratio


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Rank with the mean of the places among equals."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*by, value)) - 1) / 2


def signal_ic(df: DataFrame, score: str, horizons: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Spearman correlation of the score with forward returns, per symbol and horizon."""
    forward = F.array(*(F.struct(F.lit(h).alias("horizon"), (ratio(F.lead("close", h).over(bars_order()), "close") - 1).alias("fwd")) for h in horizons))
    long = df.withColumn("_f", forward).select("symbol", F.col(score).alias("score"), F.inline("_f")).where("score IS NOT NULL AND fwd IS NOT NULL")
    ranked = long.withColumn("_a", average_rank("score", ("symbol", "horizon"))).withColumn("_b", average_rank("fwd", ("symbol", "horizon")))
    out = ranked.groupBy("symbol", "horizon").agg(F.corr("_a", "_b").alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    t = F.col("ic") * F.sqrt(F.nullif((F.col("n") - 2) / F.nullif(1 - F.col("ic") * F.col("ic"), F.lit(0.0)), F.lit(0.0)))
    return out.withColumn("t", t)


def probabilistic_sharpe(sharpe: Column, n: Column, skew: Column, kurt: Column, benchmark: float = 0.0) -> Column:
    """Probability that the true ratio exceeds the benchmark."""
    se = F.sqrt((1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / F.nullif((n - 1).cast("double"), F.lit(0.0)))
    return normal_cdf((sharpe - benchmark) / F.nullif(se, F.lit(0.0)))


def expected_max_sharpe(trials: Column, n: Column) -> Column:
    return F.when((trials >= 2) & (n >= 2), F.sqrt(2 * F.ln(trials.cast("double")) / (n - 1))).otherwise(0.0)


def returns(df: DataFrame) -> DataFrame:
    return df.withColumn("ret", change("close")).where("ret IS NOT NULL").select("symbol", "ts", "ret")


def pairs(rets: DataFrame) -> DataFrame:
    """a, b, ts, ra, rb for symbols a < b on common days."""
    left, right = (rets.select(F.col("symbol").alias(s), "ts", F.col("ret").alias(f"r{s}")) for s in "ab")
    return left.join(right, "ts").where("a < b")


def pair_correlations(df: DataFrame) -> DataFrame:
    return pairs(returns(df)).groupBy("a", "b").agg(F.corr("ra", "rb").alias("corr"), F.covar_samp("ra", "rb").alias("cov"), F.count(F.lit(1)).alias("n"))


def rolling_correlation(df: DataFrame, window: int = 60) -> DataFrame:
    w = Window.partitionBy("a", "b").orderBy("ts").rowsBetween(-(window - 1), 0)
    return pairs(returns(df)).withColumn("corr", F.when(F.count(F.lit(1)).over(w) == window, F.corr("ra", "rb").over(w))).select("a", "b", "ts", "corr")


def monthly_returns(df: DataFrame) -> DataFrame:
    """Returns of months against the close of the symbol's month before, one row per year and a column per month."""
    closes = df.groupBy("symbol", F.trunc("ts", "month").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    rets = returns(closes).select("symbol", F.year("ts").alias("year"), F.month("ts").alias("month"), "ret")
    return rets.groupBy("symbol", "year").pivot("month", list(range(1, 13))).agg(F.first("ret")).select("symbol", "year", *(F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)))
