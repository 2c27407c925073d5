"""Simulated paths and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import back, last_bars, log_of, normal_cdf, portable_int, portable_normal


def gbm_paths(df: DataFrame, n_days: int = 30, n_sims: int = 2000, mu_shrink: float = 1.0) -> DataFrame:
    """symbol, sim, day, s0, price by geometric Brownian motion with the drift and volatility of the log returns. Each draw
    has a number of its own, so results don't depend on partitions."""
    logs = df.withColumn("_r", log_of("close") - back(log_of("close")))
    stats = logs.groupBy("symbol").agg(F.max_by("close", "ts").alias("s0"), (F.avg("_r") * mu_shrink).alias("mu"), F.stddev_samp("_r").alias("sigma"))
    stats = stats.withColumn("_k", F.row_number().over(Window.orderBy("symbol")) - 1)  # one row per symbol
    sims = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))).alias("sim")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n_days))).alias("day"))
    draw = portable_normal((F.col("_k") * n_sims + F.col("sim")) * n_days + F.col("day"))
    steps = sims.withColumn("_step", F.col("mu") - 0.5 * F.col("sigma") * F.col("sigma") + F.col("sigma") * draw)
    walk = F.sum("_step").over(Window.partitionBy("symbol", "sim").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("price", F.col("s0") * F.exp(walk)).select("symbol", "sim", "day", "s0", "price")


def summarize(paths: DataFrame, confidence: float = 0.95) -> DataFrame:
    days = F.max("day").over(Window.partitionBy("symbol", "sim"))
    ends = paths.withColumn("_last", days).where("day = _last").withColumn("_ret", F.col("price") / F.col("s0") - 1)
    alpha = 1 - confidence
    at = lambda c, p: F.percentile(c, F.lit(p))
    out = ends.groupBy("symbol").agg(
        F.first("s0").alias("s0"), F.avg("price").alias("mean_final"), at("price", 0.5).alias("median_final"), at("price", alpha / 2).alias("p_lower"), at("price", 1 - alpha / 2).alias("p_upper"),
        F.avg((F.col("price") > F.col("s0")).cast("double")).alias("prob_profit"), (-at("_ret", alpha)).alias("var"),
    )
    tail = ends.join(out.select("symbol", "var"), "symbol").where(F.col("_ret") <= -F.col("var")).groupBy("symbol").agg((-F.avg("_ret")).alias("es"))
    return out.join(tail, "symbol", "left").withColumn("es", F.coalesce("es", "var"))


def fan_bands(paths: DataFrame, bands: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    return paths.groupBy("symbol", "day").agg(*(F.percentile("price", F.lit(b)).alias(f"p{round(b * 100)}") for b in bands))


def subsample(paths: DataFrame, n: int = 300) -> DataFrame:
    """n of each symbol's paths, chosen by a hash of their number: the same for every symbol and run."""
    sims = paths.select("sim").distinct().withColumn("_draw", portable_int(F.col("sim"))).orderBy("_draw", "sim").limit(n).select("sim")
    return paths.join(F.broadcast(sims), "sim", "left_semi")


def prob_up(df: DataFrame, horizon: int = 15, window: int = 90) -> DataFrame:
    """prob_up: closed form from the log returns of the window before each bar."""
    df = df.withColumn("_r", log_of("close") - back(log_of("close")))
    w = last_bars(window, shift=1)
    full = F.count("_r").over(w) == window
    df = df.withColumns({"_mu": F.when(full, F.avg("_r").over(w)), "_sd": F.when(full, F.stddev_samp("_r").over(w))})
    x = (F.col("_mu") - F.col("_sd") * F.col("_sd") / 2) * horizon / F.nullif(F.col("_sd") * F.sqrt(F.lit(float(horizon))), F.lit(0.0))
    return df.withColumn("_x", x).withColumn("prob_up", normal_cdf(F.col("_x"))).drop("_r", "_mu", "_sd", "_x")
