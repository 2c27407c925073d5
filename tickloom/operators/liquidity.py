"""Liquidity, spread estimates and accumulation over the last bars of each symbol."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import back, clip, last_bars, log_of, ratio, rolling

#: Least daily turnover by kind of asset (fixed values); None is not judged.
THRESHOLDS = {"stock_id": 1_000_000_000, "stock_us": 1_000_000, "crypto": None}
HARD_TURNOVER, HARD_FROZEN = 0.25, 0.30


def recent(df: DataFrame, window: int = 20) -> DataFrame:
    """The last bars of each symbol, with their number _rn from the last (1)."""
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= window)


def liquidity_stats(df: DataFrame, window: int = 20) -> DataFrame:
    df = recent(df, window).withColumn("_turnover", F.col("close") * F.col("volume"))
    out = df.groupBy("symbol").agg(F.avg("_turnover").alias("avg_turnover"), F.percentile("_turnover", F.lit(0.5)).alias("median_turnover"), F.avg("volume").alias("avg_volume"), F.max_by("volume", "ts").alias("latest_volume"))
    return out.withColumn("volume_vs_avg_ratio", F.when(F.col("avg_volume") > 0, ratio("latest_volume", "avg_volume")))


def corwin_schultz(df: DataFrame, window: int = 20) -> DataFrame:
    k = 3 - 2 * math.sqrt(2)
    df = recent(df, window).withColumn("_h", back("high")).withColumn("_l", back("low"))
    square = lambda a, b: F.pow(log_of(ratio(a, b)), F.lit(2.0))
    beta = square("high", "low") + square("_h", "_l")
    gamma = square(F.greatest("high", "_h"), F.least("low", "_l"))
    df = df.withColumn("_beta", beta).withColumn("_gamma", F.when(F.col("_h").isNotNull(), gamma))
    alpha = (F.sqrt(2 * F.col("_beta")) - F.sqrt("_beta")) / k - F.sqrt(F.col("_gamma") / k)
    df = df.withColumn("_e", F.exp(alpha)).withColumn("_s", F.when(F.col("_e").isNotNull(), F.greatest(F.lit(0.0), 2 * (F.col("_e") - 1) / (1 + F.col("_e")))))
    return df.groupBy("symbol").agg(F.when(F.count(F.lit(1)) >= 3, F.avg("_s")).alias("corwin_schultz"))


def roll_spread(df: DataFrame, window: int = 20) -> DataFrame:
    df = recent(df, window).withColumn("_d", F.col("close") - back("close"))
    df = df.withColumn("_r", ratio(F.col("_d"), back("close"))).withColumn("_r1", back("_r"))
    cov = F.covar_samp("_r", "_r1")
    return df.groupBy("symbol").agg(F.when(cov < 0, 2 * F.sqrt(-cov)).alias("roll"))


def edge_spread(df: DataFrame, window: int = 20) -> DataFrame:
    """The efficient OHLC estimator; the first bar of the window only serves as the one before."""
    df = recent(df, window)
    for c in ("open", "high", "low", "close"):
        df = df.withColumn(f"_{c[0]}", log_of(c)).withColumn(f"_{c[0]}1", back(f"_{c[0]}"))
    df = df.withColumn("_m", (F.col("_h") + F.col("_l")) / 2).withColumn("_m1", back("_m")).where("_c1 IS NOT NULL")
    c = lambda x: F.col(f"_{x}")
    is_ = lambda x: x.cast("double")
    tau = is_((c("h") != c("l")) | (c("l") != c("c1")))
    df = df.withColumns({
        "_r1": c("m") - c("o"), "_r2": c("o") - c("m1"), "_r3": c("m") - c("c1"), "_r4": c("c1") - c("m1"), "_r5": c("o") - c("c1"), "_t": tau,
        "_po": tau * (is_(c("o") != c("h")) + is_(c("o") != c("l"))), "_pc": tau * (is_(c("c1") != c("h1")) + is_(c("c1") != c("l1"))),
    })
    means = df.groupBy("symbol").agg(*(F.avg(f"_{x}").alias(f"_a{x}") for x in ("r1", "r3", "r5", "t", "po", "pc")), F.sum("_t").alias("_st"))
    df = df.join(means, "symbol")
    dev = lambda k: c(f"r{k}") - ratio(c(f"ar{k}"), c("at")) * c("t")
    x1 = ratio(F.lit(-4.0), c("apo")) * dev(1) * c("r2") + ratio(F.lit(-4.0), c("apc")) * dev(3) * c("r4")
    x2 = ratio(F.lit(-4.0), c("apo")) * dev(1) * c("r5") + ratio(F.lit(-4.0), c("apc")) * dev(5) * c("r4")
    out = df.withColumn("_x1", x1).withColumn("_x2", x2).groupBy("symbol").agg(F.avg("_x1").alias("e1"), F.avg("_x2").alias("e2"), F.var_pop("_x1").alias("v1"), F.var_pop("_x2").alias("v2"), F.max("_st").alias("st"))
    both = F.col("v1") + F.col("v2")
    s2 = F.when(both > 0, (F.col("v2") * F.col("e1") + F.col("v1") * F.col("e2")) / F.nullif(both, F.lit(0.0))).otherwise((F.col("e1") + F.col("e2")) / 2)
    return out.select("symbol", F.when(F.col("st") >= 2, F.sqrt(F.abs(s2))).alias("edge"))


def median_of(*columns: str) -> Column:
    """The median of those columns that are known."""
    known = F.sort_array(F.filter(F.array(*columns), lambda x: x.isNotNull()))
    n = F.size(known)
    return (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2


def spread_stats(df: DataFrame, window: int = 20) -> DataFrame:
    frozen = recent(df, window).groupBy("symbol").agg(F.avg((F.abs(F.col("high") - F.col("low")) <= 1e-8 + 1e-5 * F.abs("low")).cast("double")).alias("frozen_days_ratio"))
    out = frozen
    for part in (edge_spread(df, window), corwin_schultz(df, window), roll_spread(df, window)):
        out = out.join(part, "symbol", "left")
    return out.withColumn("consensus", median_of("edge", "corwin_schultz", "roll"))


def bar_spreads(df: DataFrame, window: int = 20) -> DataFrame:
    """Adds edge, corwin_schultz, roll and consensus to every bar: spread_stats() of the bars up to it, in one exchange and sort.

    Quantities of a bar and the one before are made once; a window's first bar only serves as the one before, so they are
    averaged over window - 1 bars (serial covariances over window - 2). What depends on a window's own means is folded in the row.
    """
    k = 3 - 2 * math.sqrt(2)
    c = lambda x: F.col(f"_{x}")
    is_ = lambda x: x.cast("double")
    square = lambda a, b: F.pow(log_of(ratio(a, b)), F.lit(2.0))
    pairs, own = last_bars(window - 1), df.columns
    df = df.withColumns({"_o": log_of("open"), "_h": log_of("high"), "_l": log_of("low"), "_c": log_of("close"), "_ph": back("high"), "_pl": back("low"), "_pc": back("close"), "_bars": F.count(F.lit(1)).over(last_bars(window))})
    df = df.withColumn("_m", (c("h") + c("l")) / 2).withColumns({f"_{x}1": back(f"_{x}") for x in "hlcm"})
    tau = is_((c("h") != c("l")) | (c("l") != c("c1")))
    beta, gamma = square("high", "low") + square("_ph", "_pl"), F.when(c("ph").isNotNull(), square(F.greatest("high", "_ph"), F.least("low", "_pl")))
    grown = F.exp((F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k))
    df = df.withColumns({
        "_cs": F.when(grown.isNotNull(), F.greatest(F.lit(0.0), 2 * (grown - 1) / (1 + grown))), "_ret": ratio(F.col("close") - c("pc"), c("pc")),
        "_r1": c("m") - c("o"), "_r2": c("o") - c("m1"), "_r3": c("m") - c("c1"), "_r4": c("c1") - c("m1"), "_r5": c("o") - c("c1"), "_t": tau,
        "_po": tau * (is_(c("o") != c("h")) + is_(c("o") != c("l"))), "_pcl": tau * (is_(c("c1") != c("h1")) + is_(c("c1") != c("l1"))),
    })
    whole, parts = c("c1").isNotNull(), ("r1", "r2", "r3", "r4", "r5", "t")
    df = df.withColumn("_ret1", back("_ret")).withColumns({f"_a{x}": F.avg(F.when(whole, c(x))).over(pairs) for x in ("r1", "r3", "r5", "t", "po", "pcl")})
    df = df.withColumns({
        "_st": F.sum(F.when(whole, c("t"))).over(pairs), "_w": F.collect_list(F.when(whole, F.struct(*(c(x).alias(x) for x in parts)))).over(pairs),
        "corwin_schultz": F.when(c("bars") >= 3, F.avg("_cs").over(pairs)), "_cov": F.covar_samp("_ret", "_ret1").over(last_bars(window - 2)),
    })
    by_open, by_close = ratio(F.lit(-4.0), c("apo")), ratio(F.lit(-4.0), c("apcl"))
    dev = lambda r, i: r[f"r{i}"] - ratio(c(f"ar{i}"), c("at")) * r["t"]
    known = lambda x: F.filter(x, lambda v: v.isNotNull())
    df = df.withColumns({
        "_x1": known(F.transform("_w", lambda r: by_open * dev(r, 1) * r["r2"] + by_close * dev(r, 3) * r["r4"])), "_x2": known(F.transform("_w", lambda r: by_open * dev(r, 1) * r["r5"] + by_close * dev(r, 5) * r["r4"])),
    })
    total = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))
    df = df.withColumns({f"_e{i}": ratio(total(f"_x{i}", lambda x: x), F.size(f"_x{i}")) for i in (1, 2)})
    df = df.withColumns({f"_v{i}": ratio(total(f"_x{i}", lambda x, i=i: (x - c(f"e{i}")) * (x - c(f"e{i}"))), F.size(f"_x{i}")) for i in (1, 2)})
    both = c("v1") + c("v2")
    s2 = F.when(both > 0, (c("v2") * c("e1") + c("v1") * c("e2")) / F.nullif(both, F.lit(0.0))).otherwise((c("e1") + c("e2")) / 2)
    df = df.withColumns({"edge": F.when(c("st") >= 2, F.sqrt(F.abs(s2))), "roll": F.when(c("cov") < 0, 2 * F.sqrt(-c("cov")))})
    return df.select(*own, "edge", "corwin_schultz", "roll", median_of("edge", "corwin_schultz", "roll").alias("consensus"))


def liquidity_tier(df: DataFrame, asset_type: str, window: int = 20) -> DataFrame:
    out = liquidity_stats(df, window).join(spread_stats(df, window), "symbol")
    least = THRESHOLDS[asset_type]
    if least is None:
        return out.withColumn("tier", F.lit("liquid"))
    hard = (F.col("avg_turnover") < least * HARD_TURNOVER) | (F.col("frozen_days_ratio") >= HARD_FROZEN)
    return out.withColumn("tier", F.when(hard, "hard_illiquid").when(F.col("avg_turnover") < least, "thin").otherwise("liquid"))


def accumulation(df: DataFrame, vol_window: int = 20, obv_window: int = 15, squeeze_window: int = 60, lookback: int = 3) -> DataFrame:
    """Four components from 0 to 1 at the last bar, rounded to 3 digits, their mean and a flag."""
    every = last_bars(1 << 30)
    df = df.withColumn("_d", F.coalesce(F.col("close") - back("close"), F.lit(0.0))).withColumn("_step", F.signum("_d") * F.col("volume"))
    df = df.withColumn("_obv", F.sum("_step").over(every)).withColumn("_width", 4 * ratio(rolling(F.stddev_samp, "close", 20), rolling(F.avg, "close", 20)))
    df = df.withColumn("_vma", rolling(F.avg, "volume", vol_window)).withColumn("_v3", F.avg("volume").over(last_bars(lookback)))
    df = recent(df, max(vol_window, obv_window, squeeze_window))
    inside = lambda n, x: F.when(F.col("_rn") <= n, x)
    ret, last = F.col("_d"), lambda x: F.max_by(x, F.col("ts"))
    agg = df.groupBy("symbol").agg(
        last(F.col("_v3")).alias("v3"), last(F.col("_vma")).alias("vma"), last(F.col("close")).alias("c"), F.min_by(inside(obv_window, F.col("close")), inside(obv_window, F.col("ts"))).alias("c0"),
        F.regr_slope(inside(obv_window, F.col("_obv")), inside(obv_window, -F.col("_rn")).cast("double")).alias("slope"), F.stddev_samp(inside(vol_window - 1, F.col("_step"))).alias("sd"),
        last(F.col("_width")).alias("w"), F.count(inside(squeeze_window, F.col("_width"))).alias("nw"), F.collect_list(inside(squeeze_window, F.col("_width"))).alias("ws"),
        F.sum(inside(vol_window, F.when(ret > 0, F.col("volume")).otherwise(0.0))).alias("up"), F.sum(inside(vol_window, F.when(ret < 0, F.col("volume")).otherwise(0.0))).alias("down"),
    )
    rvol = clip((F.coalesce(ratio("v3", "vma"), F.lit(1.0)) - 1) / 2, 0, 1)
    slope = F.coalesce(ratio("slope", "sd"), F.lit(0.0))
    obv = clip(F.when(F.coalesce(ratio("c", "c0") - 1, F.lit(0.0)) < 0.05, slope).otherwise(slope * 0.3) / 3, 0, 1)
    below = F.size(F.filter("ws", lambda x: x < F.col("w"))) / F.nullif(F.col("nw").cast("double"), F.lit(0.0))
    squeeze = F.when(F.col("nw") >= squeeze_window, clip(1 - below, 0, 1)).otherwise(0.0)
    updown = F.coalesce(ratio("up", "down"), F.when(F.col("up") > 0, 2.0).otherwise(1.0))
    out = agg.select("symbol", F.bround(rvol, 3).alias("rvol"), F.bround(obv, 3).alias("obv_divergence"), F.bround(squeeze, 3).alias("squeeze"), F.bround(clip((updown - 1) / 2, 0, 1), 3).alias("up_down_volume"))
    mean: Column = (F.col("rvol") + F.col("obv_divergence") + F.col("squeeze") + F.col("up_down_volume")) / 4
    return out.withColumn("accumulation_score", mean).withColumn("flag", mean > 0.65)
