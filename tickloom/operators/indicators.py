"""Indicators as window expressions over all symbols at once; each needs one shuffle and one sort by (symbol, ts)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bars_order, back, change, clip, last_bars, ratio, rolling

#: q ** -CHUNK must be a double for every span from 2.
CHUNK = 256


def zscore(df: DataFrame, window: int = 20, z_entry: float = 1.5, z_exit: float = 0.5) -> DataFrame:
    """z and signal; EXIT outranks SELL outranks BUY."""
    mean, sd = rolling(F.avg, "close", window), rolling(F.stddev_samp, "close", window)
    df = df.withColumn("z", ratio(F.col("close") - mean, sd))
    signal = F.when(F.abs("z") <= z_exit, "EXIT").when(F.col("z") >= z_entry, "SELL").when(F.col("z") <= -z_entry, "BUY").otherwise("HOLD")
    return df.withColumn("signal", signal)


def ma_crossover(df: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    df = df.withColumn("diff", rolling(F.avg, "close", fast) - rolling(F.avg, "close", slow)).withColumn("_before", back("diff"))
    signal = F.when((F.col("_before") >= 0) & (F.col("diff") < 0), "SELL").when((F.col("_before") <= 0) & (F.col("diff") > 0), "BUY").otherwise("HOLD")
    return df.withColumn("signal", signal).drop("_before")


def bollinger(df: DataFrame, window: int = 20, n_std: float = 2.0) -> DataFrame:
    """mid, upper, lower, pctb, width."""
    df = df.withColumn("mid", rolling(F.avg, "close", window)).withColumn("_sd", rolling(F.stddev_samp, "close", window))
    df = df.withColumn("upper", F.col("mid") + n_std * F.col("_sd")).withColumn("lower", F.col("mid") - n_std * F.col("_sd")).drop("_sd")
    band = F.col("upper") - F.col("lower")
    return df.withColumn("pctb", ratio(F.col("close") - F.col("lower"), band)).withColumn("width", ratio(band, "mid"))


def stochastic(df: DataFrame, window: int = 14, smooth: int = 3) -> DataFrame:
    low, high = rolling(F.min, "low", window), rolling(F.max, "high", window)
    df = df.withColumn("k", 100 * ratio(F.col("close") - low, high - low))
    return df.withColumn("d", rolling(F.avg, "k", smooth))


def stoch_bb(df: DataFrame, walk: int = 5, touches: int = 3, lookback: int = 10) -> DataFrame:
    """Stochastic and Bollinger bands with band walks: stochbb_score, walk_state, signal."""
    df = stochastic(bollinger(df))
    df = df.withColumn("_base", rolling(F.avg, "width", lookback, shift=1)).withColumn("_n", F.row_number().over(bars_order()))
    wide = F.coalesce(F.col("width") > F.col("_base"), F.lit(False))
    hits = lambda hit: F.sum(F.coalesce(hit, F.lit(False)).cast("int")).over(last_bars(walk))
    enough = F.col("_n") >= walk
    df = df.withColumn("_up", wide & enough & (hits(F.col("pctb") >= 0.85) >= touches)).withColumn("_down", wide & enough & (hits(F.col("pctb") <= 0.15) >= touches))
    score = clip((clip(2 * (0.5 - F.col("pctb")), -1.5, 1.5) + clip((50 - F.col("k")) / 50, -1.5, 1.5)) / 2, -1, 1)
    score = F.when(F.col("_up") & score.isNotNull(), F.greatest(score, F.lit(0.0))).otherwise(score)
    score = F.when(F.col("_down") & score.isNotNull(), F.least(score, F.lit(0.0))).otherwise(score)
    sell = (F.col("pctb") >= 0.9) & (F.col("k") >= 80) & (F.col("k") <= F.col("d")) & ~F.col("_up")
    buy = (F.col("pctb") <= 0.1) & (F.col("k") <= 20) & (F.col("k") >= F.col("d")) & ~F.col("_down")
    df = df.withColumn("stochbb_score", score).withColumn("walk_state", F.when(F.col("_down"), "down").when(F.col("_up"), "up"))
    return df.withColumn("signal", F.when(sell, "SELL").when(buy, "BUY").otherwise("HOLD")).drop("_base", "_n", "_up", "_down")


def rsi(df: DataFrame, window: int = 14) -> DataFrame:
    """Relative strength by simple means; null where nothing was lost."""
    df = df.withColumn("_d", F.col("close") - back("close"))
    gain = rolling(F.avg, F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), window)
    loss = rolling(F.avg, F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))), window)
    return df.withColumn("rsi", 100 - 100 / (1 + ratio(gain, loss))).drop("_d")


def atr(df: DataFrame, window: int = 14) -> DataFrame:
    """true_range and its mean over the close."""
    df = df.withColumn("_pc", back("close"))
    df = df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))).drop("_pc")
    return df.withColumn("atr_ratio", ratio(rolling(F.avg, "true_range", window), "close"))


def ewm_many(df: DataFrame, means: dict[str, tuple[str, int]]) -> DataFrame:
    """Exponential means, out -> (column without nulls, span), that start at the first value: y = a x + (1 - a) y before,
    a = 2 / (span + 1).

    All are windows over one shuffle. Within chunks of CHUNK bars a mean is a running sum of values scaled by q ** -place,
    q = 1 - a, times q ** place. The value at the end of a chunk adds those of the chunks before, found by lags of whole
    chunks and scaled by q ** CHUNK each, until their share is below the precision of a double; the next chunk inherits it.
    """
    order = bars_order()
    inside = Window.partitionBy("symbol", "_chunk").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    kept = df.columns
    df = df.withColumn("_n", F.row_number().over(order) - 1).withColumn("_chunk", F.floor(F.col("_n") / CHUNK)).withColumn("_k", (F.col("_n") % CHUNK).cast("double"))
    decay = {out: 1 - 2.0 / (span + 1) for out, (_, span) in means.items()}
    weight = lambda q: F.when(F.col("_n") == 0, 1.0).otherwise(1 - q)
    fading = {out: q for out, q in decay.items() if q > 0}
    df = df.withColumns({f"_{out}": F.sum(weight(q) * F.col(means[out][0]) * F.pow(F.lit(q), -F.col("_k"))).over(inside) * F.pow(F.lit(q), F.col("_k")) for out, q in fading.items()})

    def end(out: str, q: float):
        reach = math.ceil(60 * math.log(2) / (-CHUNK * math.log(q)))
        return sum((F.coalesce(F.lag(f"_{out}", j * CHUNK).over(order), F.lit(0.0)) * q ** (CHUNK * j) for j in range(1, reach + 1)), F.col(f"_{out}"))

    df = df.withColumns({f"_{out}_end": F.when(F.col("_k") == CHUNK - 1, end(out, q)) for out, q in fading.items()})
    carried = {out: F.coalesce(F.last(f"_{out}_end", ignorenulls=True).over(before), F.lit(0.0)) for out in fading}
    made = {out: (F.col(f"_{out}") + carried[out] * F.pow(F.lit(q), F.col("_k") + 1) if q > 0 else F.col(means[out][0])) for out, q in decay.items()}
    return df.select(*kept, *(c.alias(out) for out, c in made.items()))


def ewm(df: DataFrame, column: str, span: int, out: str) -> DataFrame:
    return ewm_many(df, {out: (column, span)})


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm_many(df, {"_fast": ("close", fast), "_slow": ("close", slow)}).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ewm(df, "macd", signal, "macd_signal")


def with_benchmark(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """bench: the benchmark's close on the same day, else the last one carried forward."""
    same = benchmark.select("ts", F.col("close").alias("_bench"))
    carried = F.last("_bench", ignorenulls=True).over(bars_order().rowsBetween(Window.unboundedPreceding, 0))
    return df.join(same, "ts", "left").withColumn("bench", carried).drop("_bench")


def relative_strength(df: DataFrame, window: int = 60) -> DataFrame:
    """rel_5, rel_20 and beta against the column bench."""
    df = df.withColumn("_r", change("close")).withColumn("_b", change("bench"))
    for n in (5, 20):
        df = df.withColumn(f"rel_{n}", change("close", n) - change("bench", n))
    w = last_bars(window)
    both = F.when(F.col("_r").isNotNull() & F.col("_b").isNotNull(), F.lit(1))
    beta = F.when(F.count(both).over(w) == window, ratio(F.covar_samp("_r", "_b").over(w), F.var_samp("_b").over(w)))
    return df.withColumn("beta", beta).drop("_r", "_b")


def ml_features(df: DataFrame) -> DataFrame:
    """The features of bars alone; relative_strength() adds those against a benchmark and macd() the MACD."""
    df = df.withColumn("ret_1", change("close"))
    for n in (3, 5, 10, 20):
        df = df.withColumn(f"ret_{n}", change("close", n))
    for n in (10, 20):
        df = df.withColumn(f"vol_{n}", rolling(F.stddev_samp, "ret_1", n))
    for n in (10, 20, 50):
        df = df.withColumn(f"ma_ratio_{n}", ratio("close", rolling(F.avg, "close", n)) - 1)
    df = zscore(stochastic(bollinger(atr(rsi(df))))).drop("signal", "mid", "upper", "lower", "width", "d", "true_range")
    df = df.withColumn("volume_ratio", ratio("volume", rolling(F.avg, "volume", 20))).withColumn("_mean", rolling(F.avg, "ret_1", 5))
    return df.withColumn("accel", F.col("_mean") - back("_mean", 5)).drop("_mean")


def bad_ticks(df: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Bars whose close moved by more than the threshold; flagged, not dropped."""
    return df.withColumn("ret", change("close")).where(F.abs("ret") > threshold)


def latest(df: DataFrame) -> DataFrame:
    """The last bar of each symbol. Summed up before the shuffle, unlike a ranked window."""
    rest = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("_last")).select("symbol", "_last.*")


def volatility_regime(df: DataFrame, window: int = 20, trading_days: int = 252, high: float = 0.40) -> DataFrame:
    df = df.withColumn("_ret", change("close"))
    df = latest(df.withColumn("annual_vol", F.stddev_samp("_ret").over(last_bars(window)) * F.sqrt(F.lit(float(trading_days)))))
    return df.select("symbol", "annual_vol", F.when(F.col("annual_vol") > high, "high").otherwise("normal").alias("regime"))


def pead(df: DataFrame, surprises: DataFrame, window_days: int = 60) -> DataFrame:
    """Drift score from the latest surprise (symbol, ts, surprise_pct) on or before each bar: an as-of join as one sorted
    pass over bars and surprises together."""
    marks = surprises.select("symbol", "ts", F.struct(F.col("ts").alias("at"), "surprise_pct").alias("_s"))
    both = df.withColumn("_bar", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("ts", F.col("_bar").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_s", F.last("_s", ignorenulls=True).over(order)).where("_bar")
    days = F.floor((F.unix_timestamp("ts") - F.unix_timestamp("_s.at")) / 86400)
    score = F.when(days <= window_days, clip(F.col("_s.surprise_pct") / 20, -1, 1) * (1 - days / window_days))
    return both.withColumn("earnings_score", score).drop("_s", "_bar")
