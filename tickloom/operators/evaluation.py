"""How good signals, trades and models are: walk-forward folds, calibration, resampling, plateaus, benchmark metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bars_order, log_of, portable_int, ratio, so_far
from . import backtest as bt
from .event_backtest import iqr_outliers
from .montecarlo import prob_up
from .signals import composite
from .stats import average_rank, expected_max_sharpe, probabilistic_sharpe
from .strategies import latch

DAYS = 252.0


def extended_metrics(equity: DataFrame, trading_days: float = DAYS) -> DataFrame:
    """sortino, calmar, beta, alpha_annual_pct, benchmark_corr per symbol of equity(symbol, ts, equity, bench), where bench is
    the benchmark's close of the day or the last before it. Null where the reference values are undefined: under five
    returns nothing, under 21 common ones no comparison."""
    df = equity.withColumns({"_d": ratio("equity", F.lag("equity").over(bars_order())) - 1, "_b": ratio("bench", F.lag("bench").over(bars_order())) - 1})
    df = df.withColumn("_dd", F.col("equity") / F.max("equity").over(so_far()) - 1)
    both = F.col("_d").isNotNull() & F.col("_b").isNotNull()
    d, b = F.when(both, F.col("_d")), F.when(both, F.col("_b"))
    out = df.groupBy("symbol").agg(
        F.count("_d").alias("n"), F.avg("_d").alias("mean"), F.stddev_samp(F.when(F.col("_d") < 0, F.col("_d"))).alias("down"), F.min("_dd").alias("dd"),
        (F.max_by("equity", "ts") / F.min_by("equity", "ts")).alias("growth"), F.count(F.lit(1)).alias("bars"),
        F.count(d).alias("pairs"), F.covar_samp(d, b).alias("cov"), F.var_samp(b).alias("var"), F.avg(d).alias("md"), F.avg(b).alias("mb"), F.corr(d, b).alias("corr"),
    )
    compared = (F.col("pairs") > 20) & (F.col("var") > 0)
    beta = ratio("cov", "var")
    cagr = F.pow("growth", F.lit(trading_days) / F.col("bars")) - 1
    return out.where("n >= 5").select(
        "symbol", F.when(F.col("down") > 0, F.col("mean") / F.nullif("down", F.lit(0.0)) * F.sqrt(F.lit(trading_days))).alias("sortino"),
        F.when(F.col("dd") < 0, cagr / F.nullif(F.abs("dd"), F.lit(0.0))).alias("calmar"), F.when(compared, beta).alias("beta"),
        F.when(compared, (F.col("md") - beta * F.col("mb")) * trading_days * 100).alias("alpha_annual_pct"), F.when(compared, F.col("corr")).alias("benchmark_corr"),
    )


def resampled(rows: DataFrame, values: Mapping[str, Column], n_resamples: int, block: int, by: Sequence[str] = ("symbol",), more: DataFrame | None = None) -> DataFrame:
    """The first of by, sample, n (places drawn) and the sums of values over them: each resample draws as many places of rows(by, i)
    as a group has rows, in runs of block places. Draws are numbered, so reruns agree; of several columns of by, the last is a number
    that shifts its draws. more: by and n_resamples of the groups that get another number of resamples.

    Runs meet sums that rows hold of what follows them; only the last run, which ends where n places are drawn, meets its places. The
    hint has rows hashed and draws streamed: their number is unknown to the planner, which would send them all through the driver."""
    group = Window.partitionBy(*by)
    rows = rows.select(*by, "i", *(v.alias(c) for c, v in values.items())).withColumn("_long", F.count(F.lit(1)).over(group) > block)
    following = lambda c: F.when(F.col("_long"), F.sum(c).over(group.orderBy("i").rowsBetween(0, block - 1))).otherwise(F.col(c))
    sums = rows.select(*by, "i", F.struct(*values).alias("_one"), F.struct(*(following(c).alias(c) for c in values)).alias("_run"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("_samples", F.lit(n_resamples))
    if more is not None:
        sizes = sizes.join(more, list(by), "left").withColumn("_samples", F.coalesce("n_resamples", "_samples"))
    runs = F.when(F.col("n") > block, F.ceil(F.col("n") / block)).otherwise(F.col("n")) if block > 1 else F.col("n")
    length = F.when(F.col("n") > block, F.lit(block)).otherwise(1)
    draws = sizes.select(*by, "n", runs.alias("runs"), length.alias("length"), F.explode(F.sequence(F.lit(0), F.col("_samples") - 1)).alias("sample"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("j"))
    shift = F.col(by[-1]) * 1_000_003 if len(by) > 1 else F.lit(0)
    start = portable_int(F.col("sample") * F.col("runs") + F.col("j") + shift) % (F.col("n") - F.col("length") + 1)
    whole, left = F.col("j") < F.col("runs") - 1, F.col("n") - F.col("j") * F.col("length")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.when(whole, 0).otherwise(left - 1)))
    draws = draws.select(*by, "sample", start.alias("start"), whole.alias("_whole"), F.when(whole, F.col("length")).otherwise(1).alias("_places"), steps.alias("step"))
    draws = draws.select(*by, "sample", "_whole", "_places", (F.col("start") + F.col("step")).alias("i"))
    drawn = draws.join(sums.hint("shuffle_hash"), [*by, "i"]).withColumn("_got", F.when(F.col("_whole"), F.col("_run")).otherwise(F.col("_one")))
    return drawn.groupBy(by[0], "sample").agg(F.sum("_places").alias("n"), *(F.sum(F.col("_got")[c]).alias(c) for c in values))


def bootstrap_trades(trades: DataFrame, n_resamples: int = 1000, block: int = 1) -> DataFrame:
    """symbol, n_trades and percentiles of win rate and compounded growth over resamples of each symbol's trades in order of
    exit; with block > 1 runs of that many trades are drawn. Symbols with outliers among four trades or more get five times the
    resamples, 5,000 to 20,000. Growth is given as a logarithm: it spans many orders of magnitude."""
    boosted = min(max(5 * n_resamples, 5_000), 20_000)
    wild = iqr_outliers(trades).select("symbol").distinct().withColumn("n_resamples", F.lit(boosted))
    order = Window.partitionBy("symbol").orderBy("exit", "entry")
    nth = trades.select("symbol", (F.col("return_pct") / 100).alias("r"), (F.row_number().over(order) - 1).cast("long").alias("i"))
    samples = resampled(nth, {"win": F.when(F.col("r") > 0, 1.0).otherwise(0.0), "log_growth": log_of(1 + F.col("r"))}, n_resamples, block, more=wild)
    samples = samples.withColumn("win", F.col("win") / F.col("n") * 100)
    at = lambda c, p: F.percentile(c, F.lit(p / 100)).alias(f"{c}_p{p}")
    return samples.groupBy("symbol").agg(F.first("n").alias("n_trades"), F.count(F.lit(1)).alias("n_resamples"), *(at(c, p) for c in ("win", "log_growth") for p in (5, 25, 50, 75, 95)), F.avg("win").alias("win_mean"), F.avg("log_growth").alias("log_growth_mean"))


def skill_bootstrap(df: DataFrame, predicted: str, actual: str, n_resamples: int = 1000, block: int = 15) -> DataFrame:
    """symbol, n, percentiles of the skill score over resamples of blocks of days, which keep overlapping outcomes together, and
    whether the fifth is above zero. A resample with one outcome has no score."""
    known = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    nth = known.select("symbol", F.col(predicted).alias("p"), F.col(actual).alias("a"), (F.row_number().over(bars_order()) - 1).cast("long").alias("i"))
    samples = resampled(nth, {"brier": (F.col("p") - F.col("a")) * (F.col("p") - F.col("a")), "rate": F.col("a")}, n_resamples, block)
    samples = samples.withColumns({c: F.col(c) / F.col("n") for c in ("brier", "rate")})
    base = F.col("rate") * (1 - F.col("rate"))
    samples = samples.withColumn("skill", F.when(base > 1e-9, 1 - F.col("brier") / F.nullif(base, F.lit(0.0))))
    out = samples.groupBy("symbol").agg(F.first("n").alias("n"), *(F.percentile("skill", F.lit(p / 100)).alias(f"skill_p{p}") for p in (5, 50, 95)))
    return out.withColumn("significant", F.coalesce(F.col("skill_p5") > 0, F.lit(False)))


def expanding_folds(df: DataFrame, test_days: int = 60, min_train_days: int = 100, step_days: int | None = None) -> DataFrame:
    """The test rows of an expanding walk-forward, with fold (from 0) and n_train, the rows before the fold's test. Folds
    that overlap repeat rows; a fold without test_days rows is left out."""
    step, by = step_days or test_days, Window.partitionBy("symbol")
    if min_train_days <= 30 or test_days <= 5:
        raise ValueError("a fold needs more than 30 rows to train and 5 to test on")
    df = df.withColumn("_i", F.row_number().over(by.orderBy("ts")) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    at = F.col("_i") - min_train_days
    low, high = F.greatest(F.ceil((at - test_days + 1) / step), F.lit(0)), F.floor(at / step)
    df = df.where((at >= 0) & (high >= low)).withColumn("fold", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    df = df.withColumn("n_train", min_train_days + F.col("fold") * step)
    return df.where(F.col("n_train") + test_days <= F.col("_n")).drop("_i", "_n")


def fold_evaluation(folds: DataFrame, trading_days: float = DAYS) -> DataFrame:
    """Return, Sharpe and exposure of positions(symbol, ts, close, position, fold) within each fold: indicators have seen
    the history before the fold, the account begins with it."""
    run = bt.run_positions(folds.withColumn("strategy", F.col("fold").cast("string")))
    run = run.withColumn("_d", ratio("equity", F.lag("equity").over(bt.order())) - 1)
    out = run.groupBy("symbol", "fold").agg(
        F.min("ts").alias("first_day"), F.max("ts").alias("last_day"), ((F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1) * 100).alias("return_pct"),
        F.avg("_d").alias("_mean"), F.stddev_samp("_d").alias("_sd"), F.avg("position").alias("exposure"),
    )
    return out.withColumn("sharpe", F.when(F.col("_sd") > 0, ratio("_mean", "_sd") * F.sqrt(F.lit(trading_days)))).drop("_mean", "_sd")


def reliability_bins(df: DataFrame, predicted: str, actual: str, n_bins: int = 10) -> DataFrame:
    """bin, mean_predicted, mean_actual, n per symbol: bins between the distinct quantiles of the predictions; a symbol
    with fewer than three of those has one bin."""
    df = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    edges = df.groupBy("symbol").agg(F.percentile(predicted, F.array(*(F.lit(i / n_bins) for i in range(n_bins + 1)))).alias("_q")).withColumn("_q", F.array_distinct("_q"))
    inner = F.slice("_q", 2, F.greatest(F.size("_q") - 2, F.lit(0)))
    place = F.when(F.size("_q") < 3, 0).otherwise(F.size(F.filter(inner, lambda e: e < F.col(predicted))))
    rows = df.join(edges, "symbol").withColumn("bin", place)
    return rows.groupBy("symbol", "bin").agg(F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), F.count(F.lit(1)).alias("n"))


def brier_skill(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Brier score, that of the base rate, the skill and a confidence in [0, 1] per symbol."""
    p, a = F.col(predicted), F.col(actual)
    out = df.where(p.isNotNull() & a.isNotNull()).groupBy("symbol").agg(F.avg((p - a) * (p - a)).alias("brier"), F.avg(a).alias("_rate"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("brier_baseline", F.col("_rate") * (1 - F.col("_rate")))
    skill = F.when(F.col("brier_baseline") > 1e-9, 1 - F.col("brier") / F.nullif("brier_baseline", F.lit(0.0))).otherwise(0.0)
    return out.withColumn("skill", skill).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("skill")))).drop("_rate")


def outcomes(df: DataFrame, horizon: int = 15) -> DataFrame:
    """prob_up of each bar, and target: 1 if the close is higher `horizon` bars later, 0 if not, null if unknown."""
    later = F.lead("close", horizon).over(bars_order())
    return prob_up(df, horizon).withColumn("target", F.when(later > F.col("close"), 1.0).when(later.isNotNull(), 0.0))


def meta_features(df: DataFrame, trades: DataFrame, horizon: int = 15) -> DataFrame:
    """vote_signal, vote_mc, vote_bt, target of each bar: the composite score, the closed-form probability, and the share of
    winners among trades(symbol, exit, return_pct) closed by then, each from what the bar's day knew."""
    closed = trades.groupBy("symbol", F.col("exit").alias("ts")).agg(F.count(F.lit(1)).alias("_closed"), F.count_if(F.col("return_pct") > 0).alias("_won"))
    df = outcomes(composite(df), horizon).join(closed, ["symbol", "ts"], "left")
    share = ratio(F.sum("_won").over(so_far()), F.sum("_closed").over(so_far()))
    return df.withColumns({"vote_signal": (F.col("composite") + 1) / 2, "vote_mc": F.col("prob_up"), "vote_bt": share}).drop("_closed", "_won")


def plateau(df: DataFrame, windows: Sequence[int] = (15, 20, 25), base: int = 20, trading_days: float = DAYS, entries: Sequence[float] = (1.3, 1.5, 1.7), base_entry: float = 1.5) -> DataFrame:
    """param, value, offset, sharpe, is_base: Sharpe ratio of the composite strategy with neighbouring mean-reversion windows and entry
    levels. One pass makes all positions; the composite score does not look at the entry level, so those rows repeat the base."""
    made = df.select("symbol", "ts", "close")
    for w in windows:
        made = composite(made, mr_window=w).withColumn(f"w{w}", latch(F.col("signal") == "BUY", F.col("signal") == "SELL")).drop("z", "diff", "composite", "signal")
    long = made.unpivot(["symbol", "ts", "close"], [f"w{w}" for w in windows], "strategy", "position")
    run = bt.run_positions(long).withColumn("_d", ratio("equity", F.lag("equity").over(bt.order())) - 1)
    out = run.groupBy("symbol", "strategy").agg(F.avg("_d").alias("_mean"), F.stddev_samp("_d").alias("_sd"))
    sharpe = F.when(F.col("_sd") > 0, ratio("_mean", "_sd") * F.sqrt(F.lit(trading_days)))
    out = out.select("symbol", F.substring("strategy", 2, 9).cast("double").alias("value"), sharpe.alias("sharpe"))
    row = lambda param, value, origin: F.struct(F.lit(param).alias("param"), value.alias("value"), F.round(value - origin, 6).alias("offset"))
    at_entry = F.when(F.col("value") == base, F.array(*(row("mr_z_entry", F.lit(float(e)), base_entry) for e in entries)))
    both = F.concat(F.array(row("mr_window", F.col("value"), float(base))), F.coalesce(at_entry, F.array().cast("array<struct<param: string, value: double, offset: double>>")))
    out = out.select("symbol", "sharpe", F.inline(both))
    return out.select("symbol", "param", "value", "offset", "sharpe", (F.col("offset") == 0).alias("is_base"))


def sharpe_significance(run: DataFrame, trials: int) -> DataFrame:
    """Per symbol and strategy of a run: the daily Sharpe ratio, the probability that it exceeds zero, and the ratio that the best of
    so many trials reaches by chance."""
    df = run.withColumn("_d", ratio("equity", F.lag("equity").over(bt.order())) - 1)
    out = df.groupBy("symbol", "strategy").agg(F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s"), F.skewness("_d").alias("_skew"), (F.kurtosis("_d") + 3).alias("_kurt"), F.count("_d").alias("n"))
    out = out.where("_s > 0 AND n > 2").withColumn("sharpe", F.col("_m") / F.nullif("_s", F.lit(0.0)))
    return out.select("symbol", "strategy", "n", "sharpe", probabilistic_sharpe(F.col("sharpe"), F.col("n"), F.col("_skew"), F.col("_kurt")).alias("psr"), expected_max_sharpe(F.lit(trials), F.col("n")).alias("expected_max"))


def equal_weight_buy_hold(df: DataFrame, capital: float = 100.0) -> DataFrame:
    """ts, value, n_symbols: the mean over symbols of their closes relative to their first, each carried forward over days
    without a bar. The sum of carried values changes only by the bars of a day, so days are summed up first and the running sum
    goes over one row per day."""
    first, before = F.first("close").over(so_far()), F.lag("close").over(bars_order())
    moves = df.withColumn("_move", F.col("close") / first - F.coalesce(before / first, F.lit(0.0))).withColumn("_new", before.isNull().cast("long"))
    days = moves.groupBy("ts").agg(F.sum("_move").alias("_move"), F.sum("_new").alias("_new"))
    run = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("ts", (F.sum("_move").over(run) / F.sum("_new").over(run) * capital).alias("value"), F.sum("_new").over(run).alias("n_symbols"))


def drawdowns(equity: DataFrame) -> DataFrame:
    """drawdown_pct of each bar, and whether the bar is under water."""
    dd = F.col("equity") / F.max("equity").over(so_far()) - 1
    return equity.withColumn("drawdown_pct", dd * 100).withColumn("under_water", dd < 0)


def live_ic(log: DataFrame) -> DataFrame:
    """Rank correlation of logged scores with what followed, per symbol with ten filled rows or more."""
    rows = log.where("composite IS NOT NULL AND fwd_return_pct IS NOT NULL")
    ranked = rows.withColumn("_a", average_rank("composite", ("symbol",))).withColumn("_b", average_rank("fwd_return_pct", ("symbol",)))
    return ranked.groupBy("symbol").agg(F.corr("_a", "_b").alias("live_ic"), F.count(F.lit(1)).alias("n")).where("n >= 10")


def model_weight(base: float, confidence: Column, floor: float = 0.0) -> Column:
    """The weight of a model's vote, scaled by its confidence; unknown confidence leaves it as it is."""
    return F.greatest(F.lit(floor), F.lit(base) * F.coalesce(confidence, F.lit(1.0)))


def effective_slippage(spreads: DataFrame, flat_bps: float = 5.0, ticks: bool = True) -> DataFrame:
    """slippage_bps of each row of spreads(consensus, close), a symbol's last bar or, from bar_spreads(), every bar by what was known
    then: the estimated spread, or the flat rate where there is none, but with ticks one tick of a positive price at least."""
    slip = F.coalesce(F.col("consensus") * 1e4, F.lit(flat_bps))
    if not ticks:
        return spreads.withColumn("slippage_bps", slip)
    return spreads.withColumn("slippage_bps", F.greatest(slip, ratio(bt.tick_size(F.col("close")).cast("double"), "close") * 1e4))
