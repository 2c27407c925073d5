"""One query per operator, over bars that Spark builds from the given tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import back, change, last_bars, ratio, rolling, rounded
from ..functions.store import shared_dir
from ..operators import arena, logs, stats
from ..operators import backtest as bt
from ..operators import boosting as boo
from ..operators import evaluation as eva
from ..operators import event_backtest as ev
from ..operators import garch as gar
from ..operators import indicators as ind
from ..operators import liquidity as liq
from ..operators import montecarlo as mc
from ..operators import parity as par
from ..operators import portfolio as pf
from ..operators import regression as reg
from ..operators import samples as smp
from ..operators import screener as screen
from ..operators import signals as sig
from ..operators import strategies as strat
from ..operators import weights as wts
from ..sources import bars as src
from ..sources import log_store
from ..streaming import events, state

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def daily(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """symbol, day and the columns, rounded: the shape of most results."""
    return rounded(df.select("symbol", F.to_date("ts").alias("day"), *columns), digits)


@query
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(src.bars_daily(spark, sf_dir), *src.COLUMNS)


@query
def bars_weekly_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(src.bars_weekly(spark, sf_dir), *src.COLUMNS)


@query
def bars_daily_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(src.bars_daily_region(spark, sf_dir), *src.COLUMNS)


@query
def bars_weekly_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(src.bars_weekly_segment(spark, sf_dir), *src.COLUMNS)


@query
def bars_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.bars_events(spark, sf_dir).select("symbol", F.unix_timestamp("ts").alias("hour"), *src.COLUMNS))


@query
def zscore_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(ind.zscore(src.bars_daily(spark, sf_dir)), "z", "signal")


@query
def ma_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(ind.ma_crossover(src.bars_daily(spark, sf_dir)), "diff", "signal")


@query
def composite_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(sig.composite(src.bars_daily(spark, sf_dir)), "composite", "signal")


@query
def flagship_latest_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last composite signal of every symbol, ranked; the rank runs over one row per symbol."""
    last = ind.latest(sig.composite(src.bars_daily(spark, sf_dir)))
    rank = F.row_number().over(Window.orderBy(F.col("composite").desc_nulls_last(), "symbol")).cast("long")
    return daily(last.withColumn("rank", rank), "close", "z", "composite", "signal", "rank")


@query
def bollinger_stoch_bandwalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(ind.stoch_bb(src.bars_daily(spark, sf_dir)), "pctb", "k", "d", "stochbb_score", "walk_state", "signal")


@query
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(ind.rsi(src.bars_daily(spark, sf_dir)), "rsi")


@query
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(ind.atr(src.bars_daily(spark, sf_dir)), "true_range", "atr_ratio")


@query
def macd_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(ind.macd(src.bars_daily(spark, sf_dir)), "macd", "macd_signal")


@query
def rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ind.with_benchmark(src.bars_daily(spark, sf_dir), src.benchmark_daily(spark, sf_dir))
    return daily(ind.relative_strength(bars), "rel_5", "rel_20", "beta")


@query
def regime_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ind.with_benchmark(src.bars_daily(spark, sf_dir), src.benchmark_daily(spark, sf_dir))
    return daily(sig.regime_gate(sig.composite(bars)), "regime_ok", "composite", "signal")


@query
def bad_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(ind.bad_ticks(src.bars_daily(spark, sf_dir)), "close", "ret")


@query
def vol_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.volatility_regime(src.bars_daily(spark, sf_dir)))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, surprise_pct: a quarter's mean order value against that of the quarter before."""
    rows = src.read_table(spark, sf_dir, "orders").join(src.read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    quarters = rows.groupBy(F.col("c_mktsegment").alias("symbol"), F.date_trunc("quarter", "o_orderdate").cast("timestamp").alias("ts")).agg(F.avg("o_totalprice").alias("actual"))
    quarters = quarters.withColumn("estimate", back("actual"))
    return quarters.withColumn("surprise_pct", ratio(F.col("actual") - F.col("estimate"), F.abs("estimate")) * 100).where("surprise_pct IS NOT NULL").select("symbol", "ts", "surprise_pct")


@query
def pead_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(ind.pead(src.bars_weekly_segment(spark, sf_dir), earnings(spark, sf_dir)), "earnings_score")


@query
def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ind.ml_features(src.bars_daily(spark, sf_dir))
    return daily(made, *(c for c in made.columns if c not in ("symbol", "ts", *src.COLUMNS)))


@query
def strategy_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(strat.positions(src.bars_daily(spark, sf_dir)), "strategy", "position")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.run_positions(strat.positions(src.bars_weekly(spark, sf_dir)))


@query
def vector_backtest_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity as a logarithm: on noisy prices it spans many orders of magnitude."""
    return daily(_run(spark, sf_dir).withColumn("log_equity", F.ln(F.col("equity") / 100)), "strategy", "net", "log_equity")


@query
def vector_backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = bt.trades_of(_run(spark, sf_dir))
    return rounded(trades.select("symbol", "strategy", F.to_date("entry").alias("entry"), F.to_date("exit").alias("exit"), F.ln(1 + F.col("return_pct") / 100).alias("log_return"), "exit_reason"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir).persist()  # read by three aggregations
    return bt.metrics(run, bt.trades_of(run))


@query
def arena_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return rounded(m.select("symbol", "strategy", F.ln(1 + F.col("total_return_pct") / 100).alias("log_total_return"), "sharpe_ratio", "max_drawdown_pct", "n_trades", "win_rate_pct", "consistency_pct", "exposure_pct"))


@query
def arena_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = arena.points(_metrics(spark, sf_dir))
    return rounded(made.select("symbol", "strategy", *(f"pts_{k}" for k in arena.WEIGHTS), "points"), 1)


@query
def league_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("result", F.bround("total_return_pct", 2))
    return arena.league(m, ("symbol",), "result").select("symbol", "strategy", F.col("place").cast("int"), F.col("league_points").cast("int"))


@query
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = bt.walk_forward(src.bars_daily(spark, sf_dir)).groupBy("symbol", "fold", "part")
    return folds.agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))


@query
def tick_and_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bt.locked_at_limit(src.bars_daily(spark, sf_dir))
    lots = (F.floor(F.lit(100000.0) / F.nullif(F.col("close"), F.lit(0.0)) / 100) * 100).cast("long")
    return daily(bars.withColumns({"tick": bt.tick_size(F.col("close")), "lower_limit": bt.lower_limit(F.col("close")), "lots": lots}), "tick", "lower_limit", "locked", "lots")


@query
def liquidity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(liq.liquidity_stats(src.bars_daily(spark, sf_dir)), 4)


@query
def spread_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spread estimators and their median."""
    return rounded(liq.spread_stats(src.bars_daily(spark, sf_dir)))


@query
def bar_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread estimators and their median at every bar, from the bars up to it."""
    return rounded(daily(liq.bar_spreads(src.bars_daily(spark, sf_dir)), "edge", "corwin_schultz", "roll", "consensus"))


@query
def liquidity_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(liq.liquidity_tier(src.bars_weekly(spark, sf_dir), "stock_us").select("symbol", "avg_turnover", "frozen_days_ratio", "tier"), 4)


@query
def accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(liq.accumulation(src.bars_weekly(spark, sf_dir)))


#: Days and paths of the simulation in a universe scan; alone it has its defaults of 30 days and 2000 paths.
SCANNED = {"n_days": 15, "n_sims": 1000}


@query
def gbm_paths_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mc.summarize(mc.gbm_paths(src.bars_weekly(spark, sf_dir))))


@query
def fan_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mc.fan_bands(mc.gbm_paths(src.bars_weekly(spark, sf_dir))))


@query
def closed_form_prob_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(mc.prob_up(src.bars_daily(spark, sf_dir)), "prob_up")


@query
def signal_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.signal_ic(sig.composite(src.bars_daily(spark, sf_dir)), "composite"))


@query
def pair_corr_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.pair_correlations(src.bars_weekly(spark, sf_dir)))


@query
def rolling_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.rolling_correlation(src.bars_daily(spark, sf_dir)).withColumn("ts", F.to_date("ts")).withColumnRenamed("ts", "day"))


@query
def monthly_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.monthly_returns(src.bars_daily(spark, sf_dir)))


# ---- screener, logs, events, portfolios


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of figures per brand; every fifth brand has no pe."""
    rows = src.read_table(spark, sf_dir, "lineitem").join(src.read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.count(F.lit(1))
    out = rows.groupBy(F.col("p_brand").alias("symbol")).agg(
        F.avg("p_size").alias("pe"), (F.avg("l_tax") * 50).alias("pbv"), (F.avg("l_discount") * 4).alias("roe"), F.nullif(n % 50, F.lit(0)).cast("double").alias("der"),
        (F.avg("l_discount") * 2).alias("profit_margin"), (F.avg("l_tax") - 0.03).alias("revenue_growth"), F.sum("l_quantity").alias("market_cap"),
    )
    nth = F.row_number().over(Window.orderBy("symbol"))  # one row per brand
    return out.withColumn("pe", F.when(nth % 5 != 0, F.col("pe")))


@query
def fundamental_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = screen.fundamental_score(fundamentals(spark, sf_dir))
    return rounded(scored.select("symbol", "fundamental_score", screen.format_amount(F.col("market_cap") * 1000).alias("market_cap_text")))


@query
def gainers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screen.gainers(src.bars_weekly(spark, sf_dir), 10, min_price=1.0))


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand with all that votes need."""
    bars = src.bars_weekly(spark, sf_dir)
    signals = sig.composite(bars)
    position = strat.latch(F.col("signal") == "BUY", F.col("signal") == "SELL")
    run = bt.run_positions(signals.select("symbol", "ts", "close", F.lit("composite").alias("strategy"), position.alias("position")))
    past = bt.trades_of(run).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), (F.avg((F.col("return_pct") > 0).cast("double")) * 100).alias("win_rate_pct"))
    volume = ind.latest(bars.withColumn("volume_ratio", ratio("volume", F.avg("volume").over(last_bars(20))))).select("symbol", "volume_ratio")
    out = ind.latest(signals).select("symbol", "close", "z", "composite")
    for part in (mc.summarize(mc.gbm_paths(bars, **SCANNED)).select("symbol", "prob_profit"), past, liq.liquidity_tier(bars, "stock_us").select("symbol", "tier"), screen.fundamental_score(fundamentals(spark, sf_dir)).select("symbol", "fundamental_score"), volume):
        out = out.join(part, "symbol", "left")
    return out


@query
def verdict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = screen.verdict(screen.vote(_scan(spark, sf_dir), w_fund=0.2))
    return rounded(made.select("symbol", "composite", "prob_profit", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "win_rate_pct", "tier", "fundamental_score", "overall", "component_spread", "verdict").orderBy(F.col("overall").desc(), "symbol"))


@query
def scalp_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screen.scalp_swing(_scan(spark, sf_dir)).select("symbol", "scalp", "swing"))


@query
def position_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = sig.composite(src.bars_daily(spark, sf_dir)).withColumn("_r", change("close"))
    vol = rolling(F.stddev_samp, "_r", 20) * F.sqrt(F.lit(252.0))
    return daily(bars.withColumn("size", sig.position_size(0.1, F.col("composite"), F.lit(0.6), vol)), "size")


@query
def news_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, their labels as entity scores, languages as symbols."""
    docs = src.read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    score = F.struct((F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_score"))
    labels = src.read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.collect_list(score).alias("entities"))
    articles = docs.join(labels, "doc_id").select(F.col("lang").alias("symbol"), F.col("doc_id").alias("article_id"), "entities")
    return rounded(screen.news_sentiment(articles))


@query
def universe_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of two sources: in both, in one alone, with a normalised code."""
    part = src.read_table(spark, sf_dir, "part")
    small, cheap = part.where("p_size <= 5").select("p_brand"), part.where("p_retailprice < 950").select("p_brand")
    tagged = small.intersect(cheap).withColumn("part", F.lit("both")).union(small.exceptAll(cheap).distinct().join(cheap, "p_brand", "left_anti").withColumn("part", F.lit("small"))).union(cheap.distinct().join(small, "p_brand", "left_anti").withColumn("part", F.lit("cheap")))
    return tagged.select(src.normalise_symbol(F.col("p_brand")).alias("symbol"), "part")


@query
def log_append_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of the days until 1998 and the rows that a second run adds."""
    rows = logs.signal_rows(sig.composite(src.bars_daily(spark, sf_dir)))
    log = rows.where("log_date < DATE'1998-01-01'")
    added = logs.fresh_rows(log, rows, ["symbol", "log_date"])
    return rounded(log.withColumn("run", F.lit(1)).unionByName(added.withColumn("run", F.lit(2))).select("symbol", F.col("log_date").alias("day"), "run", "verdict", "close_at_signal"))


@query
def log_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = src.bars_daily(spark, sf_dir)
    filled = logs.backfill(logs.signal_rows(sig.composite(bars)), bars)
    return rounded(filled.select("symbol", F.col("log_date").alias("day"), "fwd_return_pct"))


@query
def weekly_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.weekly_league(strat.positions(src.bars_daily(spark, sf_dir)))


@query
def event_tumbling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = events.tumbling_bars(events.timed(src.read_table(spark, sf_dir, "events")), "15 minutes")
    return rounded(made.withColumn("start", F.unix_timestamp("start")))


@query
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = events.sessions(events.timed(src.read_table(spark, sf_dir, "events")))
    return rounded(made.withColumns({"start": F.unix_timestamp("start"), "end": F.unix_timestamp("end")}), 4)


@query
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by the number in each event's JSON properties."""
    rows = src.read_table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return rounded(rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


EVENT_RULES = ev.Rules(stop_loss_pct=0.3, max_holding_days=30)


@query
def event_backtest_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the plain rules: next open, signal exits, costs."""
    trades = ev.plain_trades(sig.composite(src.bars_daily(spark, sf_dir)))
    return rounded(trades.withColumns({"entry": F.to_date("entry"), "exit": F.to_date("exit")}))


@query
def event_backtest_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics under stops and a holding limit; growth as a logarithm, because it spans many orders of magnitude."""
    signals = sig.composite(src.bars_weekly(spark, sf_dir))
    trades = ev.ruled_trades(signals, EVENT_RULES)
    made = ev.equity_metrics(ev.ruled_equity(signals, trades, EVENT_RULES), trades)
    return rounded(made.select("symbol", "log_total_return", "sharpe", "sortino", "max_drawdown_pct", "n_trades", "win_rate_pct", "avg_trade_pct"), 4)


LOT_RULES = ev.Rules(fee_buy_bps=15.0, fee_sell_bps=25.0, stop_loss_pct=0.1, max_holding_days=15, position_size_pct=0.05, lot_size=5, max_turnover_participation=0.2, next_open=False, capital=1e6)


@query
def event_backtest_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades in whole lots filled at the next close, no exits on locked days, a cap on turnover, and a flat slippage of each bar,
    one tick at least. Cash spans many orders of magnitude, so units and cash are logarithms."""
    signals = eva.effective_slippage(sig.composite(src.bars_daily(spark, sf_dir)).withColumn("consensus", F.lit(None).cast("double")))
    made = ev.run_trades(signals, LOT_RULES).withColumns({"entry": F.to_date("entry"), "exit": F.to_date("exit"), "log_units": F.ln("units"), "log_cash": F.ln("cash")})
    return rounded(made.select("symbol", "entry", "exit", "entry_price", "exit_price", "return_pct", "exit_reason", "slip_in", "slip_out", "log_units", "log_cash"), 4)


@query
def event_backtest_lots_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits and mean slippage of those accounts with slippage from the spreads so far; on these noisy prices most spreads are
    wider than the price, and such entries buy nothing."""
    signals = eva.effective_slippage(liq.bar_spreads(sig.composite(src.bars_daily(spark, sf_dir))))
    return rounded(ev.trade_costs(ev.run_trades(signals, LOT_RULES)), 4)


@query
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.robustness(ev.plain_trades(sig.composite(src.bars_daily(spark, sf_dir)))))


@query
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.iqr_outliers(ev.plain_trades(sig.composite(src.bars_daily(spark, sf_dir))))
    return rounded(out.select("symbol", F.to_date("entry").alias("entry"), "return_pct"))


@query
def portfolio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal and inverse-variance portfolios of the part types, which have weeks in common at every scale."""
    return rounded(pf.portfolio_stats(src.bars_weekly(spark, sf_dir, "p_type"), 52.0))


# ---- evaluation


@query
def ml_features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that need the MACD or a benchmark."""
    bars = ind.relative_strength(ind.with_benchmark(ind.macd(src.bars_daily(spark, sf_dir)), src.benchmark_daily(spark, sf_dir)))
    return daily(bars.withColumn("macd_hist_pct", ratio(F.col("macd") - F.col("macd_signal"), "close")), "macd_hist_pct", "rel_5", "rel_20", "beta")


@query
def extended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buying and holding each symbol against the benchmark."""
    bars = ind.with_benchmark(src.bars_daily(spark, sf_dir), src.benchmark_daily(spark, sf_dir))
    return rounded(eva.extended_metrics(bars.withColumn("equity", F.col("close"))))


def _plain_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.plain_trades(sig.composite(src.bars_daily(spark, sf_dir)))


@query
def trade_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eva.bootstrap_trades(_plain_trades(spark, sf_dir)))


@query
def trade_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eva.bootstrap_trades(_plain_trades(spark, sf_dir), block=5))


@query
def walk_forward_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = eva.expanding_folds(src.bars_daily(spark, sf_dir)).groupBy("symbol", "fold", "n_train")
    return folds.agg(F.count(F.lit(1)).alias("n_test"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))


@query
def fold_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite strategy within each fold of an expanding walk-forward."""
    signals = sig.composite(src.bars_daily(spark, sf_dir))
    held = signals.select("symbol", "ts", "close", strat.latch(F.col("signal") == "BUY", F.col("signal") == "SELL").alias("position"))
    return rounded(eva.fold_evaluation(eva.expanding_folds(held)).withColumns({"first_day": F.to_date("first_day"), "last_day": F.to_date("last_day")}))


@query
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eva.reliability_bins(eva.outcomes(src.bars_daily(spark, sf_dir)), "prob_up", "target"))


@query
def brier_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of the closed-form probability, and the weight that a vote of 0.3 keeps."""
    made = eva.brier_skill(eva.outcomes(src.bars_daily(spark, sf_dir)), "prob_up", "target")
    return rounded(made.withColumn("weight", eva.model_weight(0.3, F.col("confidence"))))


@query
def meta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(eva.meta_features(src.bars_daily(spark, sf_dir), _plain_trades(spark, sf_dir)), "vote_signal", "vote_mc", "vote_bt", "target")


@query
def parameter_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eva.plateau(src.bars_daily(spark, sf_dir)))


@query
def sharpe_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eva.sharpe_significance(_run(spark, sf_dir), len(strat.STRATEGIES)))


@query
def equal_weight_buy_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = eva.equal_weight_buy_hold(src.bars_daily(spark, sf_dir))
    return rounded(made.select(F.to_date("ts").alias("day"), "value", "n_symbols"))


@query
def drawdown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(eva.drawdowns(src.bars_daily(spark, sf_dir).withColumn("equity", F.col("close"))), "drawdown_pct", "under_water")


@query
def live_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = src.bars_daily(spark, sf_dir)
    return rounded(eva.live_ic(logs.backfill(logs.signal_rows(sig.composite(bars)), bars)))


@query
def effective_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = src.bars_daily(spark, sf_dir)
    made = eva.effective_slippage(liq.spread_stats(bars).join(ind.latest(bars).select("symbol", "close"), "symbol"))
    return rounded(made.select("symbol", "close", "slippage_bps"), 4)


@query
def journal_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal of the trades entered until 1999, closed by the exits that a later run knows."""
    trades = _plain_trades(spark, sf_dir)
    journal = logs.journal_rows(trades.where("entry < DATE'2000-01-01'"))
    closed = logs.close_rows(journal, trades.where("exit_reason = 'signal'"))
    return rounded(closed.select("symbol", F.to_date("entry").alias("entry"), "entry_price", F.to_date("exit").alias("exit"), "exit_price", "return_pct", "status"))


@query
def backtest_log_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of two runs of trades per symbol and year, without the rows of the years that are struck out."""
    trades = _plain_trades(spark, sf_dir)
    rows = trades.groupBy("symbol", F.year("exit").alias("year")).agg(F.count(F.lit(1)).alias("n_trades"), F.avg("return_pct").alias("avg_return_pct"))
    log = rows.where("year < 2000").unionByName(logs.fresh_rows(rows.where("year < 2000"), rows, ["symbol", "year"]))
    struck = rows.where("n_trades <= 2").select("symbol", "year")
    return rounded(logs.without_rows(log, struck, ["symbol", "year"]))


@query
def order_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets at the close before the last, and what they have gained at the last close."""
    last = ind.latest(src.bars_weekly(spark, sf_dir).withColumn("before", back("close")))
    made = screen.order_ticket(last.select("symbol", F.col("before").alias("close"), F.col("close").alias("now")))
    return rounded(made.select("symbol", F.col("close").alias("price"), "quantity", "value", ((F.col("now") - F.col("close")) * F.col("quantity")).alias("unrealised")), 4)


@query
def regime_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote with the weights of each symbol's volatility regime, and whether its parts disagree."""
    regimes = ind.volatility_regime(src.bars_weekly(spark, sf_dir), trading_days=52).select("symbol", "regime")
    made = screen.regime_vote(_scan(spark, sf_dir).join(regimes, "symbol"))
    return rounded(made.select("symbol", "regime", "overall", "agreement", "narrative"))


@query
def event_range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the events of its user in the hour before it: a range of time, as a window frame."""
    rows = src.read_table(spark, sf_dir, "events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = Window.partitionBy("user_id").orderBy("_us").rangeBetween(-3_600_000_000, -1)
    return rounded(rows.select("event_id", F.count(F.lit(1)).over(hour).alias("n_before"), F.coalesce(F.sum("value").over(hour), F.lit(0.0)).alias("value_before")), 4)


@query
def event_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.read_table(spark, sf_dir, "events")
    return rows.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n"))


@query
def calendar_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and mean closes of two sources of bars, by day: either may be missing. Sums are decimals, so their order does not matter."""
    total = F.sum(F.col("close").cast("decimal(24,6)")).cast("double")
    daily_close = lambda df, name: df.groupBy(F.to_date("ts").alias("day")).agg((total / F.count(F.lit(1))).alias(name))
    lines, orders = daily_close(src.bars_daily(spark, sf_dir), "line_close"), daily_close(src.bars_weekly_segment(spark, sf_dir), "order_close")
    return rounded(lines.join(orders, "day", "full_outer"), 4)


@query
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol the weeks without a bar between its first and its last: a generated calendar against the bars."""
    weeks = src.bars_weekly(spark, sf_dir).select("symbol", F.to_date("ts").alias("week"))
    spans = weeks.groupBy("symbol").agg(F.min("week").alias("low"), F.max("week").alias("high"))
    calendar = spans.select("symbol", F.explode(F.sequence("low", "high", F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return calendar.join(weeks, ["symbol", "week"], "left_anti")


@query
def preset_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last composite signal of each symbol under each preset, that of its mean reversion alone, the chance of a higher close
    after the days it simulates, and the folds that its test days make."""
    out, bars = None, src.bars_daily(spark, sf_dir)
    for name, p in screen.PRESETS.items():
        made = sig.composite(bars, **{k: p[k] for k in ("mr_window", "fast", "slow", "mr_weight")})
        reverting = ind.zscore(made.drop("z").withColumnRenamed("signal", "_signal"), p["mr_window"], p["mr_z_entry"]).withColumnsRenamed({"signal": "z_signal", "_signal": "signal"})
        folds = F.greatest(F.floor((F.count(F.lit(1)).over(Window.partitionBy("symbol")) - 100) / p["fold_test_days"]), F.lit(0)).cast("long")
        made = ind.latest(mc.prob_up(reverting, p["mc_days"]).withColumn("n_folds", folds)).select("symbol", F.lit(name).alias("preset"), "composite", "signal", "z_signal", "prob_up", "n_folds")
        out = made if out is None else out.unionByName(made)
    return rounded(out)


@query
def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.movers(src.bars_weekly(spark, sf_dir))


@query
def sentiment_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all brands and the sentiment of their news, which are the documents of the language that the last digit of their
    name points to."""
    last = ind.latest(sig.composite(src.bars_weekly(spark, sf_dir)))
    langs = F.array(*(F.lit(x) for x in ("de", "en", "es", "fr")))
    scored = last.select("symbol", F.get(langs, F.substring("symbol", -1, 1).cast("int") % 4).alias("lang"), ((F.col("composite") + 1) / 2).alias("overall"))
    docs = src.read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = src.read_table(spark, sf_dir, "labels").withColumn("_s", (F.col("quality") - F.col("toxic")).cast("double")).groupBy("doc_id").agg(F.avg("_s").alias("_s"))
    sentiment = docs.join(labels, "doc_id").groupBy(F.col("lang").alias("symbol")).agg(F.avg("_s").alias("sentiment"))
    return rounded(screen.enrich(scored, sentiment, "lang").select("symbol", "lang", "overall", "sentiment"))


@query
def universe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and pairs made of part columns: cleaned, filtered by quote, with a fall-back where a source is too short."""
    part = src.read_table(spark, sf_dir, "part").select(F.concat_ws(".", "p_brand", "p_size").alias("code"), F.concat(F.upper("p_type"), F.when(F.col("p_size") % 2 == 0, "/USDT").otherwise("/IDR")).alias("pair"))
    codes = src.first_with(100, src.clean_codes(part, "code"), src.clean_codes(part.limit(0), "code"))
    pairs = src.first_with(1_000, src.quoted_in(part, "pair", "USDT"), src.quoted_in(part, "pair", "IDR"))
    return codes.withColumn("kind", F.lit("code")).unionByName(pairs.withColumn("kind", F.lit("pair")))


@query
def precompute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan as one JSON document per symbol, written as a cache and read back."""
    rows = _scan(spark, sf_dir).select("symbol", sig.signal_of(F.col("composite")).alias("signal"), F.col("composite").alias("score"), F.col("prob_profit").alias("mc_prob_profit"), F.col("win_rate_pct").alias("win_rate"), F.col("tier").alias("liq_tier"))
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    log_store.write_cache(rows, path)
    return rounded(log_store.read_cache(spark, path))


@query
def log_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal log on disk that was written in two runs and filled in a third, a week and some days after most of its rows."""
    bars, path = src.bars_daily(spark, sf_dir), f"{shared_dir(spark)}/signal-log-{uuid.uuid4().hex}"
    rows = logs.signal_rows(sig.composite(bars)).where("log_date < DATE'1999-01-01'")
    for last in ("1998-01-01", "1999-01-01"):
        log_store.append(path, rows.where(F.col("log_date") < F.lit(last).cast("date")), log_store.SIGNAL_LOG, ["symbol", "log_date"], "log_date")
    log_store.fill_forward_returns(path, bars, dt.date(1999, 1, 3))
    return rounded(log_store.load(spark, path, log_store.SIGNAL_LOG).select("symbol", F.col("log_date").alias("day"), "verdict", "fwd_return_pct"))


@query
def skill_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eva.skill_bootstrap(eva.outcomes(src.bars_daily(spark, sf_dir)), "prob_up", "target"))


@query
def path_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mc.subsample(mc.gbm_paths(src.bars_weekly(spark, sf_dir))).select("symbol", "sim", "day", "price"))


@query
def random_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.random_portfolios(src.bars_weekly(spark, sf_dir, "p_type"), trading_days=52.0))


# ---- models over all symbols and folds


@query
def meta_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated logistic model of the three votes per symbol, tested walk-forward."""
    feats = eva.meta_features(src.bars_daily(spark, sf_dir), _plain_trades(spark, sf_dir))
    return rounded(reg.meta_model(feats.select("symbol", "ts", "vote_signal", "vote_mc", "vote_bt", "target")), 5)


#: What a trade's filter looks at on the day of its signal.
LABEL_FEATURES = ("composite", "z", "ret_5", "ret_20", "vol_20", "rsi", "atr_ratio", "volume_ratio")


def _label_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = sig.composite(src.bars_daily(spark, sf_dir)).withColumnsRenamed({"signal": "_signal", "z": "_z", "composite": "_composite"})
    made = ind.ml_features(bars).drop("z").withColumnsRenamed({"_signal": "signal", "_z": "z", "_composite": "composite"})
    return smp.meta_label_samples(made, LABEL_FEATURES)


@query
def meta_label_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of the composite signal, one position at a time, with what was known on the day of the signal."""
    return daily(_label_samples(spark, sf_dir), "n", "exit_n", "return_pct", "label", "composite", "z", "vol_20")


@query
def signalled_trades_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trades under a stop."""
    return daily(smp.signalled_trades(sig.composite(src.bars_daily(spark, sf_dir)), stop_loss_pct=0.2), "n", "exit_n", "return_pct", "label")


@query
def meta_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a filter learnt from past trades would have done on later ones."""
    return rounded(reg.meta_label_model(_label_samples(spark, sf_dir), LABEL_FEATURES), 5)


@query
def garch_paths_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility models of the part types' weeks, with and without a share of falls, and what 2000 paths of 30 weeks drawn from each say."""
    df = src.bars_weekly(spark, sf_dir, "p_type")
    fits = gar.fit_garch(df)
    paths = gar.garch_paths(df, fits).withColumn("symbol", F.struct("symbol", "gjr"))
    said = mc.summarize(paths).select("symbol.*", "s0", "median_final", "p_lower", "p_upper", "prob_profit", "var", "es")
    return rounded(fits.join(said, ["symbol", "gjr"]), 4)


#: What the trees look at, and fewer trees and refits than the definition has (150 of depth 4, every 20 bars): a level of a tree is a job.
TREE_FEATURES = ("ret_1", "ret_5", "ret_20", "vol_20", "ma_ratio_10", "ma_ratio_50", "rsi", "atr_ratio", "z", "volume_ratio")
TREES = {"n_trees": 10, "depth": 3, "rate": 0.1}


@query
def walk_forward_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a higher close after five bars by trees that are refitted every 250 bars, and that chance calibrated."""
    made = boo.walk_forward_classifier(ind.ml_features(src.bars_daily(spark, sf_dir)), TREE_FEATURES, retrain_every=250, horizon=5, **TREES)
    return daily(made, "fold", "tail", "target", "prob", "score", "calibrated", "judged", digits=5)


@query
def expected_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return over the next five bars that trees expect at each symbol's last bars."""
    return daily(boo.expected_return(ind.ml_features(src.bars_daily(spark, sf_dir)), TREE_FEATURES, horizon=5, **TREES), "expected", digits=5)


@query
def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal, least-variance and tangency weights of the part types, which have weeks in common at every scale."""
    return rounded(wts.closed_form_weights(src.bars_weekly(spark, sf_dir, "p_type"), trading_days=52.0))


@query
def hierarchical_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the leaves and weights of the part types by hierarchical risk parity."""
    return rounded(par.parity_weights(src.bars_weekly(spark, sf_dir, "p_type")))


@query
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three leading components of the part types' returns."""
    return rounded(wts.components(src.bars_weekly(spark, sf_dir, "p_type")), 5)


# ---- windows and keys of events as a stream keeps them


@query
def event_sliding_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of an hour that begin every quarter, added up from quarters."""
    made = state.sliding_bars(events.timed(src.read_table(spark, sf_dir, "events")))
    return rounded(made.withColumn("start", F.unix_timestamp("start")), 4)


@query
def event_once_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type on each day."""
    made = state.once_per_day(events.timed(src.read_table(spark, sf_dir, "events")), ["user_id", "event_type"])
    return rounded(made.select("user_id", "event_type", "day", "event_id", "value"), 4)
