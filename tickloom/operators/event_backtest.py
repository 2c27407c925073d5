"""Event-driven backtest: one long position per symbol with stops, holding limits, lots, locked days, caps and slippage.

Where a position would end depends on its entry alone, so windows and one join of its own bars find the end of every
possible position. Which of these are taken, and with how much cash, depends on those before: a running pass over a symbol's
possible positions in order, which holds one account and no history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bars_order, last_bars, ratio, so_far
from .backtest import locked_at_limit


@dataclass(frozen=True)
class Rules:
    fee_buy_bps: float = 10.0
    fee_sell_bps: float = 10.0
    slippage_bps: float = 5.0
    stop_loss_pct: float | None = None
    max_holding_days: int | None = None
    position_size_pct: float = 1.0
    lot_size: int | None = None  # whole lots, and no exit on days locked at the limit
    max_turnover_participation: float | None = None
    next_open: bool = True
    capital: float = 100.0

    @property
    def buy_cost(self) -> float:
        return (self.fee_buy_bps + self.slippage_bps) / 1e4

    @property
    def sell_cost(self) -> float:
        return (self.fee_sell_bps + self.slippage_bps) / 1e4


def positions(signals: DataFrame, rules: Rules) -> DataFrame:
    """One row per buying signal that can be filled: the bars (n, x) and times (_e, _x) that decide its entry and exit, prices,
    reason, turnover so far, and the slippage of both sides: that of a column slippage_bps where signals has one, unknown as the flat rate.

    A position ends on the first bar after n that touches the stop, or whose order can be filled and is overdue or sells. With
    lots, a locked bar fills no stop and does nothing else, and a sale waits while the next bar is locked. No later than
    the first bar that ends it whatever its stop, so only the bars up to there are joined; without a stop, that bar alone.
    """
    order, backwards = bars_order(), Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    slip = F.col("slippage_bps").cast("double") if "slippage_bps" in signals.columns else F.lit(None).cast("double")
    df = locked_at_limit(signals).select(
        "symbol", "ts", "low", "close", "signal", (F.row_number().over(order) - 1).alias("n"), F.lead("open" if rules.next_open else "close").over(order).alias("fill"), F.lead("ts").over(order).alias("day"),
        F.coalesce(slip, F.lit(rules.slippage_bps)).alias("slip"), (F.col("locked") & F.lit(rules.lot_size is not None)).alias("barred"), F.avg(F.col("close") * F.col("volume")).over(last_bars(20)).alias("turnover"),
    )
    df = df.withColumns({"barred_next": F.lead("barred", 1, False).over(order), "slip_next": F.lead("slip").over(order)})
    df = df.withColumn("sells", F.coalesce(F.col("fill").isNotNull() & F.col("signal").isin("SELL", "EXIT") & ~F.col("barred_next"), F.lit(False)))
    sure = F.col("fill").isNotNull() & (~F.col("barred") if rules.stop_loss_pct is not None else F.lit(True))
    upcoming = lambda what, end: F.last(F.when(what, F.col("n")), ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, end))
    last = F.first(F.struct("n", "ts", "close", "slip")).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"told": upcoming(sure & F.col("sells"), -1), "open": upcoming(sure, 0), "last": last})
    reach = rules.max_holding_days
    overdue = F.lead("open", 1 + reach).over(order) if reach is not None else F.lit(None).cast("int")
    df = df.withColumn("until", F.least("told", overdue))
    stop = F.col("fill") * (1 - rules.stop_loss_pct) if rules.stop_loss_pct is not None else F.lit(None).cast("double")
    bought = df.where("signal = 'BUY' AND fill IS NOT NULL").select("symbol", "n", "ts", F.col("day").alias("entry"), F.col("fill").alias("entry_price"), stop.alias("stop"), "until", "turnover", F.col("slip").alias("slip_in"), "last")
    ends = F.coalesce("until", F.col("last.n"))
    path = bought.select("symbol", "n", "stop", F.explode(F.sequence(F.col("n") + 1 if rules.stop_loss_pct is not None else ends, ends)).alias("bar"))
    bars = df.where("day IS NOT NULL").select("symbol", F.col("n").alias("bar"), "ts", "low", "day", "fill", "slip", "slip_next", "barred", "sells")
    met = path.join(bars, ["symbol", "bar"]).withColumn("stopped", F.coalesce(F.col("low") <= F.col("stop"), F.lit(False)))
    late = F.col("bar") - F.col("n") - 1 >= reach if reach is not None else F.lit(False)
    due = F.col("fill").isNotNull() & (late | F.col("sells"))
    end = F.struct("bar", "ts", "day", "fill", "slip", "slip_next", "stopped", late.alias("late"))
    first = met.where(F.when(F.col("stopped"), ~F.col("barred")).otherwise(due)).groupBy("symbol", "n").agg(F.min(end).alias("end"))
    out = bought.join(first, ["symbol", "n"], "left")
    known = lambda at_stop, at_fill, otherwise: F.when(F.col("end.stopped"), at_stop).when(F.col("end").isNotNull(), at_fill).otherwise(otherwise)
    return out.select(
        "symbol", "n", F.coalesce("end.bar", "last.n").alias("x"), F.col("ts").alias("_e"), F.coalesce("end.ts", "last.ts").alias("_x"), "entry", known(F.col("end.ts"), F.col("end.day"), F.col("last.ts")).alias("exit"),
        "entry_price", known(F.col("stop"), F.col("end.fill"), F.col("last.close")).alias("exit_price"), known(F.lit("stop_loss"), F.when(F.col("end.late"), "max_holding_days").otherwise("signal"), F.lit("end_of_data")).alias("exit_reason"),
        "turnover", "slip_in", known(F.col("end.slip"), F.col("end.slip_next"), F.col("last.slip")).alias("slip_out"),
    )


def _taken(rules: Rules):
    """Passes over positions sorted by symbol and n: takes each that begins when none is held, if the cash buys a lot."""
    size, cap, lot = min(max(rules.position_size_pct, 0.01), 1.0), rules.max_turnover_participation, rules.lot_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, free, cash = None, 0, rules.capital
        for batch in batches:
            rows, units_of, idle_of, cash_of = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("symbol", "n", "x", "entry_price", "exit_price", "turnover", "slip_in", "slip_out"))
            for i, (name, n, x, paid, got, turnover, slip_in, slip_out) in enumerate(zip(*columns)):
                if name != symbol:
                    symbol, free, cash = name, 0, rules.capital
                if n < free:
                    continue
                budget = cash * size if cap is None or turnover is None else min(cash * size, cap * turnover)
                kept = 1 - (rules.fee_buy_bps + slip_in) / 1e4
                units = budget * kept / paid
                if lot:
                    units = float(math.floor(units / lot) * lot)
                    budget = units * paid / kept
                    if units <= 0:
                        continue
                idle = cash - budget
                cash = idle + units * got * (1 - (rules.fee_sell_bps + slip_out) / 1e4)
                free = x + 1
                rows.append(i)
                units_of.append(units)
                idle_of.append(idle)
                cash_of.append(cash)
            made = batch.take(pa.array(rows, pa.int64()))
            for column, values in (("units", units_of), ("idle", idle_of), ("cash", cash_of)):
                made = made.append_column(column, pa.array(values, pa.float64()))
            yield made

    return run


def run_trades(signals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The trades of each symbol's account: symbol, entry, exit, entry_price, exit_price, return_pct (gross), exit_reason; then _e and _x,
    the times of the bars that decide entry and exit, units, idle (cash left while held), cash (after the exit), slip_in and
    slip_out. A position whose cash buys no whole lot is not taken, and the next signal may be. Symbols without a trade have no row."""
    made = positions(signals, rules)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", units double, idle double, cash double"
    taken = made.repartition("symbol").sortWithinPartitions("symbol", "n").mapInArrow(_taken(rules), schema)
    price = (F.col("exit_price") / F.col("entry_price") - 1) * 100
    return taken.select("symbol", "entry", "exit", "entry_price", "exit_price", price.alias("return_pct"), "exit_reason", "_e", "_x", "units", "idle", "cash", "slip_in", "slip_out")


def run_equity(signals: DataFrame, trades: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """symbol, ts, equity from the trades of run_trades(): from the bar that decides an entry on, idle cash and the position's worth;
    from the one that decides its exit on, the cash. A symbol's last bar counts only if it closes a position."""
    nothing, final = F.lit(None).cast("double"), F.col("exit_reason") == "end_of_data"
    mark = lambda ts, units, cash, final: F.struct(F.col(ts).alias("ts"), units.alias("units"), cash.alias("cash"), final.alias("final"))
    marks = trades.select("symbol", F.inline(F.array(mark("_e", F.col("units"), F.col("idle"), F.lit(False)), mark("_x", nothing, F.col("cash"), final))))
    df = signals.select("symbol", "ts", "close", F.lead("ts").over(bars_order()).alias("_after")).join(marks.select("symbol", "ts", F.struct("units", "cash", "final").alias("mark")), ["symbol", "ts"], "left")
    df = df.withColumn("_state", F.last("mark", ignorenulls=True).over(so_far())).where(F.col("_after").isNotNull() | F.coalesce("mark.final", F.lit(False)))
    worth = F.col("_state.cash") + F.coalesce(F.col("_state.units") * F.col("close"), F.lit(0.0))
    return df.select("symbol", "ts", F.coalesce(worth, F.lit(rules.capital)).alias("equity"))


def trade_costs(trades: DataFrame) -> DataFrame:
    """symbol, effective_slippage_bps (mean over both sides of all trades), n_stop_loss and n_max_holding exits."""
    hit = lambda reason: F.count_if(F.col("exit_reason") == reason)
    return trades.groupBy("symbol").agg((F.avg(F.col("slip_in") + F.col("slip_out")) / 2).alias("effective_slippage_bps"), hit("stop_loss").alias("n_stop_loss"), hit("max_holding_days").alias("n_max_holding"))


def plain_trades(signals: DataFrame) -> DataFrame:
    """run_trades() for the rules without stops, limits, lots or locks, by windows alone: a position is the last of buying
    and selling signals that could be filled at the next open; what is still held is sold at the last close."""
    order, fill = bars_order(), F.lead("open").over(bars_order())
    mark = F.when(fill.isNull(), None).when(F.col("signal") == "BUY", 1).when(F.col("signal").isin("SELL", "EXIT"), 0)
    df = signals.select("symbol", "ts", "close", mark.alias("_mark"), fill.alias("_fill"), F.lead("ts").over(order).alias("_day"))
    df = df.withColumn("_held", F.coalesce(F.last("_mark", ignorenulls=True).over(so_far()), F.lit(0)))
    df = df.withColumn("_was", F.lag("_held", 1, 0).over(order)).withColumn("_trade", F.sum(((F.col("_held") == 1) & (F.col("_was") == 0)).cast("int")).over(so_far()))
    last = df.groupBy("symbol").agg(F.max_by(F.struct(F.col("ts").alias("day"), F.col("close").alias("price")), "ts").alias("_end"))
    order_of = lambda held: F.max(F.when((F.col("_held") == held) & (F.col("_was") == 1 - held), F.struct(F.col("_day").alias("day"), F.col("_fill").alias("price"))))
    deals = df.where("_trade > 0").groupBy("symbol", "_trade").agg(order_of(1).alias("_in"), order_of(0).alias("_out")).join(last, "symbol")
    out = F.coalesce("_out", "_end")
    return deals.select(
        "symbol", F.col("_in.day").alias("entry"), out["day"].alias("exit"), F.col("_in.price").alias("entry_price"), out["price"].alias("exit_price"),
        ((out["price"] / F.col("_in.price") - 1) * 100).alias("return_pct"), F.when(F.col("_out").isNull(), "end_of_data").otherwise("signal").alias("exit_reason"),
    )


def ruled_trades(signals: DataFrame, rules: Rules) -> DataFrame:
    """run_trades() for rules with a holding limit, with or without a stop, and without lots, locks or shares of turnover."""
    if rules.max_holding_days is None or rules.lot_size or rules.max_turnover_participation is not None or rules.position_size_pct != 1.0 or not rules.next_open:
        raise ValueError("run_trades() takes these rules")
    return run_trades(signals, rules)


def ruled_equity(signals: DataFrame, trades: DataFrame, rules: Rules) -> DataFrame:
    """run_equity() from the trades of ruled_trades()."""
    return run_equity(signals, trades, rules)


def equity_metrics(equity: DataFrame, trades: DataFrame, capital: float = 100.0, trading_days: float = 252.0) -> DataFrame:
    """Total return, CAGR, Sharpe, Sortino and drawdown of each symbol's equity, with its trades' counts."""
    df = equity.withColumn("_d", ratio("equity", F.lag("equity").over(bars_order())) - 1).withColumn("_dd", F.col("equity") / F.max("equity").over(so_far()) - 1)
    out = df.groupBy("symbol").agg(
        F.max_by("equity", "ts").alias("final"), F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("sd"), F.stddev_samp(F.when(F.col("_d") < 0, F.col("_d"))).alias("down"), (F.min("_dd") * 100).alias("max_drawdown_pct"),
    )
    counts = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), (F.avg((F.col("return_pct") > 0).cast("double")) * 100).alias("win_rate_pct"), F.avg("return_pct").alias("avg_trade_pct"))
    year = F.sqrt(F.lit(trading_days))
    return out.join(counts, "symbol", "left").select(
        "symbol", F.ln(F.col("final") / capital).alias("log_total_return"), ((F.col("final") / capital - 1) * 100).alias("total_return_pct"), ((F.pow(F.col("final") / capital, F.lit(trading_days) / F.col("n")) - 1) * 100).alias("cagr_pct"),
        (ratio("mean", "sd") * year).alias("sharpe"), (ratio("mean", "down") * year).alias("sortino"), "max_drawdown_pct", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "win_rate_pct", "avg_trade_pct",
    )


def robustness(trades: DataFrame) -> DataFrame:
    """Share of the largest trade in all gains, and whether the result hangs on it."""
    r = F.col("return_pct")
    out = trades.groupBy("symbol").agg(F.max(r).alias("largest"), F.sum(F.when(r > 0, r)).alias("gains"), F.count(F.lit(1)).alias("n"))
    share = ratio(F.greatest("largest", F.lit(0.0)), "gains")
    return out.select("symbol", "n", share.alias("largest_share"), F.coalesce((share > 0.5) & (F.col("n") >= 2), F.lit(False)).alias("concentrated"))


def iqr_outliers(trades: DataFrame) -> DataFrame:
    """Trades beyond 1.5 interquartile ranges from the quartiles of their symbol, where it has four or more."""
    fences = trades.groupBy("symbol").agg(F.percentile("return_pct", F.lit(0.25)).alias("q1"), F.percentile("return_pct", F.lit(0.75)).alias("q3"), F.count(F.lit(1)).alias("n")).where("n >= 4")
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return trades.join(fences, "symbol").where((F.col("return_pct") < F.col("q1") - spread) | (F.col("return_pct") > F.col("q3") + spread)).select(*trades.columns)
