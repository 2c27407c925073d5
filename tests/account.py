"""The bar-by-bar account that backtests are held to: a plain loop over one symbol's bars."""

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import bars_order, last_bars
from tickloom.operators.backtest import locked_at_limit
from tickloom.operators.event_backtest import Rules


class Account:
    """Cash, a position and the closed trades of one symbol."""

    def __init__(self, rules: Rules):
        self.rules, self.cash, self.units = rules, rules.capital, 0.0
        self.entry = self.stop = None  # entry: (bar, day, price)
        self.trades: list[tuple] = []

    def worth(self, price: float) -> float:
        return self.cash + self.units * price

    def buy(self, bar: int, day, price: float, turnover: float | None, slip: float) -> None:
        r = self.rules
        budget = self.cash * min(max(r.position_size_pct, 0.01), 1.0)
        if r.max_turnover_participation is not None and turnover is not None:
            budget = min(budget, r.max_turnover_participation * turnover)
        kept = 1 - (r.fee_buy_bps + slip) / 1e4
        units = budget * kept / price
        if r.lot_size:
            units = math.floor(units / r.lot_size) * r.lot_size
            budget = units * price / kept
        if units > 0 or not r.lot_size:
            self.cash -= budget
            self.units, self.entry = units, (bar, day, price)
            self.stop = price * (1 - r.stop_loss_pct) if r.stop_loss_pct is not None else None

    def sell(self, day, price: float, reason: str, slip: float) -> None:
        _, entered, paid = self.entry
        self.cash += self.units * price * (1 - (self.rules.fee_sell_bps + slip) / 1e4)
        self.trades.append((entered, day, paid, price, (price / paid - 1) * 100, reason))
        self.units, self.entry, self.stop = 0.0, None, None


def simulate(bars: pd.DataFrame, rules: Rules) -> tuple[list[float], list[tuple]]:
    """Equity per bar and trades (entry day, exit day, entry price, exit price, gross return in percent, reason)."""
    account, equity = Account(rules), []
    bars = bars if "slip" in bars else bars.assign(slip=rules.slippage_bps)
    rows = list(bars[["ts", "low", "close", "signal", "fill", "locked", "turnover", "slip"]].itertuples(index=False))
    known = lambda x: x is not None and not pd.isna(x)
    for i, (bar, after) in enumerate(zip(rows, rows[1:])):
        held = account.entry is not None
        barred = rules.lot_size is not None
        if held and account.stop is not None and known(bar.low) and bar.low <= account.stop:
            if not (barred and bar.locked):
                account.sell(bar.ts, account.stop, "stop_loss", bar.slip)
        elif not known(bar.fill):
            pass
        elif held and rules.max_holding_days is not None and i - account.entry[0] >= rules.max_holding_days:
            account.sell(after.ts, bar.fill, "max_holding_days", after.slip)
        elif not held and bar.signal == "BUY":
            account.buy(i + 1, after.ts, bar.fill, bar.turnover if known(bar.turnover) else None, bar.slip)
        elif held and bar.signal in ("SELL", "EXIT") and not (barred and after.locked):
            account.sell(after.ts, bar.fill, "signal", after.slip)
        equity.append(account.worth(bar.close))
    if account.entry is not None:
        account.sell(rows[-1].ts, rows[-1].close, "end_of_data", rows[-1].slip)
        equity.append(account.cash)
    return equity, account.trades


TRADES = "symbol string, entry timestamp, exit timestamp, entry_price double, exit_price double, return_pct double, exit_reason string"
EQUITY = "symbol string, ts timestamp, equity double"


def prepare(signals: DataFrame, rules: Rules) -> DataFrame:
    """Bars with a signal column, plus the fill price of orders given on a bar, locks and mean turnover so far."""
    df = locked_at_limit(signals).withColumn("fill", F.lead("open" if rules.next_open else "close").over(bars_order()))
    df = df.withColumn("slip", F.coalesce(F.col("slippage_bps") if "slippage_bps" in df.columns else F.lit(None), F.lit(rules.slippage_bps)))
    return df.withColumn("turnover", F.avg(F.col("close") * F.col("volume")).over(last_bars(20))).select("symbol", "ts", "low", "close", "signal", "fill", "locked", "turnover", "slip")


def _per_symbol(rules: Rules, part: str):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("ts")
        equity, trades = simulate(bars, rules)
        symbol = bars["symbol"].iloc[0]
        if part == "equity":
            return pd.DataFrame({"symbol": symbol, "ts": bars["ts"].iloc[: len(equity)].to_numpy(), "equity": equity})
        columns = ["entry", "exit", "entry_price", "exit_price", "return_pct", "exit_reason"]
        return pd.DataFrame(trades, columns=columns).assign(symbol=symbol)[["symbol", *columns]]

    return run


def run_trades(signals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return prepare(signals, rules).groupBy("symbol").applyInPandas(_per_symbol(rules, "trades"), TRADES)


def run_equity(signals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return prepare(signals, rules).groupBy("symbol").applyInPandas(_per_symbol(rules, "equity"), EQUITY)
