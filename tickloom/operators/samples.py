"""Trades that do not overlap, chosen by pointer doubling, and what was known when each was signalled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bars_order
from ..functions.store import stored


def chosen(candidates: DataFrame, at: str = "n", free: str = "free") -> DataFrame:
    """The rows of candidates(symbol, at, free, ...) that are taken one after the other: the first, then the first with
    at >= free of the one before, and so on. at is unique per symbol and free > at.

    Each row points to its successor, found in one sorted pass over starts and ends together. In round k a row points 2^k
    places on, and what the taken rows point to is taken too, so rounds grow with the logarithm of the longest chain.
    """
    marks = candidates.select("symbol", F.col(at).alias("_at"), F.inline(F.array(
        F.struct(F.col(at).alias("_when"), F.lit(1).alias("_start")), F.struct(F.col(free).alias("_when"), F.lit(0).alias("_start")),
    )))
    order = Window.partitionBy("symbol").orderBy(F.col("_when").desc(), F.col("_start").desc()).rowsBetween(Window.unboundedPreceding, -1)
    follows = F.last(F.when(F.col("_start") == 1, F.col("_when")), ignorenulls=True).over(order)
    jumps = stored(marks.withColumn("_to", follows).where("_start = 0").select("symbol", F.col("_at").alias("_from"), "_to"), "jumps")
    taken = stored(candidates.groupBy("symbol").agg(F.min(at).alias("_from")), "taken")
    while True:
        live = jumps.where("_to IS NOT NULL")
        new = taken.join(live, ["symbol", "_from"]).select("symbol", F.col("_to").alias("_from"))
        new = stored(new, "taken-next")
        if new.isEmpty():
            return candidates.join(taken, (candidates["symbol"] == taken["symbol"]) & (candidates[at] == taken["_from"]), "left_semi")
        taken = stored(taken.unionByName(new).distinct(), "taken")
        onward = live.select("symbol", F.col("_from").alias("_to"), F.col("_to").alias("_on"))
        jumps = stored(live.join(onward, ["symbol", "_to"]).select("symbol", "_from", F.col("_on").alias("_to")), "jumps")


def _first_stop(bought: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, n, stopped: the first bar from the entry to the bar that would end the trade whose low touches the stop. Only
    signals meet their bars, each those of its own trade."""
    path = bought.select("symbol", "n", "stop", F.explode(F.sequence(F.col("n") + 1, "ends")).alias("_bar"))
    touched = path.join(bars.select("symbol", F.col("n").alias("_bar"), "low"), ["symbol", "_bar"]).where("low <= stop")
    return touched.groupBy("symbol", "n").agg(F.min("_bar").alias("stopped"))


def signalled_trades(signals: DataFrame, fee_buy_bps: float = 20.0, fee_sell_bps: float = 30.0, slippage_bps: float = 5.0, stop_loss_pct: float | None = None, max_holding_days: int = 15) -> DataFrame:
    """symbol, ts (of the signal), n, exit_n, return_pct, label of the trades of buying signals, one position at a time.

    A trade enters at the next open and ends at the stop, at the open after a SELL or EXIT, or at the open after max_holding_days
    bars, whichever bar comes first; the last close ends what is open. label is 1 for a gain after costs. The next trade
    may be signalled on the bar that ended the one before. Bars and possible trades are stored, as rounds read them again and again:
    what the bars are made of is read once.
    """
    cost_in, cost_out = (fee_buy_bps + slippage_bps) / 1e4, (fee_sell_bps + slippage_bps) / 1e4
    order, every = bars_order(), Window.partitionBy("symbol")
    bars = signals.select("symbol", "ts", "open", "low", "close", "signal", (F.row_number().over(order) - 1).alias("n"), F.lead("open").over(order).alias("fill"))
    bars = bars.withColumn("last_n", F.max("n").over(every))
    leaves = F.when(F.col("signal").isin("SELL", "EXIT") & (F.col("n") < F.col("last_n")), F.col("n"))
    told = F.min(leaves).over(order.rowsBetween(1, max_holding_days + 1))
    bars = bars.withColumn("ends", F.least(told, F.col("n") + 1 + max_holding_days, "last_n"))
    bars = bars.withColumn("told", F.coalesce(told == F.col("ends"), F.lit(False)) | (F.col("ends") == F.col("n") + 1 + max_holding_days))
    bars = stored(bars, "signal-bars")
    bought = bars.where("signal = 'BUY' AND fill IS NOT NULL").withColumn("entry", F.col("fill") * (1 + cost_in))
    if stop_loss_pct:
        bought = bought.withColumn("stop", F.col("entry") * (1 - stop_loss_pct))
        bought = bought.join(_first_stop(bought, bars), ["symbol", "n"], "left")
    else:
        bought = bought.withColumns({"stop": F.lit(None).cast("double"), "stopped": F.lit(None).cast("int")})
    fills = F.col("stopped").isNull() & F.col("told") & (F.col("ends") < F.col("last_n"))
    bought = bought.withColumn("price_n", F.coalesce("stopped", F.when(fills, F.col("ends") + 1).otherwise(F.col("last_n"))))
    bought = bought.withColumn("free", F.greatest(F.col("price_n"), F.col("n") + 1))
    taken = chosen(stored(bought, "bought"), "n", "free")
    prices = bars.select("symbol", F.col("n").alias("price_n"), F.col("open").alias("_open"), F.col("close").alias("_close"))
    price = F.when(F.col("stopped").isNotNull(), F.col("stop")).when(F.col("told") & (F.col("ends") < F.col("last_n")), F.col("_open")).otherwise(F.col("_close"))
    out = taken.join(prices, ["symbol", "price_n"]).withColumn("return_pct", (price * (1 - cost_out) / F.col("entry") - 1) * 100)
    return out.select("symbol", "ts", "n", F.col("price_n").alias("exit_n"), "return_pct", (F.col("return_pct") > 0).cast("int").alias("label"))


def meta_label_samples(featured: DataFrame, features: Sequence[str], **rules) -> DataFrame:
    """The trades of featured(symbol, ts, open, low, close, signal, features), with the features of the signal's bar; trades with an
    unknown feature are left out, after the choice."""
    known: Column = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    bars = [c for c in ("symbol", "ts", "open", "low", "close", "signal") if c not in features]
    featured = stored(featured.select(*bars, *features), "featured")
    return signalled_trades(featured, **rules).join(featured.select("symbol", "ts", *features), ["symbol", "ts"]).where(known)
