import datetime as dt
import math
import random

import account
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.expr import normal_cdf, portable_normal
from tickloom.operators import backtest as bt
from tickloom.operators import event_backtest as ev
from tickloom.operators import indicators as ind
from tickloom.operators import logs, montecarlo, screener, signals, stats, strategies
from tickloom.sources import bars as src
from tickloom.streaming import events

DAY = dt.datetime(2020, 1, 1)


def bars(spark, closes, symbol="A", volume=1000.0, days=None):
    rows = [(symbol, DAY + dt.timedelta(days=days[i] if days else i), c, c * 1.01, c * 0.99, c, volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def walk(n, seed=1):
    rng, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= math.exp(rng.gauss(0, 0.02))
        out.append(x)
    return out


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def test_warm_up_and_flat_prices(spark):
    z = column(ind.zscore(bars(spark, walk(21))), "z")
    assert z[:19] == [None] * 19 and z[19] is not None
    flat = bars(spark, [50.0] * 40)
    assert set(column(ind.zscore(flat), "z")) == {None} and set(column(ind.zscore(flat), "signal")) == {"HOLD"}
    assert set(column(ind.rsi(flat), "rsi")) == {None}
    assert set(column(ind.rsi(bars(spark, [float(i) for i in range(1, 60)])), "rsi")) == {None}


@pytest.mark.parametrize("chunk", [7, 512])
def test_ewm_equals_pandas(spark, monkeypatch, chunk):
    monkeypatch.setattr(ind, "CHUNK", chunk)
    closes = walk(60)
    got = column(ind.ewm(bars(spark, closes), "close", 12, "y"), "y")
    assert got == pytest.approx(pd.Series(closes).ewm(span=12, adjust=False).mean().tolist())


@pytest.mark.parametrize("make", [ind.zscore, ind.ma_crossover, ind.stoch_bb, ind.rsi, ind.atr, signals.composite, ind.ml_features, ind.macd])
def test_features_look_back_only(spark, make):
    closes, cut = walk(90), DAY + dt.timedelta(days=69)
    some = make(bars(spark, closes[:70])).orderBy("ts").collect()
    every = make(bars(spark, closes)).where(F.col("ts") <= cut).orderBy("ts").collect()
    for a, b in zip(some, every):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-9) if isinstance(x, float) else x == y


def test_latch_equals_a_loop(spark):
    rng = random.Random(4)
    marks = [rng.choice(["in", "out", None, None]) for _ in range(80)]
    df = bars(spark, walk(80)).join(spark.createDataFrame([(DAY + dt.timedelta(days=i), m) for i, m in enumerate(marks)], "ts timestamp, m string"), "ts")
    held, want = 0.0, []
    for m in marks:
        held = 1.0 if m == "in" else 0.0 if m == "out" else held
        want.append(held)
    assert column(df.withColumn("p", strategies.latch(F.col("m") == "in", F.col("m") == "out")), "p") == want


def test_positions_are_zero_or_one(spark):
    made = strategies.positions(bars(spark, walk(120)))
    assert {r.position for r in made.select("position").distinct().collect()} <= {0.0, 1.0}
    assert made.select("strategy").distinct().count() == len(strategies.STRATEGIES)


def test_normals_and_distribution_function(spark):
    z = np.array([r.z for r in spark.range(20_000).select(portable_normal(F.col("id")).alias("z")).collect()])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.02
    grid = spark.createDataFrame([(x / 4,) for x in range(-20, 21)], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-7 for r in grid)


# ---- the event backtest on hand-written days


def days(rows):
    out = pd.DataFrame(rows, columns=["open", "low", "close", "signal"])
    out["ts"] = pd.date_range("2020-01-01", periods=len(out))
    out["fill"] = out["open"].shift(-1)
    out["locked"], out["turnover"] = False, 1e6
    return out


FREE = dict(fee_buy_bps=0.0, fee_sell_bps=0.0, slippage_bps=0.0)


def test_entry_marks_equity_on_the_signal_bar_and_fills_next_open():
    equity, trades = account.simulate(days([(10, 9, 10, "BUY"), (20, 19, 22, "HOLD"), (30, 29, 30, "SELL"), (40, 39, 40, "HOLD")]), ev.Rules(**FREE))
    assert equity == pytest.approx([50.0, 110.0, 200.0])
    assert [(t[2], t[3], t[5]) for t in trades] == [(20, 40, "signal")]


def test_stop_fills_at_its_level_even_on_the_entry_day():
    _, trades = account.simulate(days([(10, 9, 10, "BUY"), (20, 5, 8, "HOLD"), (8, 8, 8, "HOLD")]), ev.Rules(stop_loss_pct=0.1, **FREE))
    assert [(t[3], t[5]) for t in trades] == [(18.0, "stop_loss")]


def test_holding_limit_lots_locks_and_last_day():
    table = days([(10, 9, 10, "BUY")] + [(10, 9, 10, "HOLD")] * 5)
    assert [t[5] for t in account.simulate(table, ev.Rules(max_holding_days=2, **FREE))[1]] == ["max_holding_days"]
    assert [t[5] for t in account.simulate(table, ev.Rules(**FREE))[1]] == ["end_of_data"]
    assert account.simulate(table, ev.Rules(lot_size=100, **FREE))[1] == []
    table = days([(1, 1, 1, "BUY"), (1, 1, 1, "SELL"), (1, 1, 1, "SELL"), (1, 1, 1, "HOLD")])
    table.loc[2, "locked"] = True
    trades = account.simulate(table, ev.Rules(lot_size=10, **FREE))[1]
    assert [(t[1].day, t[5]) for t in trades] == [(4, "signal")]


def test_gross_returns_and_costs():
    equity, trades = account.simulate(days([(10, 10, 10, "BUY"), (10, 10, 10, "SELL"), (10, 10, 10, "HOLD")]), ev.Rules())
    assert trades[0][4] == 0 and equity[-1] == pytest.approx(100 * (1 - 0.0015) ** 2)


# ---- tables


def test_idempotent_appends(spark):
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("A", 2), ("B", 1)], "symbol string, day int")
    once = logs.fresh_rows(rows.limit(0), rows, ["symbol", "day"])
    assert once.count() == 3 and logs.fresh_rows(once, rows, ["symbol", "day"]).count() == 0
    assert {(r.symbol, r.day) for r in logs.beyond_mark(rows.where("day = 1"), rows, ["symbol"], "day").collect()} == {("A", 2)}


def test_readers_of_payloads(spark):
    payload = '{"meta": {"symbol": "X"}, "values": [{"datetime": "2020-01-02", "open": "1", "high": "2", "low": "0.5", "close": "1.5", "volume": "10"}, {"datetime": "2020-01-03", "open": "bad", "high": "2", "low": "1", "close": "1", "volume": "1"}]}'
    rows = src.from_json_values(spark.createDataFrame([(payload,)], "payload string")).collect()
    assert [(r.symbol, r.close) for r in rows] == [("X", 1.5)]
    assert [r.s for r in spark.createDataFrame([("bbca",), ("TLKM.JK ",)], "s string").select(src.normalise_symbol(F.col("s")).alias("s")).collect()] == ["BBCA.JK", "TLKM.JK"]
    ms = spark.createDataFrame([("A", 1577923200000, 1.0, 1.0, 1.0, float("nan"), 1.0), ("A", 1577923200000, 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, ms long, open double, high double, low double, close double, volume double")
    assert [r.ts for r in src.from_epoch_rows(ms).collect()] == [dt.datetime(2020, 1, 2)]


def test_league_ties_go_by_name(spark):
    from tickloom.operators import arena

    rows = spark.createDataFrame([("A", s, r) for s, r in (("b", 1.0), ("a", 1.0), ("c", 2.0), ("d", None))], "symbol string, strategy string, ret double")
    got = {r.strategy: r.league_points for r in arena.league(rows, ("symbol",), "ret").collect()}
    assert got == {"c": 10, "a": 8, "b": 6}


def test_walk_forward_covers_all_bars(spark):
    folds = bt.walk_forward(bars(spark, walk(403)))
    assert folds.count() == 403 and folds.where("fold = 3").count() == 103


def test_parity_weights(spark):
    from tickloom.operators import parity, weights

    frames = bars(spark, walk(60, 1), "A").union(bars(spark, walk(60, 2), "B"))
    rows, closed = parity.parity_weights(frames).collect(), weights.closed_form_weights(frames).collect()
    assert sum(r.hrp for r in rows) == pytest.approx(1) and all(r.hrp > 0 for r in rows) and sum(r.gmv for r in closed) == pytest.approx(1)
    assert sorted(r.place for r in rows) == [0, 1]


def test_stream_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("A", 1), ("B", 1)], "symbol string, day int")
    rows.write.parquet(f"{tmp_path}/in")
    for k in range(2):  # a new checkpoint replays the same rows
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        events.append_once(stream, f"{tmp_path}/log", ["symbol", "day"], f"{tmp_path}/cp{k}").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


# ---- native backtests against the bar-by-bar account


def noisy_signals(spark, n=260, symbols=("A", "B", "C", "D")):
    frame = None
    for k, symbol in enumerate(symbols):
        rng, closes = random.Random(k), [math.exp(x) for x in np.cumsum(np.random.default_rng(k).normal(0, 0.08, n if k else 3))]
        rows = [(symbol, DAY + dt.timedelta(days=i), c * rng.uniform(0.9, 1.1), c * 1.1, c * rng.uniform(0.7, 1.0), c, 1e6, rng.choice(["BUY", "SELL", "EXIT", "HOLD", "HOLD", "HOLD", None])) for i, c in enumerate(closes)]
        part = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, signal string")
        frame = part if frame is None else frame.unionByName(part)
    return frame


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


TRADE = ("symbol", "entry", "exit", "entry_price", "exit_price", "return_pct", "exit_reason")


def near(a, b):
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b):
        assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
        assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)])


def test_plain_trades_equal_the_account(spark):
    signals = noisy_signals(spark)
    near(sorted_rows(ev.plain_trades(signals), *TRADE), sorted_rows(account.run_trades(signals), *TRADE))


LOTS = dict(lot_size=100, capital=5000.0)
RULES = [
    ev.Rules(stop_loss_pct=0.05), ev.Rules(stop_loss_pct=0.1, next_open=False), ev.Rules(max_holding_days=0), ev.Rules(position_size_pct=0.3, max_holding_days=4, stop_loss_pct=0.3),
    ev.Rules(**LOTS), ev.Rules(stop_loss_pct=0.08, max_holding_days=5, **LOTS), ev.Rules(stop_loss_pct=0.05, max_turnover_participation=0.05, position_size_pct=0.5, **LOTS),
    ev.Rules(max_turnover_participation=1e-5, capital=7.0), ev.Rules(stop_loss_pct=0.15, max_holding_days=9, next_open=False, lot_size=100, capital=300.0),
]


@pytest.mark.parametrize("rules", RULES, ids=range(len(RULES)))
def test_trades_and_equity_under_all_rules_equal_the_account(spark, rules):
    """Crashes that lock bars, unknown lows and opens, no volume, slippage of each bar, and cash that does not buy a lot."""
    signals = noisy_signals(spark).withColumn("_h", F.xxhash64("symbol", "ts"))
    hit = lambda k: F.pmod("_h", F.lit(k)) == 0
    signals = signals.withColumn("close", F.when(hit(5), F.col("low") * 0.7).otherwise(F.col("close"))).withColumn("low", F.when(hit(5), F.col("close")).when(~hit(11), F.col("low")))
    signals = signals.withColumns({"open": F.when(~hit(13), F.col("open")), "volume": F.when(hit(7), 0.0).when(~hit(17), F.col("volume") / 100), "slippage_bps": F.when(~hit(4), F.pmod("_h", F.lit(90)).cast("double"))}).drop("_h")
    trades = ev.run_trades(signals, rules)
    near(sorted_rows(trades, *TRADE), sorted_rows(account.run_trades(signals, rules), *TRADE))
    near(sorted_rows(ev.run_equity(signals, trades, rules), "symbol", "ts", "equity"), sorted_rows(account.run_equity(signals, rules), "symbol", "ts", "equity"))


def test_no_signals_no_trades(spark):
    signals = noisy_signals(spark, 30).withColumn("signal", F.lit("HOLD"))
    trades = ev.run_trades(signals, ev.Rules(stop_loss_pct=0.1))
    assert trades.count() == 0 and ev.run_trades(signals.limit(0)).count() == 0
    assert {r.equity for r in ev.run_equity(signals, trades).collect()} == {100.0}


@pytest.mark.parametrize("rules", [ev.Rules(stop_loss_pct=0.1, max_holding_days=7), ev.Rules(max_holding_days=3), ev.Rules(stop_loss_pct=0.02, max_holding_days=30, capital=7.0)])
def test_ruled_trades_and_equity_equal_the_account(spark, rules):
    signals = noisy_signals(spark)
    trades = ev.ruled_trades(signals, rules)
    near(sorted_rows(trades, *TRADE), sorted_rows(account.run_trades(signals, rules), *TRADE))
    near(sorted_rows(ev.ruled_equity(signals, trades, rules), "symbol", "ts", "equity"), sorted_rows(account.run_equity(signals, rules), "symbol", "ts", "equity"))


def test_ruled_trades_refuse_other_rules(spark):
    with pytest.raises(ValueError, match="run_trades"):
        ev.ruled_trades(noisy_signals(spark, 20), ev.Rules(lot_size=100, max_holding_days=3))


def test_blocks_of_a_bootstrap(spark):
    from tickloom.operators import evaluation as eva

    rows = [("A", DAY, DAY + dt.timedelta(days=i), float(i)) for i in range(23)] + [("B", DAY, DAY, 5.0)]
    trades = spark.createDataFrame(rows, "symbol string, entry timestamp, exit timestamp, return_pct double")
    for block in (1, 5, 40):
        got = {r.symbol: r for r in eva.bootstrap_trades(trades, 200, block).collect()}
        assert got["A"].n_trades == 23 and got["A"].win_p5 <= got["A"].win_p50 <= got["A"].win_p95 <= 100
        assert (got["B"].n_trades, got["B"].win_mean) == (1, 100.0) and got["B"].log_growth_mean == pytest.approx(math.log(1.05))


@pytest.mark.parametrize("block", [1, 4, 5, 23, 40])
def test_resamples_are_never_sent_through_the_driver(spark, block):
    """Places drawn with replacement are many times the rows, which a planner that can't count them would broadcast."""
    from tickloom.operators import evaluation as eva

    def draw(i, p=2**31 - 1):
        x = (48271 * (i % p) + 12345) % p
        x = (x * x + 16807 * (i % p) + 1) % p
        return (x * x + 69621) % p

    sizes = {("A", 0): 20, ("A", 3): 7, ("B", 0): 23, ("C", 1): 1}
    value = {(s, f, i): (f + 1) * 100.0 + i for (s, f), n in sizes.items() for i in range(n)}
    rows = spark.createDataFrame([(*k, v) for k, v in value.items()], "symbol string, fold long, i long, v double").repartition(3)
    more = spark.createDataFrame([("C", 1, 9)], "symbol string, fold long, n_resamples int")
    made = eva.resampled(rows, {"v": F.col("v")}, 6, block, by=("symbol", "fold"), more=more)
    got = {(r.symbol, r["sample"]): (r.n, r.v) for r in made.collect()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "symbol#" in plan
    assert not any("BroadcastHashJoin" in line and "i#" in line for line in plan.splitlines())
    want = {}
    for (s, f), n in sizes.items():
        length, runs = (block, -(-n // block)) if n > block else (1, n)
        for k in range(9 if s == "C" else 6):
            places = [draw(k * runs + j + f * 1_000_003) % (n - length + 1) + x for j in range(runs) for x in range(length)][:n]
            before = want.get((s, k), (0, 0.0))
            want[s, k] = (before[0] + n, before[1] + sum(value[s, f, i] for i in places))
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)


def test_accounts_below_the_normal_range_equal_sql(spark):
    """A product of bar after bar has other digits there than SQL's, and weekly leagues other places."""
    import duckdb

    rng = random.Random(5)
    moves = [(DAY + dt.timedelta(days=i), rng.uniform(0.2, 0.9)) for i in range(1400)]
    closes = {"A": 1e300, "B": 1.0}
    rows = []
    for i, (ts, m) in enumerate(moves):
        for s in closes:
            closes[s] *= m if s == "A" and i < 1250 or i % 3 else 1 / m
            rows.append((s, ts, closes[s], "x", 1.0))
    made = bt.run_positions(spark.createDataFrame(rows, "symbol string, ts timestamp, close double, strategy string, position double").repartition(3))
    made = made.select("symbol", "n", "net", "equity").orderBy("symbol", "n").toPandas()
    for s in ("A", "B"):
        run = made[made["symbol"] == s]
        want = duckdb.sql("SELECT CASE WHEN n = 0 THEN 100 ELSE product(1 + net) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) * 100 END AS equity FROM run ORDER BY n").fetchall()
        got, want = run["equity"].tolist(), [r[0] for r in want]
        assert all(g == w if abs(w) < 1e-300 else g == pytest.approx(w, rel=1e-11) for g, w in zip(got, want))
        assert len(got) == len(want) == 1400
    low = made[made["symbol"] == "A"]["equity"]
    assert ((low > 0) & (low < 1e-310)).sum() > 5 and (low == 0).sum() > 5


def test_every_symbol_gets_its_sentiment(spark):
    scored = spark.createDataFrame([(f"S{i:02}", "en" if i % 2 else "xx", None if i == 3 else i / 40) for i in range(40)], "symbol string, lang string, overall double")
    sentiment = spark.createDataFrame([("en", 0.25), ("de", 0.5)], "symbol string, sentiment double")
    got = {r.symbol: (r.overall, r.sentiment) for r in screener.enrich(scored, sentiment, "lang").collect()}
    assert got == {f"S{i:02}": (None if i == 3 else i / 40, 0.25 if i % 2 else None) for i in range(40)}


def test_overlapping_folds(spark):
    from tickloom.operators import evaluation as eva

    made = eva.expanding_folds(bars(spark, walk(100)), test_days=20, min_train_days=40, step_days=10).orderBy("fold", "ts").collect()
    want = [(f, DAY + dt.timedelta(days=40 + 10 * f + i)) for f in range(5) for i in range(20)]
    assert [(r.fold, r.ts) for r in made] == want and {(r.fold, r.n_train) for r in made} == {(f, 40 + 10 * f) for f in range(5)}
    assert eva.expanding_folds(bars(spark, walk(50))).count() == 0

def test_spreads_of_every_bar_equal_those_of_the_bars_so_far(spark):
    """Frozen bars, a price of zero, and the first bars, whose windows are not full."""
    from tickloom.operators import evaluation, liquidity

    rng, rows = random.Random(4), []
    for s in ("A", "B"):
        for i, c in enumerate(walk(70, 3 if s == "A" else 8)):
            o, c = (c, c) if rng.random() < 0.2 else (c * rng.uniform(0.99, 1.01), c)
            rows.append((s, DAY + dt.timedelta(days=i), o, max(o, c) * (1 if o == c else 1.01), min(o, c) * (0 if s == "B" and i == 40 else 1), c, 1000.0))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double").cache()
    made = {(r.symbol, r.ts): r for r in evaluation.effective_slippage(liquidity.bar_spreads(df), ticks=False).collect()}
    assert len(made) == 140
    for n in (1, 2, 3, 4, 19, 20, 21, 45, 70):
        day = DAY + dt.timedelta(days=n - 1)
        for want in liquidity.spread_stats(df.where(F.col("ts") <= day)).collect():
            got = made[want.symbol, day]
            for c in ("edge", "corwin_schultz", "roll", "consensus"):
                assert (got[c] is None) == (want[c] is None) and (got[c] is None or got[c] == pytest.approx(want[c], rel=1e-7, abs=1e-9)), (n, c)
            assert got.slippage_bps == pytest.approx(5.0 if got.consensus is None else got.consensus * 1e4)
