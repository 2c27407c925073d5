"""DuckDB SQL for the registered queries, written on its own from the definitions."""

from __future__ import annotations

WINDOW = "WINDOW s AS (PARTITION BY symbol ORDER BY ts)"

BARS = """
line AS (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS price, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
bars AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, arg_min(price, k) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume FROM line GROUP BY 1, 2),
brand AS (
  SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts, arg_min(price, k) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume FROM line JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bench AS (
  SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, arg_max(price, k) AS close FROM line GROUP BY 1)"""


def over(n: int, shift: int = 0) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


def roll(fn: str, x: str, n: int, shift: int = 0) -> str:
    return f"(CASE WHEN count({x}) {over(n, shift)} = {n} THEN {fn}({x}) {over(n, shift)} END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"


def change(x: str, n: int = 1) -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - CAST(1 AS DOUBLE))"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"CASE WHEN round({x}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({x}, {digits}) END AS {name}"


def d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def clip(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({d(low)}, least({d(high)}, {x})) END)"


DAY = "CAST(ts AS DATE) AS day"
OHLC = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))

Z = f"""
z1 AS (SELECT *, {roll('avg', 'close', 20)} AS zm, {roll('stddev_samp', 'close', 20)} AS zs FROM bars),
z AS (SELECT *, (close - zm) / nullif(zs, 0) AS z FROM z1)"""
MA = f"""
m1 AS (SELECT *, {roll('avg', 'close', 10)} - {roll('avg', 'close', 30)} AS diff FROM z),
m AS (SELECT *, {lag('diff')} AS before FROM m1)"""
COMPOSITE = f"""
c1 AS (SELECT *, {clip(f"{d(0.5)} * {clip('z', -3, 3)} / -3 + {d(0.5)} * coalesce(sign(diff), 0)", -1, 1)} AS composite FROM m),
c AS (SELECT *, CASE WHEN composite <= -0.5 THEN 'SELL' WHEN composite >= 0.5 THEN 'BUY' ELSE 'HOLD' END AS signal FROM c1)"""
STOCH = f"""
b1 AS (SELECT *, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM bars),
b2 AS (SELECT *, (close - (mid - 2 * sd)) / nullif(4 * sd, 0) AS pctb, 4 * sd / nullif(mid, 0) AS width, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM b1),
b3 AS (SELECT *, {roll('avg', 'k', 3)} AS dd, width > {roll('avg', 'width', 10, 1)} AS wide, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM b2),
b4 AS (SELECT *, coalesce(wide, false) AND n >= 5 AND sum(CASE WHEN pctb >= 0.85 THEN 1 ELSE 0 END) {over(5)} >= 3 AS up,
       coalesce(wide, false) AND n >= 5 AND sum(CASE WHEN pctb <= 0.15 THEN 1 ELSE 0 END) {over(5)} >= 3 AS down,
       {clip(f"({clip('2 * (0.5 - pctb)', -1.5, 1.5)} + {clip('(50 - k) / 50', -1.5, 1.5)}) / 2", -1, 1)} AS raw FROM b3),
b5 AS (SELECT *, CASE WHEN up AND raw < 0 THEN 0 ELSE raw END AS raw1 FROM b4),
sb AS (SELECT *, CASE WHEN down AND raw1 > 0 THEN CAST(0 AS DOUBLE) ELSE raw1 END AS score, CASE WHEN down THEN 'down' WHEN up THEN 'up' END AS walk_state,
       CASE WHEN pctb >= 0.9 AND k >= 80 AND k <= dd AND NOT up THEN 'SELL' WHEN pctb <= 0.1 AND k <= 20 AND k >= dd AND NOT down THEN 'BUY' ELSE 'HOLD' END AS signal FROM b5)"""
RSI = f"""
g1 AS (SELECT *, close - {lag('close')} AS dc, {lag('close')} AS pc FROM bars),
g2 AS (SELECT *, CASE WHEN dc IS NOT NULL THEN greatest(dc, 0) END AS up, CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0) END AS down,
       greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM g1),
g AS (SELECT *, 100 - 100 / (1 + {roll('avg', 'up', 14)} / nullif({roll('avg', 'down', 14)}, 0)) AS rsi, {roll('avg', 'tr', 14)} / nullif(close, 0) AS atr_ratio FROM g2)"""
WITH_BENCH = """
wb AS (SELECT b.*, last_value(x.close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY b.ts ROWS UNBOUNDED PRECEDING) AS bench FROM bars b LEFT JOIN bench x ON b.ts = x.ts)"""


def ewm(name: str, source: str, column: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM {source}),
{name} AS (
  SELECT symbol, rn, CAST({column} AS DOUBLE) AS y FROM {name}_n WHERE rn = 1
  UNION ALL SELECT n.symbol, n.rn, {d(a)} * n.{column} + {d(1 - a)} * e.y FROM {name} e JOIN {name}_n n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""


ORACLES = {
    "bars_daily": f"WITH {BARS} SELECT symbol, {DAY}, {OHLC} FROM bars",
    "bars_weekly_brand": f"WITH {BARS} SELECT symbol, {DAY}, {OHLC} FROM brand",
    "bars_daily_region": f"""
WITH line AS (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS price, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT r_name AS symbol, CAST(l_shipdate AS DATE) AS day, {', '.join(r(x, n) for x, n in (('arg_min(price, k)', 'open'), ('max(price)', 'high'), ('min(price)', 'low'), ('arg_max(price, k)', 'close'), ('sum(l_quantity)', 'volume')))}
FROM line JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "bars_weekly_segment": f"""
SELECT c_mktsegment AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS day, {', '.join(r(x, n) for x, n in (('arg_min(o_totalprice, o_orderkey)', 'open'), ('max(o_totalprice)', 'high'), ('min(o_totalprice)', 'low'), ('arg_max(o_totalprice, o_orderkey)', 'close'), ('CAST(count(*) AS DOUBLE)', 'volume')))}
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "bars_hourly_events": f"""
SELECT event_type AS symbol, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, {', '.join(r(x, n) for x, n in (('arg_min(value, row(ts, event_id))', 'open'), ('max(value)', 'high'), ('min(value)', 'low'), ('arg_max(value, row(ts, event_id))', 'close'), ('CAST(count(*) AS DOUBLE)', 'volume')))}
FROM events GROUP BY 1, 2""",
    "zscore_signal": f"WITH {BARS}, {Z} SELECT symbol, {DAY}, {r('z', 'z')}, CASE WHEN abs(z) <= 0.5 THEN 'EXIT' WHEN z >= 1.5 THEN 'SELL' WHEN z <= -1.5 THEN 'BUY' ELSE 'HOLD' END AS signal FROM z",
    "ma_crossover": f"WITH {BARS}, {Z}, {MA} SELECT symbol, {DAY}, {r('diff', 'diff')}, CASE WHEN before >= 0 AND diff < 0 THEN 'SELL' WHEN before <= 0 AND diff > 0 THEN 'BUY' ELSE 'HOLD' END AS signal FROM m",
    "composite_signal": f"WITH {BARS}, {Z}, {MA}, {COMPOSITE} SELECT symbol, {DAY}, {r('composite', 'composite')}, signal FROM c",
    "flagship_latest_signals": f"""WITH {BARS}, {Z}, {MA}, {COMPOSITE}, t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
SELECT symbol, {DAY}, {r('close', 'close')}, {r('z', 'z')}, {r('composite', 'composite')}, signal, row_number() OVER (ORDER BY composite DESC NULLS LAST, symbol) AS rank FROM t""",
    "bollinger_stoch_bandwalk": f"WITH {BARS}, {STOCH} SELECT symbol, {DAY}, {r('pctb', 'pctb')}, {r('k', 'k')}, {r('dd', 'd')}, {r('score', 'stochbb_score')}, walk_state, signal FROM sb",
    "rsi": f"WITH {BARS}, {RSI} SELECT symbol, {DAY}, {r('rsi', 'rsi')} FROM g",
    "atr": f"WITH {BARS}, {RSI} SELECT symbol, {DAY}, {r('tr', 'true_range')}, {r('atr_ratio', 'atr_ratio')} FROM g",
    "macd_ewm": f"""WITH RECURSIVE {BARS}, {ewm('f', 'bars', 'close', 12)}, {ewm('l', 'bars', 'close', 26)},
mm AS (SELECT n.symbol, n.ts, f.y - l.y AS macd FROM f_n n JOIN f ON f.symbol = n.symbol AND f.rn = n.rn JOIN l ON l.symbol = n.symbol AND l.rn = n.rn), {ewm('g', 'mm', 'macd', 9)}
SELECT n.symbol, CAST(n.ts AS DATE) AS day, {r('n.macd', 'macd')}, {r('g.y', 'macd_signal')} FROM g_n n JOIN g ON g.symbol = n.symbol AND g.rn = n.rn""",
    "rolling_beta": f"""WITH {BARS}, {WITH_BENCH}, x AS (SELECT *, {change('close')} AS ra, {change('bench')} AS rb FROM wb)
SELECT symbol, {DAY}, {', '.join(r(f"{change('close', n)} - {change('bench', n)}", f'rel_{n}') for n in (5, 20))},
{r(f"CASE WHEN count(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 END) {over(60)} = 60 THEN covar_samp(ra, rb) {over(60)} / nullif(var_samp(rb) {over(60)}, 0) END", 'beta')} FROM x""",
    "regime_gate": f"""WITH {BARS}, {Z}, {MA}, {COMPOSITE}, {WITH_BENCH},
x AS (SELECT c.*, wb.bench FROM c JOIN wb ON c.symbol = wb.symbol AND c.ts = wb.ts),
y AS (SELECT *, coalesce(bench > {roll('avg', 'bench', 200)}, false) AS ok FROM x),
w AS (SELECT *, CASE WHEN ok OR composite IS NULL THEN composite ELSE least(composite, 0) END AS gated FROM y)
SELECT symbol, {DAY}, ok AS regime_ok, {r('gated', 'composite')}, CASE WHEN gated <= -0.5 THEN 'SELL' WHEN gated >= 0.5 THEN 'BUY' ELSE 'HOLD' END AS signal FROM w""",
    "bad_ticks": f"WITH {BARS}, x AS (SELECT *, {change('close')} AS ret FROM bars) SELECT symbol, {DAY}, {r('close', 'close')}, {r('ret', 'ret')} FROM x WHERE abs(ret) > 0.35",
    "vol_regime": f"""WITH {BARS}, x AS (SELECT *, {change('close')} AS ret FROM bars),
y AS (SELECT symbol, ts, stddev_samp(ret) {over(20)} * sqrt({d(252)}) AS v FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
SELECT symbol, {r('v', 'annual_vol')}, CASE WHEN v > 0.4 THEN 'high' ELSE 'normal' END AS regime FROM y""",
    "pead_asof": f"""WITH q AS (SELECT c_mktsegment AS symbol, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS ts, avg(o_totalprice) AS actual FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT *, (actual - {lag('actual')}) / nullif(abs({lag('actual')}), 0) * 100 AS surprise FROM q),
b AS (SELECT c_mktsegment AS symbol, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
j AS (SELECT b.symbol, b.ts, date_diff('day', e.ts, b.ts) AS days, surprise FROM b ASOF LEFT JOIN (SELECT * FROM e WHERE surprise IS NOT NULL) e ON b.symbol = e.symbol AND b.ts >= e.ts)
SELECT symbol, {DAY}, {r(f"CASE WHEN days <= 60 THEN {clip('surprise / 20', -1, 1)} * (1 - days / {d(60)}) END", 'earnings_score')} FROM j""",
    "ml_features": f"""WITH {BARS}, {RSI}, {Z},
x AS (SELECT g.symbol, g.ts, g.open, g.high, g.low, g.close, g.volume, rsi, atr_ratio, z, {change('g.close').replace('symbol', 'g.symbol').replace('ORDER BY ts', 'ORDER BY g.ts')} AS ret_1 FROM g JOIN z ON g.symbol = z.symbol AND g.ts = z.ts),
y AS (SELECT *, {roll('avg', 'ret_1', 5)} AS m5, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM x)
SELECT symbol, {DAY}, {r('ret_1', 'ret_1')}, {', '.join(r(change('close', n), f'ret_{n}') for n in (3, 5, 10, 20))}, {', '.join(r(roll('stddev_samp', 'ret_1', n), f'vol_{n}') for n in (10, 20))},
{', '.join(r(f"close / nullif({roll('avg', 'close', n)}, 0) - 1", f'ma_ratio_{n}') for n in (10, 20, 50))}, {r('rsi', 'rsi')}, {r('atr_ratio', 'atr_ratio')},
{r('(close - (mid - 2 * sd)) / nullif(4 * sd, 0)', 'pctb')}, {r('100 * (close - lo) / nullif(hi - lo, 0)', 'k')}, {r('z', 'z')}, {r(f"volume / nullif({roll('avg', 'volume', 20)}, 0)", 'volume_ratio')},
{r(f"m5 - {lag('m5', 5)}", 'accel')} FROM y""",
}

# ---- strategies and backtests

LATCH = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def latch(enter: str, leave: str) -> str:
    return f"coalesce(last_value(CASE WHEN {enter} THEN 1 WHEN {leave} THEN 0 END IGNORE NULLS) {LATCH}, 0)"


POSITIONS = f"""{BARS}, {Z}, {MA}, {COMPOSITE}, {STOCH}, {RSI}, {ewm('f', 'bars', 'close', 12)}, {ewm('l', 'bars', 'close', 26)},
mm AS (SELECT n.symbol, n.ts, f.y - l.y AS macd FROM f_n n JOIN f ON f.symbol = n.symbol AND f.rn = n.rn JOIN l ON l.symbol = n.symbol AND l.rn = n.rn), {ewm('q', 'mm', 'macd', 9)},
wide AS (
  SELECT c.symbol, c.ts, c.close, c.signal AS csig, sb.signal AS ssig, sb.mid, sb.mid + 2 * sb.sd AS upper, g.rsi, qn.macd, q.y AS msig
  FROM c JOIN sb ON sb.symbol = c.symbol AND sb.ts = c.ts JOIN g ON g.symbol = c.symbol AND g.ts = c.ts JOIN q_n qn ON qn.symbol = c.symbol AND qn.ts = c.ts JOIN q ON q.symbol = qn.symbol AND q.rn = qn.rn),
marks AS (
  SELECT symbol, ts, close, 1 AS buy_hold, CASE WHEN {roll('avg', 'close', 10)} > {roll('avg', 'close', 30)} THEN 1 ELSE 0 END AS ma_crossover,
    {latch('rsi < 30', 'rsi > 55')} AS rsi_reversion, CASE WHEN macd > msig THEN 1 ELSE 0 END AS macd_trend, {latch('close > upper', 'close < mid')} AS bollinger_breakout,
    CASE WHEN {change('close', 20)} > 0 THEN 1 ELSE 0 END AS momentum_roc, {latch("ssig = 'BUY'", "ssig = 'SELL'")} AS stoch_bb, {latch("csig = 'BUY'", "csig IN ('SELL', 'EXIT')")} AS composite FROM wide),
pos AS (SELECT symbol, ts, close, strategy, CAST(position AS DOUBLE) AS position FROM (UNPIVOT marks ON buy_hold, ma_crossover, rsi_reversion, macd_trend, bollinger_breakout, momentum_roc, stoch_bb, composite INTO NAME strategy VALUE position))"""
PS = "PARTITION BY symbol, strategy ORDER BY ts"
RUN = f"""{POSITIONS},
r1 AS (SELECT *, row_number() OVER ({PS}) - 1 AS n, coalesce(close / nullif(lag(close) OVER ({PS}), 0) - 1, 0) AS ret, coalesce(lag(position) OVER ({PS}), 0) AS p1, coalesce(lag(position, 2) OVER ({PS}), 0) AS p2, lag(position) OVER ({PS}) AS prev FROM pos),
r2 AS (SELECT *, p1 * ret - (greatest(p1 - p2, 0) * {d(25)} / 10000 + greatest(p2 - p1, 0) * {d(35)} / 10000) AS net FROM r1),
run AS (SELECT *, CASE WHEN n = 0 THEN {d(100)} ELSE product(1 + net) OVER ({PS} ROWS UNBOUNDED PRECEDING) * 100 END AS equity FROM r2),
t1 AS (SELECT *, sum(CASE WHEN position > 0 AND (n = 1 OR prev = 0) THEN 1 ELSE 0 END) OVER ({PS} ROWS UNBOUNDED PRECEDING) AS trade FROM run WHERE n >= 1),
trades AS (SELECT symbol, strategy, min(ts) AS entry, max(ts) AS exit, (product(1 + net) - 1) * 100 AS ret, CASE WHEN min(position) = 0 THEN 'signal' ELSE 'open' END AS exit_reason
  FROM t1 WHERE position > 0 OR (prev > 0 AND n >= 2) GROUP BY symbol, strategy, trade)"""
METRICS = f"""{RUN},
e1 AS (SELECT *, equity / nullif(lag(equity) OVER ({PS}), 0) - 1 AS daily, equity / max(equity) OVER ({PS} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM run),
e2 AS (SELECT symbol, strategy, (arg_max(equity, ts) / arg_min(equity, ts) - 1) * 100 AS total, avg(daily) AS m, stddev_samp(daily) AS sd, min(dd) * 100 AS dd, avg(position) * 100 AS exposure FROM e1 GROUP BY 1, 2 HAVING count(daily) >= 2),
mo1 AS (SELECT symbol, strategy, date_trunc('month', ts) AS mon, product(1 + daily) - 1 AS ret FROM e1 WHERE daily IS NOT NULL GROUP BY 1, 2, 3),
mo AS (SELECT symbol, strategy, count(*) FILTER (ret > 1e-12) / CAST(date_diff('month', min(mon), max(mon)) + 1 AS DOUBLE) * 100 AS consistency FROM mo1 GROUP BY 1, 2),
tr AS (SELECT symbol, strategy, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS win, CASE WHEN sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END) > 0 THEN sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END)
  WHEN sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) > 0 THEN 3 ELSE 0 END AS pf FROM trades GROUP BY 1, 2),
met AS (SELECT e2.symbol, e2.strategy, total, CASE WHEN sd > 0 THEN m / sd * sqrt({d(252)}) END AS sharpe, dd, coalesce(tr.n, 0) AS n_trades, win, pf, consistency, exposure
  FROM e2 LEFT JOIN mo ON mo.symbol = e2.symbol AND mo.strategy = e2.strategy LEFT JOIN tr ON tr.symbol = e2.symbol AND tr.strategy = e2.strategy)"""


def unit(x: str, low: float, high: float, neutral: float = 0) -> str:
    return f"coalesce({clip(f'({x} - {d(low)}) / {d(high - low)}', 0, 1)}, {d(neutral)})"


PARTS = {
    "excess_return": (unit("total - bench", -20, 20), 25), "sharpe": (unit("sharpe", -1, 3, 0.25), 20), "win_rate": (unit("win", 20, 70), 15),
    "profit_factor": (unit("pf", 0, 3), 15), "max_drawdown": (f"1 - {unit('abs(dd)', 0, 50)}", 15), "consistency": (unit("consistency", 0, 100), 10),
}

BRANDS = BARS.replace("bars AS (", "day_bars AS (").replace("brand AS (", "bars AS (")
RUN_WEEKLY, METRICS = RUN.replace(BARS, BRANDS), METRICS.replace(BARS, BRANDS)

ORACLES |= {
    "strategy_positions": f"WITH RECURSIVE {POSITIONS} SELECT symbol, {DAY}, strategy, position FROM pos",
    "vector_backtest_equity": f"WITH RECURSIVE {RUN_WEEKLY} SELECT symbol, {DAY}, strategy, {r('net', 'net')}, {r('CASE WHEN equity > 0 THEN ln(equity / 100) END', 'log_equity')} FROM run",
    "vector_backtest_trades": f"WITH RECURSIVE {RUN_WEEKLY} SELECT symbol, strategy, CAST(entry AS DATE) AS entry, CAST(exit AS DATE) AS exit, {r('CASE WHEN 1 + ret / 100 > 0 THEN ln(1 + ret / 100) END', 'log_return')}, exit_reason FROM trades",
    "arena_metrics": f"WITH RECURSIVE {METRICS} SELECT symbol, strategy, {r('CASE WHEN 1 + total / 100 > 0 THEN ln(1 + total / 100) END', 'log_total_return')}, {r('sharpe', 'sharpe_ratio')}, {r('dd', 'max_drawdown_pct')}, n_trades, {r('win', 'win_rate_pct')}, {r('consistency', 'consistency_pct')}, {r('exposure', 'exposure_pct')} FROM met",
    "arena_points": f"""WITH RECURSIVE {METRICS}, w AS (SELECT met.*, b.total AS bench FROM met LEFT JOIN met b ON b.symbol = met.symbol AND b.strategy = 'buy_hold'),
p AS (SELECT *, {', '.join(f"round_even(({x}) * {d(n)}, 1) AS pts_{k}" for k, (x, n) in PARTS.items())} FROM w)
SELECT symbol, strategy, {', '.join(r(f'pts_{k}', f'pts_{k}', 1) for k in PARTS)}, {r(f"round_even(({' + '.join(f'pts_{k}' for k in PARTS)}) * CASE WHEN strategy = 'buy_hold' THEN 1 ELSE {d(0.3)} + {d(0.7)} * least(1, n_trades / {d(3)}) END, 1)", 'points', 1)} FROM p""",
    "league_points": f"""WITH RECURSIVE {METRICS}, p AS (SELECT symbol, strategy, CAST(row_number() OVER (PARTITION BY symbol ORDER BY round_even(total, 2) DESC, strategy) AS INTEGER) AS place FROM met)
SELECT symbol, strategy, place, CAST(coalesce([10, 8, 6, 5, 4, 3, 2, 1][place], 1) AS INTEGER) AS league_points FROM p""",
    "walk_forward_folds": f"""WITH {BARS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM bars),
b AS (SELECT *, least(i // nullif(c // 4, 0), 3) AS fold FROM a), e AS (SELECT *, CASE WHEN fold = 3 THEN c - 3 * (c // 4) ELSE c // 4 END AS len FROM b), f AS (SELECT *, CAST(floor(len * {d(0.7)}) AS BIGINT) AS cut FROM e)
SELECT symbol, CAST(fold AS INTEGER) AS fold, CASE WHEN i - fold * (c // 4) < cut THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day
FROM f WHERE cut > 30 AND len - cut > 10 GROUP BY 1, 2, 3""",
    "tick_and_lot": f"""WITH {BARS}, a AS (SELECT *, {lag('close')} AS pc FROM bars)
SELECT symbol, {DAY}, CASE WHEN close < 200 THEN 1 WHEN close < 500 THEN 2 WHEN close < 2000 THEN 5 WHEN close < 5000 THEN 10 ELSE 25 END AS tick,
CASE WHEN close < 200 THEN {d(0.25)} WHEN close < 5000 THEN {d(0.2)} ELSE {d(0.15)} END AS lower_limit,
coalesce(close / nullif(pc, 0) - 1 <= -(CASE WHEN pc < 200 THEN {d(0.25)} WHEN pc < 5000 THEN {d(0.2)} ELSE {d(0.15)} END) + {d('1e-9')} AND abs(close - low) <= {d('1e-8')} + {d('1e-5')} * abs(low), false) AS locked,
CAST(floor({d(100000)} / nullif(close, 0) / 100) * 100 AS BIGINT) AS lots FROM a""",
}

# ---- liquidity, simulation, statistics


def last(source: str, n: int = 20) -> str:
    return f"rec AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM {source} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {n})"


SPREADS = f"""{last('bars')},
s1 AS (SELECT *, {lag('high')} AS h1, {lag('low')} AS l1, {lag('close')} AS c1 FROM rec),
cs1 AS (SELECT *, pow(ln(high / low), 2) + pow(ln(h1 / l1), 2) AS beta, CASE WHEN h1 IS NOT NULL THEN pow(ln(greatest(high, h1) / least(low, l1)), 2) END AS gamma FROM s1),
cs2 AS (SELECT *, exp((sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt({d(2)})) - sqrt(gamma / (3 - 2 * sqrt({d(2)})))) AS ea FROM cs1),
cs AS (SELECT symbol, CASE WHEN count(*) >= 3 THEN avg(CASE WHEN ea IS NOT NULL THEN greatest(0, 2 * (ea - 1) / (1 + ea)) END) END AS corwin_schultz FROM cs2 GROUP BY 1),
ro1 AS (SELECT *, (close - c1) / nullif(c1, 0) AS ret FROM s1), ro2 AS (SELECT *, {lag('ret')} AS ret1 FROM ro1),
ro AS (SELECT symbol, CASE WHEN covar_samp(ret, ret1) < 0 THEN 2 * sqrt(-covar_samp(ret, ret1)) END AS roll FROM ro2 GROUP BY 1),
ed1 AS (SELECT symbol, ts, ln(open) AS o, ln(high) AS h, ln(low) AS l, ln(close) AS c FROM rec),
ed2 AS (SELECT *, {lag('h')} AS h1, {lag('l')} AS l1, {lag('c')} AS c1, (h + l) / 2 AS m FROM ed1),
ed3 AS (SELECT *, {lag('m')} AS m1, CASE WHEN h <> l OR l <> c1 THEN {d(1)} ELSE 0 END AS tau FROM ed2),
ed4 AS (SELECT *, m - o AS r1, o - m1 AS r2, m - c1 AS r3, c1 - m1 AS r4, o - c1 AS r5, tau * ((o <> h)::INT + (o <> l)::INT) AS po, tau * ((c1 <> h1)::INT + (c1 <> l1)::INT) AS pc FROM ed3 WHERE c1 IS NOT NULL),
ed5 AS (SELECT symbol, avg(r1) AS a1, avg(r3) AS a3, avg(r5) AS a5, avg(tau) AS pt, nullif(avg(po), 0) AS po, nullif(avg(pc), 0) AS pc, sum(tau) AS st FROM ed4 GROUP BY 1),
ed6 AS (SELECT e.symbol, st, -4 / x.po * (r1 - a1 / nullif(pt, 0) * tau) * r2 - 4 / x.pc * (r3 - a3 / nullif(pt, 0) * tau) * r4 AS x1, -4 / x.po * (r1 - a1 / nullif(pt, 0) * tau) * r5 - 4 / x.pc * (r5 - a5 / nullif(pt, 0) * tau) * r4 AS x2 FROM ed4 e JOIN ed5 x ON e.symbol = x.symbol),
ed7 AS (SELECT symbol, max(st) AS st, avg(x1) AS e1, avg(x2) AS e2, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM ed6 GROUP BY 1),
ed AS (SELECT symbol, CASE WHEN st >= 2 THEN sqrt(abs(CASE WHEN v1 + v2 > 0 THEN (v2 * e1 + v1 * e2) / (v1 + v2) ELSE (e1 + e2) / 2 END)) END AS edge FROM ed7),
fz AS (SELECT symbol, avg(CASE WHEN abs(high - low) <= {d('1e-8')} + {d('1e-5')} * abs(low) THEN {d(1)} ELSE 0 END) AS frozen FROM rec GROUP BY 1)"""
X = "2147483647"
NORMAL = f"""
SELECT *, ((x2 * x2 + 69621) % {X} + {d(0.5)}) / {d(X)} AS u, ((y2 * y2 + 48271) % {X} + {d(0.5)}) / {d(X)} AS v FROM (
SELECT *, (x1 * x1 + 16807 * i + 1) % {X} AS x2, (y1 * y1 + 40014 * i + 7) % {X} AS y2 FROM (
SELECT *, (48271 * i + 12345) % {X} AS x1, (69621 * i + 777) % {X} AS y1 FROM draws))"""


def simulated(days: int, sims: int) -> str:
    return f"""
lr AS (SELECT *, ln(close) - ln({lag('close')}) AS lr FROM brand),
st AS (SELECT symbol, arg_max(close, ts) AS s0, avg(lr) AS mu, stddev_samp(lr) AS sigma, row_number() OVER (ORDER BY symbol) - 1 AS k FROM lr GROUP BY symbol),
draws AS (SELECT symbol, s0, mu, sigma, sim, day, (k * {sims} + sim) * {days} + day AS i FROM st, range({sims}) a(sim), range(1, {days + 1}) b(day)),
z0 AS ({NORMAL}),
paths AS (SELECT symbol, sim, day, s0, s0 * exp(sum(mu - {d(0.5)} * sigma * sigma + sigma * sqrt(-2 * ln(u)) * cos(2 * pi() * v)) OVER (PARTITION BY symbol, sim ORDER BY day ROWS UNBOUNDED PRECEDING)) AS price FROM z0),
fin AS (SELECT *, price / s0 - 1 AS ret FROM paths WHERE day = {days})"""


PATHS, SCAN_PATHS = simulated(30, 2000), simulated(15, 1000)


def phi(x: str) -> str:
    t = f"(1 / (1 + {d(0.2316419)} * abs({x})))"
    poly = d(0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = f"(({poly} + {d(c)}) * {t})"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} WHEN {x} < 0 THEN {tail} END)"


RETS = f"rets AS (SELECT symbol, ts, ret FROM (SELECT *, {change('close')} AS ret FROM {{}}) WHERE ret IS NOT NULL), pr AS (SELECT x.symbol AS a, y.symbol AS b, x.ts, x.ret AS ra, y.ret AS rb FROM rets x JOIN rets y ON x.ts = y.ts AND x.symbol < y.symbol)"

ORACLES |= {
    "liquidity_stats": f"""WITH {BARS}, {last('bars')} SELECT symbol, {r('avg(close * volume)', 'avg_turnover', 4)}, {r('quantile_cont(close * volume, 0.5)', 'median_turnover', 4)}, {r('avg(volume)', 'avg_volume', 4)}, {r('arg_max(volume, ts)', 'latest_volume', 4)},
{r('CASE WHEN avg(volume) > 0 THEN arg_max(volume, ts) / avg(volume) END', 'volume_vs_avg_ratio', 4)} FROM rec GROUP BY symbol""",
    "spread_estimates": f"""WITH {BARS}, {SPREADS} SELECT fz.symbol, {r('frozen', 'frozen_days_ratio')}, {r('edge', 'edge')}, {r('corwin_schultz', 'corwin_schultz')}, {r('roll', 'roll')},
{r('list_median([x FOR x IN [edge, corwin_schultz, roll] IF x IS NOT NULL])', 'consensus')} FROM fz LEFT JOIN ed ON ed.symbol = fz.symbol LEFT JOIN cs ON cs.symbol = fz.symbol LEFT JOIN ro ON ro.symbol = fz.symbol""",
    "liquidity_tier": f"""WITH {BARS}, {last('brand')}, a AS (SELECT symbol, avg(close * volume) AS t, avg(CASE WHEN abs(high - low) <= {d('1e-8')} + {d('1e-5')} * abs(low) THEN {d(1)} ELSE 0 END) AS f FROM rec GROUP BY 1)
SELECT symbol, {r('t', 'avg_turnover', 4)}, {r('f', 'frozen_days_ratio', 4)}, CASE WHEN t < 250000 OR f >= 0.3 THEN 'hard_illiquid' WHEN t < 1000000 THEN 'thin' ELSE 'liquid' END AS tier FROM a""",
    "accumulation": f"""WITH {BARS}, a1 AS (SELECT *, coalesce(close - {lag('close')}, 0) AS dc FROM brand), a2 AS (SELECT *, sign(dc) * volume AS step, 4 * {roll('stddev_samp', 'close', 20)} / nullif({roll('avg', 'close', 20)}, 0) AS width FROM a1),
a3 AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv, {roll('avg', 'volume', 20)} AS vma, avg(volume) {over(3)} AS v3 FROM a2), {last('a3', 60)},
g1 AS (SELECT symbol, arg_max(v3, ts) AS v3, arg_max(vma, ts) AS vma, arg_max(close, ts) AS c, arg_min(close, ts) FILTER (rn <= 15) AS c0, regr_slope(obv, -rn) FILTER (rn <= 15) AS slope, stddev_samp(step) FILTER (rn <= 19) AS sd,
  arg_max(width, ts) AS w, count(width) AS nw, list(width) FILTER (width IS NOT NULL) AS ws, coalesce(sum(volume) FILTER (rn <= 20 AND dc > 0), 0) AS up, coalesce(sum(volume) FILTER (rn <= 20 AND dc < 0), 0) AS down FROM rec GROUP BY 1),
g2 AS (SELECT symbol, round_even({clip('(coalesce(v3 / nullif(vma, 0), 1) - 1) / 2', 0, 1)}, 3) AS rvol,
  round_even({clip(f"(CASE WHEN coalesce(c / nullif(c0, 0) - 1, 0) < 0.05 THEN coalesce(slope / nullif(sd, 0), 0) ELSE coalesce(slope / nullif(sd, 0), 0) * {d(0.3)} END) / 3", 0, 1)}, 3) AS obv,
  round_even(CASE WHEN nw >= 60 THEN {clip('1 - len(list_filter(ws, lambda x: x < w)) / CAST(nw AS DOUBLE)', 0, 1)} ELSE 0 END, 3) AS sq,
  round_even({clip('(coalesce(up / nullif(down, 0), CASE WHEN up > 0 THEN 2 ELSE 1 END) - 1) / 2', 0, 1)}, 3) AS ud FROM g1)
SELECT symbol, {r('rvol', 'rvol')}, {r('obv', 'obv_divergence')}, {r('sq', 'squeeze')}, {r('ud', 'up_down_volume')}, {r('(rvol + obv + sq + ud) / 4', 'accumulation_score')}, (rvol + obv + sq + ud) / 4 > 0.65 AS flag FROM g2""",
    "gbm_paths_summary": f"""WITH {BARS}, {PATHS}, q AS (SELECT symbol, any_value(s0) AS s0, avg(price) AS m, quantile_cont(price, 0.5) AS md, quantile_cont(price, 0.025) AS lo, quantile_cont(price, 0.975) AS hi, avg(CASE WHEN price > s0 THEN {d(1)} ELSE 0 END) AS pp, -quantile_cont(ret, 0.05) AS var FROM fin GROUP BY 1),
t AS (SELECT fin.symbol, -avg(ret) AS es FROM fin JOIN q ON q.symbol = fin.symbol WHERE ret <= -var GROUP BY 1)
SELECT q.symbol, {r('s0', 's0')}, {r('m', 'mean_final')}, {r('md', 'median_final')}, {r('lo', 'p_lower')}, {r('hi', 'p_upper')}, {r('pp', 'prob_profit')}, {r('var', 'var')}, {r('coalesce(es, var)', 'es')} FROM q LEFT JOIN t ON t.symbol = q.symbol""",
    "fan_bands": f"WITH {BARS}, {PATHS} SELECT symbol, CAST(day AS INTEGER) AS day, {', '.join(r(f'quantile_cont(price, {p / 100})', f'p{p}') for p in (5, 25, 50, 75, 95))} FROM paths GROUP BY 1, 2",
    "closed_form_prob_up": f"""WITH {BARS}, a AS (SELECT *, ln(close) - ln({lag('close')}) AS lr FROM bars), b AS (SELECT *, {roll('avg', 'lr', 90, 1)} AS mu, {roll('stddev_samp', 'lr', 90, 1)} AS sd FROM a),
x AS (SELECT *, (mu - sd * sd / 2) * 15 / nullif(sd * sqrt({d(15)}), 0) AS q FROM b) SELECT symbol, {DAY}, {r(phi('q'), 'prob_up')} FROM x""",
    "signal_ic": f"""WITH {BARS}, {Z}, {MA}, {COMPOSITE}, f AS ({' UNION ALL '.join(f"SELECT symbol, {h} AS horizon, composite AS s, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS fwd FROM c" for h in (1, 3, 5, 10))}),
g0 AS (SELECT * FROM f WHERE s IS NOT NULL AND fwd IS NOT NULL),
h AS (SELECT symbol, horizon, rank() OVER (PARTITION BY symbol, horizon ORDER BY s) + (count(*) OVER (PARTITION BY symbol, horizon, s) - 1) / {d(2)} AS a, rank() OVER (PARTITION BY symbol, horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, horizon, fwd) - 1) / {d(2)} AS b FROM g0),
k AS (SELECT symbol, horizon, corr(a, b) AS ic, count(*) AS n FROM h GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT symbol, horizon, {r('ic', 'ic')}, n, {r('ic * sqrt(nullif((n - 2) / nullif(1 - ic * ic, 0), 0))', 't')} FROM k""",
    "pair_corr_cov": f"WITH {BARS}, {RETS.format('brand')} SELECT a, b, {r('corr(ra, rb)', 'corr')}, {r('covar_samp(ra, rb)', 'cov')}, count(*) AS n FROM pr GROUP BY 1, 2",
    "rolling_corr": f"WITH {BARS}, {RETS.format('bars')} SELECT a, b, {DAY}, {r('CASE WHEN count(*) OVER w = 60 THEN corr(ra, rb) OVER w END', 'corr')} FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "monthly_pivot": f"""WITH {BARS}, mc AS (SELECT symbol, date_trunc('month', ts) AS ts, arg_max(close, bars.ts) AS close FROM bars GROUP BY symbol, date_trunc('month', bars.ts)), {RETS.format('mc')}
SELECT symbol, CAST(year(ts) AS INTEGER) AS year, {', '.join(r(f'max(ret) FILTER (month(ts) = {m})', f'm{m:02d}') for m in range(1, 13))} FROM rets GROUP BY 1, 2""",
}

# ---- screener, logs, events


def bands(x: str, steps: list[tuple[float, float]], rest: float, op: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(f'WHEN {x} {op} {edge} THEN {d(score)}' for edge, score in steps)} ELSE {d(rest)} END"


FUND = f"""
fu0 AS (SELECT p_brand AS symbol, avg(p_size) AS pe, avg(l_tax) * 50 AS pbv, avg(l_discount) * 4 AS roe, nullif(count(*) % 50, 0) AS der, avg(l_discount) * 2 AS pm, avg(l_tax) - {d(0.03)} AS rg, sum(l_quantity) AS cap
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
fu1 AS (SELECT * REPLACE (CASE WHEN row_number() OVER (ORDER BY symbol) % 5 <> 0 THEN pe END AS pe, CASE WHEN der > 10 THEN der / {d(100)} ELSE der END AS der) FROM fu0),
fu AS (SELECT symbol, cap, list_avg([x FOR x IN [{bands('nullif(greatest(pe, 0), 0)', [(15, 1), (25, 0.6), (40, 0.3)], 0.1, '<')}, {bands('nullif(greatest(pbv, 0), 0)', [(1, 1), (3, 0.6)], 0.3, '<')},
  {bands('roe', [(0.2, 1), (0.1, 0.6), (0, 0.3)], 0, '>')}, {bands('der', [(0.5, 1), (1, 0.6), (2, 0.3)], 0.1, '<')}, {bands('pm', [(0.15, 1), (0.05, 0.6), (0, 0.3)], 0, '>')}, {bands('rg', [(0.15, 1), (0.05, 0.6), (0, 0.4)], 0.1, '>')}] IF x IS NOT NULL]) AS score FROM fu1)"""
SCAN = f"""{BRANDS}, {Z}, {MA}, {COMPOSITE}, {SCAN_PATHS.replace('FROM brand', 'FROM bars')}, {FUND},
pp AS (SELECT symbol, avg(CASE WHEN price > s0 THEN {d(1)} ELSE 0 END) AS pp FROM fin GROUP BY 1),
pos AS (SELECT symbol, ts, close, 'composite' AS strategy, CAST({latch("signal = 'BUY'", "signal = 'SELL'")} AS DOUBLE) AS position FROM c),
{RUN[RUN.index('r1 AS'):]},
tw AS (SELECT symbol, count(*) AS n, avg(CASE WHEN ret > 0 THEN {d(1)} ELSE 0 END) * 100 AS win FROM trades GROUP BY 1), {last('bars')},
ti AS (SELECT symbol, CASE WHEN avg(close * volume) < 250000 OR avg(CASE WHEN abs(high - low) <= {d('1e-8')} + {d('1e-5')} * abs(low) THEN {d(1)} ELSE 0 END) >= 0.3 THEN 'hard_illiquid' WHEN avg(close * volume) < 1000000 THEN 'thin' ELSE 'liquid' END AS tier, arg_max(volume, ts) / avg(volume) AS vr FROM rec GROUP BY 1),
scan AS (SELECT c.symbol, c.z, c.composite, pp.pp, coalesce(tw.n, 0) AS n, tw.win, ti.tier, ti.vr, fu.score AS fs, coalesce((composite + 1) / 2, 0.5) AS v1, coalesce(pp.pp, 0.5) AS v2, CASE WHEN tw.n >= 3 THEN tw.win / 100 ELSE 0.5 END AS v3, coalesce(fu.score, 0.5) AS v4
  FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) c LEFT JOIN pp USING (symbol) LEFT JOIN tw USING (symbol) LEFT JOIN ti USING (symbol) LEFT JOIN fu USING (symbol)),
ov AS (SELECT *, (v1 * {d(0.34)} + v2 * {d(0.33)} + v3 * {d(0.33)} + v4 * {d(0.2)}) / {d(1.2)} AS overall, greatest(v1, v2, v3, v4) - least(v1, v2, v3, v4) AS spread FROM scan)"""
EVENT_BARS = ", ".join(r(x, n) for x, n in (("arg_min(value, row(ts, event_id))", "open"), ("max(value)", "high"), ("min(value)", "low"), ("arg_max(value, row(ts, event_id))", "close"), ("CAST(count(*) AS DOUBLE)", "volume")))

ORACLES |= {
    "fundamental_score": f"WITH {FUND} SELECT symbol, {r('score', 'fundamental_score')}, CASE WHEN cap * 1000 >= 1e12 THEN printf('%.2fT', cap * 1000 / 1e12::DOUBLE) WHEN cap * 1000 >= 1e9 THEN printf('%.2fB', cap * 1000 / 1e9::DOUBLE) WHEN cap * 1000 >= 1e6 THEN printf('%.2fM', cap * 1000 / 1e6::DOUBLE) ELSE printf('%.0f', cap * 1000) END AS market_cap_text FROM fu",
    "gainers_topk": f"""WITH {BARS}, a AS (SELECT *, {lag('close')} AS pc, {change('close')} * 100 AS pct FROM brand), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
SELECT symbol, {r('close', 'last')}, {r('pc', 'prev_close')}, {r('pct', 'pct_change')}, {r('volume', 'volume')} FROM b WHERE pct IS NOT NULL AND close >= 1 ORDER BY pct DESC, symbol LIMIT 10""",
    "verdict_scan": f"""WITH {SCAN} SELECT symbol, {r('composite', 'composite')}, {r('pp', 'prob_profit')}, n AS n_trades, {r('win', 'win_rate_pct')}, tier, {r('fs', 'fundamental_score')}, {r('overall', 'overall')}, {r('spread', 'component_spread')},
CASE WHEN overall >= 0.55 THEN CASE WHEN coalesce(z >= 1.5, false) OR tier = 'hard_illiquid' THEN 'HOLD (' || concat_ws(' + ', CASE WHEN z >= 1.5 THEN 'Z-Guard' END, CASE WHEN tier = 'hard_illiquid' THEN 'Liquidity-Guard' END) || ')' ELSE 'BUY' END WHEN overall <= 0.45 THEN 'SELL' ELSE 'HOLD' END AS verdict FROM ov""",
    "scalp_swing": f"WITH {SCAN} SELECT symbol, {r(f"(coalesce((composite + 1) / 2, 0.5) + coalesce(CASE WHEN vr > 3 THEN 1 ELSE vr / 3 END, 0.5) + coalesce({clip('(-z / 3 + 1) / 2', 0, 1)}, 0.5)) / 3", 'scalp')}, {r('CASE WHEN fs IS NOT NULL THEN (v3 + v2 + fs) / 3 ELSE (v3 + v2) / 2 END', 'swing')} FROM ov",
    "position_sizing": f"""WITH {BARS}, {Z}, {MA}, {COMPOSITE}, a AS (SELECT *, {change('close')} AS ret FROM c), b AS (SELECT *, {roll('stddev_samp', 'ret', 20)} * sqrt({d(252)}) AS vol FROM a)
SELECT symbol, {DAY}, {r(clip(f"{d(0.1)} * coalesce({d(0.25)} + {d(1.25)} * {clip('(abs(composite) - 0.5) / 0.5', 0, 1)}, 1) * ({d(0.25)} + {d(0.75)} * {d(0.6)}) * CASE WHEN vol > {d('1e-6')} THEN {clip(f'{d(0.2)} / vol', 0.25, 2)} ELSE 1 END", 0.01, 1), 'size')} FROM b""",
    "news_sentiment": f"WITH a AS (SELECT d.lang AS symbol, d.doc_id, avg(CAST(quality - toxic AS DOUBLE)) AS s FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality - toxic IS NOT NULL GROUP BY 1, 2) SELECT symbol, {r('avg(s)', 'sentiment')}, count(*) AS n_articles FROM a GROUP BY 1",
    "universe_set_ops": """WITH s AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_size <= 5), c AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_retailprice < 950)
SELECT upper(trim(b)) || '.JK' AS symbol, part FROM (SELECT b, 'both' AS part FROM s WHERE b IN (FROM c) UNION ALL SELECT b, 'small' FROM s WHERE b NOT IN (FROM c) UNION ALL SELECT b, 'cheap' FROM c WHERE b NOT IN (FROM s))""",
    "log_append_dedupe": f"WITH {BARS}, {Z}, {MA}, {COMPOSITE} SELECT symbol, {DAY}, CASE WHEN ts < TIMESTAMP '1998-01-01' THEN 1 ELSE 2 END AS run, signal AS verdict, {r('close', 'close_at_signal')} FROM c",
    "log_backfill": f"WITH {BARS} SELECT symbol, {DAY}, {r('(lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1) * 100', 'fwd_return_pct')} FROM bars",
    "weekly_league": f"""WITH RECURSIVE {RUN}, wk AS (SELECT symbol, strategy, date_trunc('week', ts) AS week, arg_max(equity, ts) AS eq FROM run GROUP BY 1, 2, date_trunc('week', run.ts)),
wr AS (SELECT *, round(eq / nullif(lag(eq) OVER (PARTITION BY symbol, strategy ORDER BY week), 0) - 1, 9) AS ret FROM wk),
wp AS (SELECT *, row_number() OVER (PARTITION BY symbol, week ORDER BY ret DESC, strategy) AS place FROM wr WHERE ret IS NOT NULL)
SELECT symbol, strategy, CAST(sum(coalesce([10, 8, 6, 5, 4, 3, 2, 1][place], 1)) AS BIGINT) AS league_points, count(*) AS weeks FROM wp GROUP BY 1, 2""",
    "event_tumbling_bars": f"SELECT event_type AS symbol, CAST(epoch(time_bucket(INTERVAL 15 MINUTES, ts)) AS BIGINT) AS start, {EVENT_BARS} FROM events GROUP BY 1, 2",
    "event_sessions": f"""WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTES)) AS BIGINT) AS end, count(*) AS n, {r('sum(value)', 'total', 4)} FROM b GROUP BY user_id, s""",
    "event_props": f"SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, {r('sum(value)', 'total', 4)} FROM events GROUP BY 1, 2",
    "event_backtest_base": f"""WITH {BARS}, {Z}, {MA}, {COMPOSITE},
a AS (SELECT *, lead(open) OVER (PARTITION BY symbol ORDER BY ts) AS fill, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS next_ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, last_value(ts) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS end_ts,
  last_value(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS end_close FROM c),
s AS (SELECT *, {latch("signal = 'BUY'", "signal IN ('SELL', 'EXIT')")} AS held FROM a WHERE fill IS NOT NULL),
t AS (SELECT *, lag(held, 1, 0) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM s),
e AS (SELECT * FROM t WHERE held <> was), x AS (SELECT *, lead(fill) OVER (PARTITION BY symbol ORDER BY ts) AS out, lead(next_ts) OVER (PARTITION BY symbol ORDER BY ts) AS out_ts FROM e)
SELECT symbol, CAST(next_ts AS DATE) AS entry, CAST(coalesce(out_ts, end_ts) AS DATE) AS exit, {r('fill', 'entry_price')}, {r('coalesce(out, end_close)', 'exit_price')}, {r('(coalesce(out, end_close) / fill - 1) * 100', 'return_pct')}, CASE WHEN out IS NULL THEN 'end_of_data' ELSE 'signal' END AS exit_reason FROM x WHERE held = 1""",
}
for name, tail in {
    "robustness": f"SELECT symbol, count(*) AS n, {r('greatest(max(return_pct), 0) / nullif(sum(return_pct) FILTER (return_pct > 0), 0)', 'largest_share')}, coalesce(greatest(max(return_pct), 0) / nullif(sum(return_pct) FILTER (return_pct > 0), 0) > 0.5 AND count(*) >= 2, false) AS concentrated FROM tt GROUP BY 1",
    "iqr_outliers": f"SELECT tt.symbol, entry, {r('return_pct', 'return_pct')} FROM tt JOIN (SELECT symbol, quantile_cont(return_pct, 0.25) AS q1, quantile_cont(return_pct, 0.75) AS q3 FROM tt GROUP BY 1 HAVING count(*) >= 4) q ON q.symbol = tt.symbol WHERE return_pct < q1 - 1.5 * (q3 - q1) OR return_pct > q3 + 1.5 * (q3 - q1)",
}.items():
    base = ORACLES["event_backtest_base"]
    cut = base.rindex("SELECT symbol, CAST(next_ts")
    ORACLES[name] = f"{base[:cut].rstrip()}, tt AS (SELECT symbol, CAST(next_ts AS DATE) AS entry, (coalesce(out, end_close) / fill - 1) * 100 AS return_pct FROM x WHERE held = 1) {tail}"

# ---- evaluation

base = ORACLES["event_backtest_base"]
TRADES = f"""{base[: base.rindex("SELECT symbol, CAST(next_ts")].rstrip()}, tr AS (
  SELECT symbol, next_ts AS entry, coalesce(out_ts, end_ts) AS exit, fill AS entry_price, coalesce(out, end_close) AS exit_price, (coalesce(out, end_close) / fill - 1) * 100 AS return_pct, CASE WHEN out IS NULL THEN 'end_of_data' ELSE 'signal' END AS exit_reason FROM x WHERE held = 1)"""
MACD = f"""{ewm('f', 'bars', 'close', 12)}, {ewm('l', 'bars', 'close', 26)},
mm AS (SELECT n.symbol, n.ts, n.close, f.y - l.y AS macd FROM f_n n JOIN f ON f.symbol = n.symbol AND f.rn = n.rn JOIN l ON l.symbol = n.symbol AND l.rn = n.rn), {ewm('g', 'mm', 'macd', 9)}"""


def drawn(i: str) -> str:
    q1 = f"((48271 * (({i}) % {X}) + 12345) % {X})"
    q2 = f"(({q1} * {q1} + 16807 * (({i}) % {X}) + 1) % {X})"
    return f"(({q2} * {q2} + 69621) % {X})"


def blocks(source: str, samples: int, block: int, boosted: str = "") -> str:
    """boosted: a table of symbols that get 5,000 resamples."""
    ns = f"CASE WHEN symbol IN (SELECT symbol FROM {boosted}) THEN 5000 ELSE {samples} END" if boosted else str(samples)
    return f"""sz AS (SELECT symbol, n, {ns} AS ns, CASE WHEN n > {block} THEN {block} ELSE 1 END AS len, CASE WHEN n > {block} THEN (n + {block} - 1) // {block} ELSE n END AS runs FROM (SELECT symbol, count(*) AS n FROM {source} GROUP BY 1)),
d0 AS (SELECT *, unnest(range(runs)) AS j FROM (SELECT *, unnest(range(ns)) AS sample FROM sz)), d1 AS (SELECT *, {drawn('sample * runs + j')} % (n - len + 1) AS start FROM d0),
d2 AS (SELECT *, unnest(range(len)) AS step FROM d1), d3 AS (SELECT symbol, n, sample, start + step AS i FROM d2 WHERE j * len + step < n)"""


def bootstrap(block: int) -> str:
    return f"""{TRADES}, nt AS (SELECT symbol, return_pct / 100 AS r, row_number() OVER (PARTITION BY symbol ORDER BY exit, entry) - 1 AS i FROM tr),
qs AS (SELECT symbol, quantile_cont(return_pct, 0.25) AS q1, quantile_cont(return_pct, 0.75) AS q3 FROM tr GROUP BY 1 HAVING count(*) >= 4),
wi AS (SELECT DISTINCT tr.symbol FROM tr JOIN qs ON qs.symbol = tr.symbol WHERE return_pct < q1 - 1.5 * (q3 - q1) OR return_pct > q3 + 1.5 * (q3 - q1)),
{blocks('nt', 1000, block, 'wi')},
sm AS (SELECT d3.symbol, d3.sample, any_value(n) AS n, avg(CASE WHEN r > 0 THEN {d(1)} ELSE 0 END) * 100 AS win, sum(ln(1 + r)) AS log_growth FROM d3 JOIN nt ON nt.symbol = d3.symbol AND nt.i = d3.i GROUP BY 1, 2)
SELECT symbol, any_value(n) AS n_trades, count(*) AS n_resamples, {', '.join(r(f'quantile_cont({c}, {p / 100})', f'{c}_p{p}') for c in ('win', 'log_growth') for p in (5, 25, 50, 75, 95))}, {r('avg(win)', 'win_mean')}, {r('avg(log_growth)', 'log_growth_mean')} FROM sm GROUP BY 1"""


FOLDS = f"""fo0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM {{}}),
fo AS (SELECT *, CAST((i - 100) // 60 AS INTEGER) AS fold, 100 + ((i - 100) // 60) * 60 AS n_train FROM fo0 WHERE i >= 100 AND 100 + ((i - 100) // 60) * 60 + 60 <= c)"""
OUTCOMES = f"""oa AS (SELECT *, ln(close) - ln({lag('close')}) AS lr, lead(close, 15) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM c),
ob AS (SELECT *, {roll('avg', 'lr', 90, 1)} AS mu, {roll('stddev_samp', 'lr', 90, 1)} AS sd FROM oa), oc AS (SELECT *, (mu - sd * sd / 2) * 15 / nullif(sd * sqrt({d(15)}), 0) AS q FROM ob),
oo AS (SELECT *, {phi('q')} AS p, CASE WHEN later > close THEN {d(1)} WHEN later IS NOT NULL THEN {d(0)} END AS target FROM oc)"""
OUT = f"{BARS}, {Z}, {MA}, {COMPOSITE}, {OUTCOMES}, ok AS (SELECT * FROM oo WHERE p IS NOT NULL AND target IS NOT NULL)"


def held(window: int) -> str:
    return f"""h{window}a AS (SELECT *, {roll('avg', 'close', 10)} - {roll('avg', 'close', 30)} AS df, (close - {roll('avg', 'close', window)}) / nullif({roll('stddev_samp', 'close', window)}, 0) AS zz FROM bars),
h{window}b AS (SELECT *, {clip(f"{d(0.5)} * {clip('zz', -3, 3)} / -3 + {d(0.5)} * coalesce(sign(df), 0)", -1, 1)} AS sc FROM h{window}a)"""


RUNS = RUN[RUN.index("r1 AS") : RUN.index("t1 AS")].rstrip().rstrip(",")

ORACLES |= {
    "ml_features_full": f"""WITH RECURSIVE {BARS}, {MACD}, {WITH_BENCH}, x AS (SELECT *, {change('close')} AS ra, {change('bench')} AS rb FROM wb),
y AS (SELECT symbol, ts, {', '.join(f"{change('close', n)} - {change('bench', n)} AS rel_{n}" for n in (5, 20))},
CASE WHEN count(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 END) {over(60)} = 60 THEN covar_samp(ra, rb) {over(60)} / nullif(var_samp(rb) {over(60)}, 0) END AS beta FROM x)
SELECT y.symbol, CAST(y.ts AS DATE) AS day, {r('(n.macd - g.y) / nullif(n.close, 0)', 'macd_hist_pct')}, {r('rel_5', 'rel_5')}, {r('rel_20', 'rel_20')}, {r('beta', 'beta')} FROM y JOIN g_n n ON n.symbol = y.symbol AND n.ts = y.ts JOIN g ON g.symbol = n.symbol AND g.rn = n.rn""",
    "extended_metrics": f"""WITH {BARS}, {WITH_BENCH}, a AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS d, bench / nullif({lag('bench')}, 0) - 1 AS b, close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM wb),
g AS (SELECT symbol, count(d) AS n, avg(d) AS m, stddev_samp(d) FILTER (d < 0) AS down, min(dd) AS dd, pow(arg_max(close, ts) / arg_min(close, ts), {d(252)} / count(*)) - 1 AS cagr, count(*) FILTER (d IS NOT NULL AND b IS NOT NULL) AS k,
  covar_samp(d, b) AS cv, var_samp(b) FILTER (d IS NOT NULL) AS vr, avg(d) FILTER (b IS NOT NULL) AS md, avg(b) FILTER (d IS NOT NULL) AS mb, corr(d, b) AS co FROM a GROUP BY 1)
SELECT symbol, {r(f'CASE WHEN down > 0 THEN m / down * sqrt({d(252)}) END', 'sortino')}, {r('CASE WHEN dd < 0 THEN cagr / abs(dd) END', 'calmar')}, {r('CASE WHEN k > 20 AND vr > 0 THEN cv / vr END', 'beta')},
{r('CASE WHEN k > 20 AND vr > 0 THEN (md - cv / vr * mb) * 252 * 100 END', 'alpha_annual_pct')}, {r('CASE WHEN k > 20 AND vr > 0 THEN co END', 'benchmark_corr')} FROM g WHERE n >= 5""",
    "trade_bootstrap": bootstrap(1),
    "trade_block_bootstrap": bootstrap(5),
    "walk_forward_expanding": f"WITH {BARS}, {FOLDS.format('bars')} SELECT symbol, fold, n_train, count(*) AS n_test, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM fo GROUP BY 1, 2, 3",
    "fold_evaluation": f"""WITH {BARS}, {Z}, {MA}, {COMPOSITE}, hd AS (SELECT symbol, ts, close, CAST({latch("signal = 'BUY'", "signal = 'SELL'")} AS DOUBLE) AS position FROM c), {FOLDS.format('hd')},
pos AS (SELECT symbol, ts, close, CAST(fold AS VARCHAR) AS strategy, position FROM fo), {RUNS},
e AS (SELECT *, equity / nullif(lag(equity) OVER ({PS}), 0) - 1 AS daily FROM run)
SELECT symbol, CAST(strategy AS INTEGER) AS fold, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, {r('(arg_max(equity, ts) / arg_min(equity, ts) - 1) * 100', 'return_pct')}, {r('avg(position)', 'exposure')},
{r(f'CASE WHEN stddev_samp(daily) > 0 THEN avg(daily) / stddev_samp(daily) * sqrt({d(252)}) END', 'sharpe')} FROM e GROUP BY symbol, strategy""",
    "reliability_bins": f"""WITH {OUT}, eg AS (SELECT symbol, list_sort(list_distinct(quantile_cont(p, [{', '.join(str(i / 10) for i in range(11))}]))) AS qs FROM ok GROUP BY 1),
bn AS (SELECT ok.symbol, p, target, CASE WHEN len(qs) < 3 THEN 0 ELSE len(list_filter(qs[2:-2], lambda e: e < p)) END AS bin FROM ok JOIN eg ON eg.symbol = ok.symbol)
SELECT symbol, CAST(bin AS INTEGER) AS bin, {r('avg(p)', 'mean_predicted')}, {r('avg(target)', 'mean_actual')}, count(*) AS n FROM bn GROUP BY 1, 2""",
    "brier_skill": f"""WITH {OUT}, g AS (SELECT symbol, avg((p - target) * (p - target)) AS brier, avg(target) * (1 - avg(target)) AS base, count(*) AS n FROM ok GROUP BY 1), s AS (SELECT *, CASE WHEN base > 1e-9 THEN 1 - brier / base ELSE {d(0)} END AS skill FROM g)
SELECT symbol, {r('brier', 'brier')}, n, {r('base', 'brier_baseline')}, {r('skill', 'skill')}, {r('greatest(0, least(1, skill))', 'confidence')}, {r(f'{d(0.3)} * greatest(0, least(1, skill))', 'weight')} FROM s""",
    "meta_features": f"""{TRADES}, {OUTCOMES}, cl AS (SELECT symbol, exit, count(*) AS closed, count(*) FILTER (return_pct > 0) AS won FROM tr GROUP BY 1, 2)
SELECT oo.symbol, CAST(oo.ts AS DATE) AS day, {r('(composite + 1) / 2', 'vote_signal')}, {r('p', 'vote_mc')}, {r(f"sum(won) OVER (PARTITION BY oo.symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) / nullif(CAST(sum(closed) OVER (PARTITION BY oo.symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE), 0)", 'vote_bt')}, {r('target', 'target')} FROM oo LEFT JOIN cl ON cl.symbol = oo.symbol AND cl.exit = oo.ts""",
    "parameter_plateau": f"""WITH {BARS}, {', '.join(held(w) for w in (15, 20, 25))},
pos AS ({' UNION ALL '.join(f"SELECT symbol, ts, close, '{w}' AS strategy, CAST({latch('sc >= 0.5', 'sc <= -0.5')} AS DOUBLE) AS position FROM h{w}b" for w in (15, 20, 25))}), {RUNS},
e AS (SELECT *, equity / nullif(lag(equity) OVER ({PS}), 0) - 1 AS daily FROM run),
sp AS (SELECT symbol, CAST(strategy AS DOUBLE) AS value, CASE WHEN stddev_samp(daily) > 0 THEN avg(daily) / stddev_samp(daily) * sqrt({d(252)}) END AS sharpe FROM e GROUP BY symbol, strategy)
SELECT symbol, param, value, "offset", {r('sharpe', 'sharpe')}, "offset" = 0 AS is_base FROM (SELECT symbol, 'mr_window' AS param, value, value - 20 AS "offset", sharpe FROM sp
  UNION ALL SELECT symbol, 'mr_z_entry', v, o, sharpe FROM sp, (VALUES (1.3::DOUBLE, -0.2::DOUBLE), (1.5::DOUBLE, 0::DOUBLE), (1.7::DOUBLE, 0.2::DOUBLE)) t(v, o) WHERE value = 20)""",
    "sharpe_significance": f"""WITH RECURSIVE {RUN_WEEKLY}, e AS (SELECT *, equity / nullif(lag(equity) OVER ({PS}), 0) - 1 AS daily FROM run),
p1 AS (SELECT symbol, strategy, avg(daily) AS m, stddev_samp(daily) AS sd, stddev_pop(daily) AS sp, count(daily) AS n FROM e GROUP BY 1, 2),
p2 AS (SELECT e.symbol, e.strategy, any_value(m / nullif(sd, 0)) AS sr, any_value(p1.n) AS n, avg(pow((daily - m) / nullif(sp, 0), 3)) AS sk, avg(pow((daily - m) / nullif(sp, 0), 4)) AS ku FROM e JOIN p1 ON p1.symbol = e.symbol AND p1.strategy = e.strategy WHERE sd > 0 AND p1.n > 2 GROUP BY 1, 2),
p3 AS (SELECT *, sr / nullif(sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / nullif(CAST(n - 1 AS DOUBLE), 0)), 0) AS x FROM p2)
SELECT symbol, strategy, n, {r('sr', 'sharpe')}, {r(phi('x'), 'psr')}, {r(f'sqrt(2 * ln({d(8)}) / (n - 1))', 'expected_max')} FROM p3""",
    "equal_weight_buy_hold": f"""WITH {BARS}, fi AS (SELECT symbol, min(ts) AS t0, arg_min(close, ts) AS c0 FROM bars GROUP BY 1), dy AS (SELECT DISTINCT ts FROM bars),
g AS (SELECT dy.ts, fi.symbol, c0 FROM dy JOIN fi ON fi.t0 <= dy.ts), v AS (SELECT g.ts, b.close / c0 AS v FROM g ASOF JOIN bars b ON b.symbol = g.symbol AND g.ts >= b.ts)
SELECT CAST(ts AS DATE) AS day, {r('avg(v) * 100', 'value')}, count(*) AS n_symbols FROM v GROUP BY 1""",
    "drawdown_series": f"WITH {BARS}, a AS (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) SELECT symbol, {DAY}, {r('dd * 100', 'drawdown_pct')}, dd < 0 AS under_water FROM a",
    "live_ic": f"""WITH {BARS}, {Z}, {MA}, {COMPOSITE}, f AS (SELECT symbol, composite AS s, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS fwd FROM c), g0 AS (SELECT * FROM f WHERE s IS NOT NULL AND fwd IS NOT NULL),
h AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY s) + (count(*) OVER (PARTITION BY symbol, s) - 1) / {d(2)} AS a, rank() OVER (PARTITION BY symbol ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, fwd) - 1) / {d(2)} AS b FROM g0)
SELECT symbol, {r('corr(a, b)', 'live_ic')}, count(*) AS n FROM h GROUP BY 1 HAVING count(*) >= 10""",
    "effective_slippage": f"""WITH {BARS}, {SPREADS}, sl AS (SELECT fz.symbol, list_median([x FOR x IN [edge, corwin_schultz, roll] IF x IS NOT NULL]) AS cs FROM fz LEFT JOIN ed ON ed.symbol = fz.symbol LEFT JOIN cs ON cs.symbol = fz.symbol LEFT JOIN ro ON ro.symbol = fz.symbol),
la AS (SELECT symbol, arg_max(close, ts) AS close FROM bars GROUP BY 1)
SELECT la.symbol, {r('close', 'close', 4)}, {r(f'greatest(coalesce(cs * 10000, {d(5)}), (CASE WHEN close < 200 THEN 1 WHEN close < 500 THEN 2 WHEN close < 2000 THEN 5 WHEN close < 5000 THEN 10 ELSE 25 END) / close * 10000)', 'slippage_bps', 4)} FROM la JOIN sl ON sl.symbol = la.symbol""",
    "journal_close": f"""{TRADES} SELECT symbol, CAST(entry AS DATE) AS entry, {r('entry_price', 'entry_price')}, CASE WHEN exit_reason = 'signal' THEN CAST(exit AS DATE) END AS exit, {r("CASE WHEN exit_reason = 'signal' THEN exit_price END", 'exit_price')},
{r("CASE WHEN exit_reason = 'signal' THEN return_pct END", 'return_pct')}, CASE WHEN exit_reason = 'signal' THEN 'CLOSED' ELSE 'OPEN' END AS status FROM tr WHERE entry < TIMESTAMP '2000-01-01'""",
    "backtest_log_delete": f"{TRADES} SELECT symbol, CAST(year(exit) AS INTEGER) AS year, count(*) AS n_trades, {r('avg(return_pct)', 'avg_return_pct')} FROM tr GROUP BY symbol, year(exit) HAVING count(*) > 2",
    "order_tickets": f"""WITH {BARS}, a AS (SELECT *, {lag('close')} AS pc FROM brand), b AS (SELECT symbol, pc, close, CAST(floor(20000000 / nullif(pc, 0) / 100) * 100 AS BIGINT) AS q FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
SELECT symbol, {r('pc', 'price', 4)}, q AS quantity, {r('q * pc', 'value', 4)}, {r('(close - pc) * q', 'unrealised', 4)} FROM b""",
    "regime_vote": f"""WITH {SCAN}, ra AS (SELECT *, {change('close')} AS ret FROM bars), rb AS (SELECT symbol, ts, stddev_samp(ret) {over(20)} * sqrt({d(52)}) AS v FROM ra QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
rc AS (SELECT scan.*, CASE WHEN v > 0.4 THEN 'high' ELSE 'normal' END AS regime FROM scan JOIN rb ON rb.symbol = scan.symbol),
rd AS (SELECT *, CASE WHEN regime = 'high' THEN v1 * {d(0.35)} + v2 * {d(0.2)} + v3 * {d(0.35)} + v4 * {d(0.1)} ELSE v1 * {d(0.2)} + v2 * {d(0.4)} + v3 * {d(0.25)} + v4 * {d(0.15)} END AS o, greatest(v1, v2, v3, v4) - least(v1, v2, v3, v4) AS apart FROM rc)
SELECT symbol, regime, {r('o', 'overall')}, CASE WHEN apart > 0.4 THEN 'contrary' WHEN apart > 0.2 THEN 'slight' ELSE 'agreed' END AS agreement, symbol || ' ' || CASE WHEN o >= 0.55 THEN 'leans up' WHEN o <= 0.45 THEN 'leans down' ELSE 'is undecided' END || ' in a ' || regime || ' volatility regime' || CASE WHEN apart > 0.4 THEN ', but its parts contradict each other.' WHEN apart > 0.2 THEN ', with parts that differ a little.' ELSE '.' END AS narrative FROM rd""",
    "event_range_counts": f"""SELECT event_id, count(*) OVER w AS n_before, {r('coalesce(sum(value) OVER w, 0)', 'value_before', 4)} FROM (SELECT *, epoch_us(ts) AS us FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)""",
    "event_distinct_users": "SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events GROUP BY 1, 2",
    "calendar_outer": f"""WITH {BARS}, sg AS (SELECT c_mktsegment AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS day, arg_max(o_totalprice, o_orderkey) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
li AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(close AS DECIMAL(24, 6))) AS DOUBLE) / count(*) AS x FROM bars GROUP BY 1), od AS (SELECT day, CAST(sum(CAST(close AS DECIMAL(24, 6))) AS DOUBLE) / count(*) AS y FROM sg GROUP BY 1) SELECT coalesce(li.day, od.day) AS day, {r('x', 'line_close', 4)}, {r('y', 'order_close', 4)} FROM li FULL JOIN od ON li.day = od.day""",
    "calendar_gaps": f"""WITH {BARS}, w AS (SELECT symbol, CAST(ts AS DATE) AS week FROM brand), s AS (SELECT symbol, min(week) AS a, max(week) AS b FROM w GROUP BY 1), k AS (SELECT symbol, CAST(unnest(generate_series(a, b, INTERVAL 7 DAYS)) AS DATE) AS week FROM s)
SELECT k.symbol, k.week FROM k ANTI JOIN w ON w.symbol = k.symbol AND w.week = k.week""",
}

ORACLES["event_backtest_full"] = f"""WITH RECURSIVE {BRANDS}, {Z}, {MA}, {COMPOSITE},
a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n, lead(open) OVER (PARTITION BY symbol ORDER BY ts) AS fill, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS next_ts FROM c),
la AS (SELECT symbol, max(n) AS n, arg_max(close, ts) AS close FROM a GROUP BY 1),
en AS (SELECT symbol, n AS e, fill AS p FROM a WHERE signal = 'BUY' AND fill IS NOT NULL),
hi AS (SELECT en.symbol, en.e, min(a.n) AS x FROM en JOIN a ON a.symbol = en.symbol AND a.n > en.e AND a.n <= en.e + 31 AND a.next_ts IS NOT NULL AND (a.low <= p * (1 - {d(0.3)}) OR a.n - en.e - 1 >= 30 OR a.signal IN ('SELL', 'EXIT')) GROUP BY 1, 2),
ex AS (SELECT en.symbol, en.e, en.p, coalesce(hi.x, la.n) AS x, CASE WHEN hi.x IS NULL THEN la.close WHEN a.low <= p * (1 - {d(0.3)}) THEN p * (1 - {d(0.3)}) ELSE a.fill END AS q, hi.x IS NULL AS final
  FROM en JOIN la ON la.symbol = en.symbol LEFT JOIN hi ON hi.symbol = en.symbol AND hi.e = en.e LEFT JOIN a ON a.symbol = en.symbol AND a.n = hi.x),
nx AS (SELECT s.symbol, s.e, min(t.e) AS nxt FROM ex s JOIN ex t ON t.symbol = s.symbol AND t.e > s.x GROUP BY 1, 2),
ch AS (SELECT symbol, min(e) AS e FROM ex GROUP BY 1 UNION ALL SELECT ch.symbol, nx.nxt FROM ch JOIN nx ON nx.symbol = ch.symbol AND nx.e = ch.e),
tr AS (SELECT ex.*, product({d(0.9985)} * {d(0.9985)} * q / p) OVER (PARTITION BY ex.symbol ORDER BY ex.e ROWS UNBOUNDED PRECEDING) * 100 AS cash FROM ex JOIN ch ON ch.symbol = ex.symbol AND ch.e = ex.e),
mk AS (SELECT symbol, e AS n, cash / ({d(0.9985)} * {d(0.9985)} * q / p) * {d(0.9985)} / p AS units, CAST(NULL AS DOUBLE) AS cash, false AS final FROM tr UNION ALL SELECT symbol, x, CAST(NULL AS DOUBLE), cash, final FROM tr),
st AS (SELECT a.symbol, a.ts, a.n, a.close, a.next_ts, mk.final, last_value(CASE WHEN mk.symbol IS NOT NULL THEN {{{{'u': mk.units, 'c': mk.cash}}}} END IGNORE NULLS) OVER (PARTITION BY a.symbol ORDER BY a.ts ROWS UNBOUNDED PRECEDING) AS s FROM a LEFT JOIN mk ON mk.symbol = a.symbol AND mk.n = a.n),
eq AS (SELECT symbol, ts, coalesce(s.u * close, s.c, {d(100)}) AS equity FROM st WHERE next_ts IS NOT NULL OR final),
e1 AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS dd, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM eq),
e2 AS (SELECT symbol, arg_max(equity, ts) AS fin, avg(dd) AS m, stddev_samp(dd) AS sd, stddev_samp(dd) FILTER (dd < 0) AS down, min(fall) * 100 AS fall FROM e1 GROUP BY 1),
tc AS (SELECT symbol, count(*) AS k, avg(CASE WHEN q > p THEN {d(1)} ELSE 0 END) * 100 AS win, avg((q / p - 1) * 100) AS mean FROM tr GROUP BY 1)
SELECT e2.symbol, {r('ln(fin / 100)', 'log_total_return', 4)}, {r(f'm / nullif(sd, 0) * sqrt({d(252)})', 'sharpe', 4)}, {r(f'm / nullif(down, 0) * sqrt({d(252)})', 'sortino', 4)}, {r('fall', 'max_drawdown_pct', 4)}, coalesce(k, 0) AS n_trades, {r('win', 'win_rate_pct', 4)}, {r('mean', 'avg_trade_pct', 4)}
FROM e2 LEFT JOIN tc ON tc.symbol = e2.symbol""".replace("{{", "{").replace("}}", "}")


def preset(name: str, window: int, z_entry: float, fast: int, slow: int, weight: float, days: int, test: int) -> str:
    return f"""SELECT symbol, '{name}' AS preset, composite, CASE WHEN composite <= -0.5 THEN 'SELL' WHEN composite >= 0.5 THEN 'BUY' ELSE 'HOLD' END AS signal,
CASE WHEN abs(zz) <= 0.5 THEN 'EXIT' WHEN zz >= {d(z_entry)} THEN 'SELL' WHEN zz <= {d(-z_entry)} THEN 'BUY' ELSE 'HOLD' END AS z_signal, {phi('q')} AS prob_up, n_folds FROM (
SELECT *, {clip(f"{d(weight)} * {clip('zz', -3, 3)} / -3 + {d(1 - weight)} * coalesce(sign(df), 0)", -1, 1)} AS composite, (mu - sd * sd / 2) * {days} / nullif(sd * sqrt({d(days)}), 0) AS q FROM (
SELECT *, {roll('avg', 'lr', 90, 1)} AS mu, {roll('stddev_samp', 'lr', 90, 1)} AS sd FROM (
SELECT *, {roll('avg', 'close', fast)} - {roll('avg', 'close', slow)} AS df, (close - {roll('avg', 'close', window)}) / nullif({roll('stddev_samp', 'close', window)}, 0) AS zz, ln(close) - ln({lag('close')}) AS lr,
greatest((count(*) OVER (PARTITION BY symbol) - 100) // {test}, 0) AS n_folds FROM bars))) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"""


PRESET_ROWS = (("swing", 20, 1.5, 10, 30, 0.5, 15, 60), ("position", 40, 1.75, 20, 60, 0.4, 45, 120), ("long_term", 90, 2.0, 50, 150, 0.3, 90, 252))
ORACLES |= {
    "preset_signals": f"WITH {BARS}, u AS ({' UNION ALL '.join(f'(SELECT * FROM ({preset(*p)}))' for p in PRESET_ROWS)}) SELECT symbol, preset, {r('composite', 'composite')}, signal, z_signal, {r('prob_up', 'prob_up')}, n_folds FROM u",
    "movers": f"WITH {BARS}, a AS (SELECT *, {change('close')} AS c FROM brand), b AS (SELECT symbol, arg_max(c, ts) AS c FROM a GROUP BY 1) SELECT count(*) FILTER (c > 0) AS up, count(*) FILTER (c < 0) AS down, count(*) FILTER (c = 0) AS flat FROM b WHERE c IS NOT NULL",
    "sentiment_enrichment": f"""WITH {BRANDS}, {Z}, {MA}, {COMPOSITE},
t AS (SELECT symbol, ['de', 'en', 'es', 'fr'][CAST(right(symbol, 1) AS INTEGER) % 4 + 1] AS lang, (composite + 1) / 2 AS o FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
s AS (SELECT lang, avg(s) AS s FROM (SELECT d.doc_id, d.lang, avg(CAST(quality - toxic AS DOUBLE)) AS s FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2) GROUP BY 1)
SELECT symbol, t.lang, {r('o', 'overall')}, {r('s', 'sentiment')} FROM t LEFT JOIN s ON s.lang = t.lang""",
    "universe_sources": """SELECT DISTINCT replace(upper(trim(p_brand || '.' || p_size)), '.', '-') AS symbol, 'code' AS kind FROM part UNION ALL SELECT DISTINCT upper(p_type) || '/IDR', 'pair' FROM part WHERE p_size % 2 <> 0""",
    "precompute_rows": f"WITH {SCAN} SELECT symbol, CASE WHEN composite <= -0.5 THEN 'SELL' WHEN composite >= 0.5 THEN 'BUY' ELSE 'HOLD' END AS signal, {r('composite', 'score')}, {r('pp', 'mc_prob_profit')}, {r('win', 'win_rate')}, tier AS liq_tier FROM scan",
    "portfolio_stats": f"""WITH {BARS}, ty AS (SELECT p_type AS symbol, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts, arg_max(price, k) AS close FROM line JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
fd AS (SELECT ts FROM ty GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ty)), rt AS (SELECT * FROM (SELECT symbol, ts, {change('close')} AS ret FROM ty WHERE ts IN (FROM fd)) WHERE ret IS NOT NULL),
iv AS (SELECT symbol, 1 / nullif(var_samp(ret), 0) AS w FROM rt GROUP BY 1), wt AS (SELECT symbol, 'equal' AS name, {d(1)} / (SELECT count(*) FROM iv) AS w FROM iv UNION ALL SELECT symbol, 'inverse_variance', w / (SELECT sum(w) FROM iv) FROM iv),
dy AS (SELECT name, ts, sum(w * ret) AS ret FROM rt JOIN wt ON wt.symbol = rt.symbol GROUP BY 1, 2), dv AS (SELECT *, product(1 + ret) OVER (PARTITION BY name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM dy),
df AS (SELECT *, v / greatest(1, max(v) OVER (PARTITION BY name ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1 AS fall FROM dv)
SELECT name, count(*) AS n_days, {r('avg(ret) * 52', 'annual_return')}, {r(f'stddev_samp(ret) * sqrt({d(52)})', 'annual_vol')}, {r('min(fall) * 100', 'max_drawdown_pct')}, {r(f'avg(ret) * 52 / nullif(stddev_samp(ret) * sqrt({d(52)}), 0)', 'sharpe')} FROM df GROUP BY 1""",
}

ORACLES |= {
    "skill_bootstrap": f"""WITH {OUT}, nt AS (SELECT symbol, p, target AS a, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM ok), {blocks('nt', 1000, 15)},
sm AS (SELECT d3.symbol, d3.sample, any_value(n) AS n, avg((p - a) * (p - a)) AS brier, avg(a) * (1 - avg(a)) AS base FROM d3 JOIN nt ON nt.symbol = d3.symbol AND nt.i = d3.i GROUP BY 1, 2),
sk AS (SELECT *, CASE WHEN base > 1e-9 THEN 1 - brier / base END AS skill FROM sm)
SELECT symbol, any_value(n) AS n, {', '.join(r(f'quantile_cont(skill, {p / 100})', f'skill_p{p}') for p in (5, 50, 95))}, coalesce(quantile_cont(skill, 0.05) > 0, false) AS significant FROM sk GROUP BY 1""",
    "path_subsample": f"WITH {BARS}, {PATHS}, sb AS (SELECT CAST(sim AS BIGINT) AS sim FROM range(2000) a(sim) ORDER BY {drawn('sim')}, sim LIMIT 300) SELECT symbol, CAST(sim AS INTEGER) AS sim, CAST(day AS INTEGER) AS day, {r('price', 'price')} FROM paths WHERE sim IN (SELECT sim FROM sb)",
    "random_portfolios": f"""WITH {BARS}, ty AS (SELECT p_type AS symbol, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts, arg_max(price, k) AS close FROM line JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
fd AS (SELECT ts FROM ty GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ty)), rt AS (SELECT * FROM (SELECT symbol, ts, {change('close')} AS ret FROM ty WHERE ts IN (FROM fd)) WHERE ret IS NOT NULL),
me AS (SELECT symbol, avg(ret) * 52 AS mean, row_number() OVER (ORDER BY symbol) - 1 AS nth, count(*) OVER () AS k FROM rt GROUP BY 1),
dr AS (SELECT symbol, mean, q AS portfolio, -ln(({drawn('q * k + nth + 1')} + {d(0.5)}) / {d(X)}) AS x FROM me, range(4000) a(q)), wt AS (SELECT *, x / sum(x) OVER (PARTITION BY portfolio) AS w FROM dr),
cv AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) AS c FROM rt a JOIN rt b ON a.ts = b.ts GROUP BY 1, 2),
va AS (SELECT x.portfolio, sqrt(sum(x.w * y.w * c) * 52) AS vol FROM wt x JOIN cv ON cv.a = x.symbol JOIN wt y ON y.symbol = cv.b AND y.portfolio = x.portfolio GROUP BY 1), ga AS (SELECT portfolio, sum(w * mean) AS ret FROM wt GROUP BY 1)
SELECT CAST(ga.portfolio AS INTEGER) AS portfolio, {r('ret', 'annual_return')}, {r('vol', 'annual_vol')}, {r('ret / nullif(vol, 0)', 'sharpe')} FROM ga JOIN va ON va.portfolio = ga.portfolio""",
}


def signalled(stop: float | None, extra: str) -> str:
    """Trades of buying signals, one position at a time, by walking from each to its successor."""
    touched = f"(SELECT min(x.n) FROM b2 x WHERE x.symbol = b.symbol AND x.n BETWEEN b.n + 1 AND b.ends AND x.low <= b.fill * {d(1.0025)} * {d(1 - stop)})" if stop else "CAST(NULL AS BIGINT)"
    stop_price = f"entry * {d(1 - stop)}" if stop else "NULL"
    return f"""WITH RECURSIVE {BARS}, {Z}, {MA}, {COMPOSITE},
b0 AS (SELECT *, row_number() OVER s - 1 AS n, lead(open) OVER s AS fill, count(*) OVER (PARTITION BY symbol) - 1 AS ln FROM c {WINDOW}),
b1 AS (SELECT *, min(CASE WHEN signal IN ('SELL', 'EXIT') AND n < ln THEN n END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING) AS sold FROM b0),
b2 AS (SELECT *, least(coalesce(sold, ln), n + 16, ln) AS ends FROM b1),
b3 AS (SELECT symbol, ts, n, ln, ends, fill * {d(1.0025)} AS entry, (coalesce(sold = ends, false) OR ends = n + 16) AND ends < ln AS told, {touched} AS stopped FROM b2 b WHERE signal = 'BUY' AND fill IS NOT NULL),
b4 AS (SELECT *, coalesce(stopped, CASE WHEN told THEN ends + 1 ELSE ln END) AS exit_n FROM b3),
b5 AS (SELECT *, (SELECT min(y.n) FROM b3 y WHERE y.symbol = b4.symbol AND y.n >= greatest(b4.exit_n, b4.n + 1)) AS follows FROM b4),
walk AS (SELECT symbol, min(n) AS n FROM b5 GROUP BY 1 UNION ALL SELECT w.symbol, b5.follows FROM walk w JOIN b5 ON b5.symbol = w.symbol AND b5.n = w.n WHERE b5.follows IS NOT NULL),
sold AS (SELECT b5.*, ((CASE WHEN stopped IS NOT NULL THEN {stop_price} WHEN told THEN p.open ELSE p.close END) * {d(0.9965)} / entry - 1) * 100 AS return_pct
  FROM walk JOIN b5 USING (symbol, n) JOIN b2 p ON p.symbol = b5.symbol AND p.n = b5.exit_n)
{extra}"""


LABELLED = f"CAST(n AS INTEGER) AS n, CAST(exit_n AS INTEGER) AS exit_n, {r('return_pct', 'return_pct')}, CAST(return_pct > 0 AS INTEGER) AS label"
KNOWN = " AND ".join(f"f.{c} IS NOT NULL" for c in ("ret_5", "ret_20", "vol_20", "rsi", "atr_ratio", "volume_ratio"))
ORACLES |= {
    "meta_label_samples": signalled(None, f""", f AS ({ORACLES["ml_features"]})
SELECT sold.symbol, CAST(sold.ts AS DATE) AS day, {LABELLED}, {r('c.composite', 'composite')}, {r('c.z', 'z')}, f.vol_20
FROM sold JOIN c ON c.symbol = sold.symbol AND c.ts = sold.ts JOIN f ON f.symbol = sold.symbol AND f.day = CAST(sold.ts AS DATE) WHERE composite IS NOT NULL AND c.z IS NOT NULL AND {KNOWN}"""),
    "signalled_trades_stops": signalled(0.2, f"SELECT symbol, {DAY}, {LABELLED} FROM sold"),
}

ORACLES["log_update"] = f"""WITH {BARS}, {Z}, {MA}, {COMPOSITE}, k AS (SELECT symbol, ts, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM bars WHERE ts < DATE '1999-01-04')
SELECT c.symbol, CAST(c.ts AS DATE) AS day, c.signal AS verdict, {r(f"CASE WHEN c.ts < DATE '1998-12-28' THEN (later / nullif(c.close, 0) - 1) * 100 END", 'fwd_return_pct')}
FROM c LEFT JOIN k ON k.symbol = c.symbol AND k.ts = c.ts WHERE c.ts < DATE '1999-01-01'"""
ORACLES |= {
    "event_sliding_bars": f"""WITH w AS (SELECT *, time_bucket(INTERVAL 15 MINUTES, ts) - unnest([0, 1, 2, 3]) * INTERVAL 15 MINUTES AS s FROM events)
SELECT event_type AS symbol, CAST(epoch(s) AS BIGINT) AS start, {r('arg_min(value, row(ts, event_id))', 'open', 4)}, {r('max(value)', 'high', 4)}, {r('min(value)', 'low', 4)}, {r('arg_max(value, row(ts, event_id))', 'close', 4)}, count(*) AS volume, {r('sum(value)', 'total', 4)} FROM w GROUP BY 1, s""",
    "event_once_per_day": f"SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_min(event_id, row(ts, event_id)) AS event_id, {r('arg_min(value, row(ts, event_id))', 'value', 4)} FROM events GROUP BY 1, 2, 3",
}

TICK = "(CASE WHEN close < 200 THEN 1 WHEN close < 500 THEN 2 WHEN close < 2000 THEN 5 WHEN close < 5000 THEN 10 ELSE 25 END)"
#: Spreads at every bar: the estimators over the 20 bars up to each, a window to a bar.
SPREAD_BARS = f"""{BARS.replace("bars AS (", "day_bars AS (")},
ends AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM day_bars),
bars AS (SELECT e.symbol || '@' || e.n AS symbol, b.ts, b.open, b.high, b.low, b.close, b.volume FROM ends e JOIN ends b ON b.symbol = e.symbol AND b.n > e.n - 20 AND b.n <= e.n),
{SPREADS},
sp AS MATERIALIZED (SELECT ends.*, edge, corwin_schultz, roll, list_median([x FOR x IN [edge, corwin_schultz, roll] IF x IS NOT NULL]) AS consensus
  FROM ends LEFT JOIN ed ON ed.symbol = ends.symbol || '@' || n LEFT JOIN cs ON cs.symbol = ends.symbol || '@' || n LEFT JOIN ro ON ro.symbol = ends.symbol || '@' || n)"""
ORACLES["bar_spreads"] = f"WITH {SPREAD_BARS} SELECT symbol, {DAY}, {', '.join(r(x, x) for x in ('edge', 'corwin_schultz', 'roll', 'consensus'))} FROM sp"
#: An account in whole lots: the end of every possible position, then one possible position of each symbol a step.
LOTS = f"""WITH RECURSIVE {SPREAD_BARS}, {', '.join((Z, MA)).replace('FROM bars', 'FROM sp')}, {COMPOSITE},
lk AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM c),
a1 AS (SELECT *, coalesce(close / nullif(pc, 0) - 1 <= -(CASE WHEN pc < 200 THEN {d(0.25)} WHEN pc < 5000 THEN {d(0.2)} ELSE {d(0.15)} END) + {d('1e-9')} AND abs(close - low) <= {d('1e-8')} + {d('1e-5')} * abs(low), false) AS barred,
  greatest(coalesce(consensus * 10000, {d(5)}), {TICK} / close * 10000) AS slip FROM lk),
a AS MATERIALIZED (SELECT symbol, ts, n, low, close, signal, barred, slip, lead(close) OVER w AS fill, lead(ts) OVER w AS day, lead(barred) OVER w AS barred_next, lead(slip) OVER w AS slip_next,
  avg(close * volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS turnover FROM a1 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
la AS (SELECT symbol, max(n) AS n, arg_max(close, ts) AS close, arg_max(slip, ts) AS slip, max(ts) AS ts FROM a GROUP BY 1),
en AS MATERIALIZED (SELECT *, n AS e, fill AS p, fill * (1 - {d(0.1)}) AS stop FROM a WHERE signal = 'BUY' AND fill IS NOT NULL),
hi AS (SELECT en.symbol, e, min(a.n) AS x FROM en JOIN a ON a.symbol = en.symbol AND a.n > e AND a.day IS NOT NULL
  AND CASE WHEN a.low <= stop THEN NOT a.barred ELSE a.n - e - 1 >= 15 OR (a.signal IN ('SELL', 'EXIT') AND NOT a.barred_next) END GROUP BY 1, 2),
ex AS MATERIALIZED (SELECT en.symbol, en.e, en.p, en.day AS entry, en.slip AS slip_in, en.turnover, coalesce(hi.x, la.n) AS x, row_number() OVER (PARTITION BY en.symbol ORDER BY en.e) AS k,
  CASE WHEN hi.x IS NULL THEN la.close WHEN a.low <= stop THEN stop ELSE a.fill END AS q, CASE WHEN hi.x IS NULL THEN la.ts WHEN a.low <= stop THEN a.ts ELSE a.day END AS exit,
  CASE WHEN hi.x IS NULL THEN la.slip WHEN a.low <= stop THEN a.slip ELSE a.slip_next END AS slip_out,
  CASE WHEN hi.x IS NULL THEN 'end_of_data' WHEN a.low <= stop THEN 'stop_loss' WHEN a.n - en.e - 1 >= 15 THEN 'max_holding_days' ELSE 'signal' END AS exit_reason
  FROM en JOIN la ON la.symbol = en.symbol LEFT JOIN hi ON hi.symbol = en.symbol AND hi.e = en.e LEFT JOIN a ON a.symbol = en.symbol AND a.n = hi.x),
st AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS free, {d('1e6')} AS cash, {d(0)} AS units, false AS took FROM ex
  UNION ALL SELECT symbol, k, CASE WHEN took THEN x + 1 ELSE free END, CASE WHEN took THEN cash - units * p / kept + units * q * (1 - (25 + slip_out) / 10000) ELSE cash END, units, took
  FROM (SELECT *, e >= free AND units > 0 AS took FROM (SELECT ex.symbol, ex.k, e, x, p, q, slip_out, free, cash, 1 - (15 + slip_in) / 10000 AS kept,
    floor(least(cash * {d(0.05)}, {d(0.2)} * turnover) * (1 - (15 + slip_in) / 10000) / p / 5) * 5 AS units FROM st JOIN ex ON ex.symbol = st.symbol AND ex.k = st.k + 1))),
tr AS (SELECT ex.*, st.units, st.cash FROM st JOIN ex ON ex.symbol = st.symbol AND ex.k = st.k WHERE took)"""
ORACLES |= {
    "event_backtest_lots": f"""{LOTS.replace('consensus * 10000', 'NULL')} SELECT symbol, CAST(entry AS DATE) AS entry, CAST(exit AS DATE) AS exit, {r('p', 'entry_price', 4)}, {r('q', 'exit_price', 4)}, {r('(q / p - 1) * 100', 'return_pct', 4)}, exit_reason,
{r('slip_in', 'slip_in', 4)}, {r('slip_out', 'slip_out', 4)}, {r('ln(units)', 'log_units', 4)}, {r('ln(cash)', 'log_cash', 4)} FROM tr""",
    "event_backtest_lots_metrics": f"""{LOTS} SELECT symbol, {r('avg(slip_in + slip_out) / 2', 'effective_slippage_bps', 4)}, count(*) FILTER (exit_reason = 'stop_loss') AS n_stop_loss, count(*) FILTER (exit_reason = 'max_holding_days') AS n_max_holding FROM tr GROUP BY 1""",
}
