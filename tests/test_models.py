"""Models of many groups against NumPy and plain loops."""

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import regression as reg
from tickloom.operators import samples as smp


def newton(x, y, penalty=1.0):
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def pooled(xs, ys):
    """Steps (low, high, value) by pooling neighbours, one at a time."""
    rows = {}
    for x, y in zip(xs, ys):
        rows.setdefault(x, []).append(y)
    steps = []
    for x in sorted(rows):
        steps.append([x, x, sum(rows[x]), len(rows[x])])
        while len(steps) > 1 and steps[-2][2] / steps[-2][3] >= steps[-1][2] / steps[-1][3]:
            _, high, s, n = steps.pop()
            steps[-1] = [steps[-1][0], high, steps[-1][2] + s, steps[-1][3] + n]
    return [(a, b, s / n, n) for a, b, s, n in steps]


def at_steps(steps, x):
    knots = [(k, v) for a, b, v, _ in steps for k in (a, b)]
    return float(np.interp(x, [k for k, _ in knots], [v for _, v in knots]))


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    out = {}
    for g in range(5):
        n = 40 + 30 * g
        x = rng.normal(size=(n, 3)) * [1, 3, 0.2]
        y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1, -0.5, 2] + g - 2)))).astype(float)
        out[f"g{g}"] = (x, y)
    return out


def frame(spark, groups):
    rows = [(g, *map(float, r), float(t)) for g, (x, y) in groups.items() for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "symbol string, a double, b double, c double, y double").repartition(4)


def test_logistic_equals_newton_in_numpy(spark, groups):
    got = {r.symbol: r for r in reg.fit_logistic(frame(spark, groups), ["symbol"], ["a", "b", "c"], "y").collect()}
    assert set(got) == set(groups)
    for g, (x, y) in groups.items():
        assert got[g].coef == pytest.approx(newton(x, y), abs=1e-6) and got[g].n == len(y)


def test_logistic_leaves_out_nulls_and_single_classes(spark):
    rows = spark.createDataFrame([("one", 1.0, 1.0), ("one", 2.0, 1.0), ("two", 1.0, 0.0), ("two", None, 0.0), ("two", 2.0, 1.0)], "symbol string, a double, y double")
    got = reg.fit_logistic(rows, ["symbol"], ["a"], "y").collect()
    assert [(r.symbol, r.n) for r in got] == [("two", 2)]
    assert got[0].coef == pytest.approx(newton(np.array([[1.0], [2.0]]), np.array([0.0, 1.0])), abs=1e-6)
    assert reg.fit_logistic(rows.limit(0), ["symbol"], ["a"], "y").count() == 0


def test_isotonic_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    data = {g: (np.round(rng.random(n), d), (rng.random(n) < 0.5).astype(float)) for g, n, d in (("few", 3, 3), ("ties", 120, 1), ("many", 300, 3))}
    data["falling"] = (np.arange(50) / 50, np.arange(50)[::-1] * 1.0)
    rows = spark.createDataFrame([(g, float(x), float(y)) for g, (xs, ys) in data.items() for x, y in zip(xs, ys)], "symbol string, x double, y double").repartition(3)
    steps = reg.fit_isotonic(rows, ["symbol"], "x", "y")
    got = {}
    for r in steps.orderBy("symbol", "low").collect():
        got.setdefault(r.symbol, []).append((r.low, r.high, r.value, r.n))
    assert got == {g: pooled(*xy) for g, xy in data.items()}
    asked = spark.createDataFrame([(g, float(x)) for g in data for x in np.linspace(-0.2, 1.2, 37)] + [("none", 0.5), ("few", None)], "symbol string, x double")
    for r in reg.apply_isotonic(asked, steps, ["symbol"], "x", "c").collect():
        if r.symbol == "none" or r.x is None:
            assert r.c is None
        else:
            assert r.c == pytest.approx(at_steps(got[r.symbol], r.x))
    assert reg.fit_isotonic(rows.limit(0), ["symbol"], "x", "y").count() == 0


def test_meta_model_equals_numpy(spark):
    rng = np.random.default_rng(8)
    data, rows = {}, []
    for s, n in (("A", 203), ("B", 150), ("short", 59), ("thin", 80)):
        x = rng.random((n, 3))
        y = (rng.random(n) < 0.2 + 0.6 * x[:, 0]).astype(float)
        data[s] = (x, y)
        rows += [(s, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    rows.append(("A", dt.datetime(2019, 1, 1), None, 0.5, 0.5, 1.0))
    feats = spark.createDataFrame(rows, "symbol string, ts timestamp, vote_signal double, vote_mc double, vote_bt double, target double")
    got = {r.symbol: r for r in reg.meta_model(feats, n_resamples=120).collect()}
    assert set(got) == {"A", "B"}
    for s, r in got.items():
        x, y = data[s]
        size = len(y) // 5
        folds = []
        for f in range(4):
            w = newton(x[: size * (f + 1)], y[: size * (f + 1)])
            t = slice(size * (f + 1), size * (f + 2))
            folds.append((1 / (1 + np.exp(-(w[0] + x[t] @ w[1:]))), y[t]))
        steps = pooled(np.concatenate([p for p, _ in folds[:2]]).tolist(), np.concatenate([a for _, a in folds[:2]]).tolist())
        p, a = (np.concatenate([f[i] for f in folds[2:]]) for i in (0, 1))
        brier, base = np.mean((np.array([at_steps(steps, v) for v in p]) - a) ** 2), a.mean() * (1 - a.mean())
        assert (r.n_samples, r.n_oos) == (len(y), 2 * size)
        assert [r.intercept, r.w_vote_signal, r.w_vote_mc, r.w_vote_bt] == pytest.approx(newton(x, y), abs=1e-6)
        assert [r.brier_model, r.brier_baseline, r.skill] == pytest.approx([brier, base, 1 - brier / base], abs=1e-6)
        assert r.skill_p5 <= r.skill_p50 <= r.skill_p95 and r.significant == (r.skill_p5 > 0)


def plain_trades(bars, stop=None, hold=15):
    """bars: (open, low, close, signal) of one symbol; rows of (n, exit_n, return_pct)."""
    out, i, n = [], 0, len(bars)
    while i < n - 1:
        if bars[i][3] != "BUY":
            i += 1
            continue
        entry = bars[i + 1][0] * 1.0025
        price = None
        for j in range(i + 1, n):
            if stop and bars[j][1] <= entry * (1 - stop):
                price, at = entry * (1 - stop), j
            elif bars[j][3] in ("SELL", "EXIT") and j + 1 < n:
                price, at = bars[j + 1][0], j + 1
            elif j - i - 1 >= hold:
                price, at = (bars[j + 1][0], j + 1) if j + 1 < n else (bars[j][2], j)
            if price is not None:
                break
        if price is None:
            price, at = bars[-1][2], n - 1
        out.append((i, at, (price * 0.9965 / entry - 1) * 100))
        i = max(at, i + 1)
    return out


@pytest.mark.parametrize("stop", [None, 0.05])
def test_trades_equal_a_walk_over_the_bars(spark, stop):
    rng = np.random.default_rng(11)
    data, rows = {}, []
    for s, n, p in (("A", 400, 0.3), ("B", 90, 0.9), ("C", 17, 1.0), ("D", 2, 1.0), ("E", 1, 1.0), ("F", 60, 0.0)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        open_ = close * np.exp(rng.normal(0, 0.01, n))
        low = np.minimum(open_, close) * (1 - abs(rng.normal(0, 0.01, n)))
        sell = 0 if s in "BC" else 0.1
        signal = ["BUY" if u < p else "SELL" if u < p + sell else "EXIT" if u < p + sell + 0.02 * (s == "A") else "HOLD" for u in rng.random(n)]
        data[s] = list(zip(open_.tolist(), low.tolist(), close.tolist(), signal))
        rows += [(s, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *b) for i, b in enumerate(data[s])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, low double, close double, signal string").repartition(3)
    got = {}
    for r in smp.signalled_trades(df, stop_loss_pct=stop).orderBy("symbol", "n").collect():
        got.setdefault(r.symbol, []).append((r.n, r.exit_n, r.return_pct))
        assert r.label == (r.return_pct > 0)
    want = {s: t for s, b in data.items() if (t := plain_trades(b, stop))}
    assert {s: [x[:2] for x in t] for s, t in got.items()} == {s: [x[:2] for x in t] for s, t in want.items()}
    for s, t in want.items():
        assert [x[2] for x in got[s]] == pytest.approx([x[2] for x in t])


@pytest.mark.parametrize("features", [None, ("f",)])
def test_trades_read_what_bars_are_made_of_once(spark, features):
    """Rounds and joins go back to the bars many times; rows that they come from are far more."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rng, start = np.random.default_rng(3), dt.datetime(2020, 1, 1)
    rows = [("A", start + dt.timedelta(days=i), 100.0, 90 + 10 * float(rng.random()), 100.0 + float(rng.normal()), ("BUY", "HOLD", "SELL")[rng.integers(3)], 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, low double, close double, signal string, f double")
    df = df.mapInArrow(counted, df.schema)
    trades = smp.meta_label_samples(df, features, stop_loss_pct=0.05) if features else smp.signalled_trades(df, stop_loss_pct=0.05)
    assert trades.count() > 10 and made.value == 200


def test_meta_label_model_learns_only_from_trades_before(spark):
    rng = np.random.default_rng(4)
    n, rows = 140, []
    for i in range(n):
        f, g = rng.normal(size=2)
        win = int(rng.random() < 1 / (1 + np.exp(-2 * f)))
        rows.append(("A", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), win, 3.0 if win else -2.0, float(f), float(g)))
    rows += [("B", *r[1:]) for r in rows[:29]]
    got = reg.meta_label_model(spark.createDataFrame(rows, "symbol string, ts timestamp, label int, return_pct double, f double, g double"), ("f", "g")).collect()
    assert [r.symbol for r in got] == ["A"]
    x, y = np.array([r[4:] for r in rows[:n]]), np.array([r[2] for r in rows[:n]], float)
    block = np.where(np.arange(n) < 20, -1, (np.arange(n) - 20) * 5 // (n - 20))
    p = np.full(n, np.nan)
    for k in range(5):
        past, now = block < k, block == k
        m, d = x[past].mean(0), x[past].std(0)
        w = newton((x[past] - m) / d, y[past])
        p[now] = 1 / (1 + np.exp(-(w[0] + (x[now] - m) / d @ w[1:])))
    p, y = p[20:], y[20:]
    take = p >= 0.5
    r = got[0]
    assert (r.n_samples, r.n_oos) == (n, n - 20)
    assert [r.base_win_rate, r.coverage, r.filtered_win_rate, r.skipped_win_rate] == pytest.approx([100 * y.mean(), take.mean(), 100 * y[take].mean(), 100 * y[~take].mean()])
    assert r.bss == pytest.approx(1 - np.mean((p - y) ** 2) / (y.mean() * (1 - y.mean())), abs=1e-6)
    assert r.filtered_win_rate > r.base_win_rate > r.skipped_win_rate
