"""Weights and components against NumPy; logs on disk that are run twice and after a failure."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.store import shared_dir
from tickloom.operators import parity, weights
from tickloom.sources import log_store


def bars(spark, prices):
    rows = [(f"S{j:02d}", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(p)) for i, row in enumerate(prices) for j, p in enumerate(row)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double").repartition(3)


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(6)
    common = rng.normal(0, 0.02, (120, 2)) @ rng.normal(size=(2, 11))
    return 100 * np.exp(np.cumsum(0.001 + common + rng.normal(0, 0.01, (120, 11)) * np.linspace(0.5, 3, 11), axis=0))


def test_closed_forms_equal_numpy(spark, prices):
    rets = prices[1:] / prices[:-1] - 1
    cov, mu, one = np.cov(rets.T) * 252, rets.mean(0) * 252, np.ones(11)
    g, t = np.linalg.solve(cov, one), np.linalg.solve(cov, mu - 0.03)
    rows = weights.closed_form_weights(bars(spark, prices), risk_free=0.03).orderBy("symbol").collect()
    assert [r.gmv for r in rows] == pytest.approx(g / g.sum(), abs=1e-8)
    assert [r.tangency for r in rows] == pytest.approx(t / t.sum(), abs=1e-8)
    residual = cov @ (np.array([r.gmv for r in rows]) * g.sum()) - one
    assert abs(residual).max() < 1e-8 and sum(r.equal for r in rows) == pytest.approx(1)


def parity_by_loops(rets):
    """Order and weights from the whole matrix: nearest clusters first, the one made earlier to the left."""
    cov, corr = np.cov(rets.T), np.corrcoef(rets.T)
    distance, clusters, made = np.sqrt(np.maximum(0, (1 - corr) / 2)), {i: [i] for i in range(len(cov))}, len(cov)
    while len(clusters) > 1:
        _, a, b = min((distance[np.ix_(x, y)].min(), i, j) for i, x in clusters.items() for j, y in clusters.items() if i < j)
        clusters[made] = clusters.pop(a) + clusters.pop(b)
        made += 1
    order, w = clusters.popitem()[1], np.ones(len(cov))

    def variance(items):
        part = cov[np.ix_(items, items)]
        inverse = 1 / np.diag(part) / (1 / np.diag(part)).sum()
        return inverse @ part @ inverse

    def halve(items):
        if len(items) > 1:
            left, right = items[: len(items) // 2], items[len(items) // 2 :]
            share = 1 - variance(left) / (variance(left) + variance(right))
            w[left] *= share
            w[right] *= 1 - share
            halve(left)
            halve(right)

    halve(order)
    return order, w


@pytest.mark.parametrize("tile", [256, 4])
def test_parity_equals_loops(spark, monkeypatch, tile):
    monkeypatch.setattr(parity, "TILE", tile)
    rng = np.random.default_rng(9)
    rets = rng.normal(0, 0.02, (90, 5)) @ rng.normal(size=(5, 25)) * 0.5 + rng.normal(0, 0.02, (90, 25)) * np.linspace(0.3, 2, 25)
    prices = 100 * np.exp(np.cumsum(rets, axis=0))
    order, w = parity_by_loops(prices[1:] / prices[:-1] - 1)
    rows = parity.parity_weights(bars(spark, prices)).orderBy("symbol").collect()
    assert [r.hrp for r in rows] == pytest.approx(w, abs=1e-10) and sum(r.hrp for r in rows) == pytest.approx(1)
    assert [int(r.symbol[1:]) for r in sorted(rows, key=lambda r: r.place)] == order


def test_parity_of_few_symbols(spark, prices):
    assert [r.hrp for r in parity.parity_weights(bars(spark, prices[:, :1])).collect()] == [1.0]
    a, b = (np.diff(prices[:, :2], axis=0) / prices[:-1, :2]).var(0, ddof=1)
    assert [r.hrp for r in parity.parity_weights(bars(spark, prices[:, :2])).orderBy("symbol").collect()] == pytest.approx([b / (a + b), a / (a + b)])
    assert parity.parity_weights(bars(spark, prices[:1])).count() == 0 == parity.parity_weights(bars(spark, prices).limit(0)).count()
    flat = np.hstack([prices[:, :2], np.full((len(prices), 1), 5.0)])
    assert parity.parity_weights(bars(spark, flat)).count() == 2
    twins = parity.parity_weights(bars(spark, np.hstack([prices[:, :1]] * 4))).collect()
    assert [r.hrp for r in twins] == pytest.approx([0.25] * 4)


def test_two_symbols_by_hand(spark, prices):
    two = prices[:, :2]
    a, b = np.diff(two, axis=0).T / two[:-1].T
    s, t, c = a.var(ddof=1), b.var(ddof=1), np.cov(a, b)[0, 1]
    rows = weights.closed_form_weights(bars(spark, two)).orderBy("symbol").collect()
    assert rows[0].gmv == pytest.approx((t - c) / (s + t - 2 * c), abs=1e-9)


def test_undetermined_weights_are_null(spark, prices):
    same = np.column_stack([prices[:4, 0], prices[:4, 1], prices[:4, 2], prices[:4, 3], prices[:4, 4]])  # three returns for five symbols
    assert all(r.gmv is None for r in weights.closed_form_weights(bars(spark, same)).collect())
    assert weights.closed_form_weights(bars(spark, prices).limit(0)).count() == 0
    assert weights.components(bars(spark, prices).limit(0)).count() == 0


def test_components_equal_numpy(spark, prices):
    values, vectors = np.linalg.eigh(np.corrcoef((prices[1:] / prices[:-1] - 1).T))
    rows = weights.components(bars(spark, prices)).orderBy("component", "symbol").collect()
    for c in (1, 2, 3):
        mine = [r for r in rows if r.component == c]
        want = vectors[:, -c] * np.sign(vectors[np.argmax(abs(vectors[:, -c])), -c])
        assert [r.loading for r in mine] == pytest.approx(want, abs=1e-6)
        assert mine[0].eigenvalue == pytest.approx(values[-c]) and mine[0].explained_pct == pytest.approx(values[-c] / 11 * 100)


def logged(spark, path):
    return {(r.symbol, r.log_date.isoformat()): r.fwd_return_pct for r in log_store.load(spark, path, log_store.SIGNAL_LOG).collect()}


def test_log_is_updated_in_place(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert log_store.load(spark, path, log_store.SIGNAL_LOG).count() == 0
    closes = [(s, dt.datetime(2021, 1, 1) + dt.timedelta(days=i), 100.0 + i * (1 + j)) for j, s in enumerate("AB") for i in range(50)]
    daily = spark.createDataFrame(closes, "symbol string, ts timestamp, close double")
    rows = daily.where("day(ts) IN (1, 10, 20)").selectExpr("symbol", "to_date(ts) log_date", "0.1 composite", "'BUY' verdict", "close close_at_signal")
    keys = ["symbol", "log_date"]
    log_store.append(path, rows.where("log_date < DATE'2021-01-15'"), log_store.SIGNAL_LOG, keys, "log_date")
    for _ in range(2):
        log_store.append(path, rows.unionByName(rows), log_store.SIGNAL_LOG, keys, "log_date")
    assert len(logged(spark, path)) == 10 == log_store.load(spark, path, log_store.SIGNAL_LOG).count()
    today = dt.date(2021, 2, 16)
    failing = daily.withColumn("close", F.when(F.col("symbol") == "B", F.raise_error(F.lit("lost"))).otherwise(F.col("close")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        log_store.fill_forward_returns(path, failing, today)
    assert set(logged(spark, path).values()) == {None}
    part = lambda month: sorted((tmp_path / "log" / f"log_month={month}").glob("*.parquet"))
    young = part("2021-02")
    assert log_store.fill_forward_returns(path, daily, dt.date(2021, 1, 31)) == 1
    first = logged(spark, path)
    assert first["A", "2021-01-01"] == pytest.approx(5.0)
    assert first["B", "2021-01-20"] == pytest.approx((100 + 2 * 24) / (100 + 2 * 19) * 100 - 100) and first["A", "2021-02-01"] is None
    assert part("2021-02") == young  # months without a due row are not rewritten
    changed = daily.withColumn("close", F.col("close") * 2)
    assert log_store.fill_forward_returns(path, changed, today) == 1  # filled rows stay, although prices are others now
    second = logged(spark, path)
    assert {k: v for k, v in second.items() if k[1] < "2021-02"} == {k: v for k, v in first.items() if k[1] < "2021-02"}
    assert second["A", "2021-02-01"] is not None and second["A", "2021-02-10"] is None  # six days old
    assert log_store.fill_forward_returns(path, changed, today) == 0 and logged(spark, path) == second


def test_cache_is_json(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = spark.createDataFrame([("A", "BUY", 0.5, 0.6, None, "liquid")], log_store.CACHED)
    for _ in range(2):
        log_store.write_cache(rows, path)
    assert [tuple(r) for r in log_store.read_cache(spark, path).collect()] == [("A", "BUY", 0.5, 0.6, None, "liquid")]
    assert '"win_rate":null' in "".join(p.read_text() for p in (tmp_path / "cache").glob("part-*"))
    assert shared_dir(spark).startswith("file://")
