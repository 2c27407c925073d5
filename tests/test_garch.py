"""Likelihoods against a plain loop, fits against a search in NumPy, paths against their moments."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import garch


def simulated(n, seed, mu=0.05, omega=0.1, alpha=0.05, gamma=0.1, beta=0.85, nu=6.0):
    rng = np.random.default_rng(seed)
    v, out = omega / (1 - alpha - beta - gamma / 2), []
    for _ in range(n):
        e = math.sqrt(v) * rng.standard_t(nu) * math.sqrt((nu - 2) / nu)
        out.append(mu + e)
        v = omega + (alpha + gamma * (e < 0)) * e * e + beta * v
    return np.array(out)


def plain(r, mu, omega, alpha, gamma, beta, nu):
    v, total = r.var(), 0.0
    fixed = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    for x in r:
        e = x - mu
        total += fixed - 0.5 * math.log(v) - (nu + 1) / 2 * math.log(1 + e * e / (v * (nu - 2)))
        v = omega + (alpha + gamma * (e < 0)) * e * e + beta * v
    return total, v


def bars(spark, series):
    rows = []
    for s, r in series.items():
        close = 100 * np.exp(np.concatenate([[0], np.cumsum(r)]) / 100)
        rows += [(s, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(c)) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double").repartition(3)


@pytest.fixture(scope="module")
def series():
    return {"A": simulated(700, 1), "B": simulated(300, 2, gamma=0.0, nu=12.0)}


@pytest.fixture(scope="module")
def fits(spark, series):
    return garch.fit_garch(bars(spark, series), candidates=48, best=10, rounds=14)


def test_likelihoods_equal_a_plain_loop(spark, series):
    sets = [(0.05, 0.1, 0.05, 0.1, 0.85, 6.0), (0.0, 0.5, 0.3, 0.0, 0.0001, 2.5), (-0.1, 0.01, 0.02, 0.01, 0.97, 60.0)]
    given = spark.createDataFrame([(s, i, *p) for s in series for i, p in enumerate(sets)], "symbol string, nth int, mu double, omega double, alpha double, gamma double, beta double, nu double")
    rows = garch.likelihoods(garch.chunks(garch.log_returns(bars(spark, series))), given, ["symbol", "nth"]).collect()
    assert len(rows) == 6
    for r in rows:
        total, last = plain(series[r.symbol], *sets[r.nth])
        assert r.loglik == pytest.approx(total, abs=1e-6) and r.last_var == pytest.approx(last, rel=1e-9)


def test_fit_is_as_likely_as_a_search_in_numpy(fits, series):
    for r in fits.collect():
        start = np.array([0.05, 0.1, 0.08, 0.08 if r.gjr else 0.0, 0.84, 7.0])
        best, step = plain(series[r.symbol], *start)[0], np.array([0.05, 0.05, 0.05, 0.05, 0.05, 2.0])
        for _ in range(25):
            moved = False
            for j in range(6):
                for sign in (1, -1):
                    x = start.copy()
                    x[j] += sign * step[j]
                    if x[1] > 0 and min(x[2:5]) >= 0 and x[2] + x[4] + x[3] / 2 < 0.9999 and x[5] > 2.05 and (r.gjr or j != 3):
                        got = plain(series[r.symbol], *x)[0]
                        if got > best:
                            best, start, moved = got, x, True
            step = step if moved else step / 2
        assert r.loglik >= best - 0.05, (r, best)
        assert r.loglik == pytest.approx(plain(series[r.symbol], r.mu, r.omega, r.alpha, r.gamma, r.beta, r.nu)[0], abs=1e-6)


def test_falls_only_matter_where_asked(fits):
    rows = {(r.symbol, r.gjr): r for r in fits.collect()}
    assert all(r.gamma == 0 for (_, g), r in rows.items() if not g)
    assert rows["A", True].loglik > rows["A", False].loglik


def test_paths_have_the_variance_of_the_model(spark, series, fits):
    paths = garch.garch_paths(bars(spark, series), fits, n_days=5, n_sims=4000)
    first = paths.where("day = 1").withColumn("r", F.ln(F.col("price") / F.col("s0")) * 100)
    rows = first.groupBy("symbol", "gjr").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.percentile("r", F.lit(0.5)).alias("mid"), F.expr("percentile(abs(r), 0.5)").alias("mad")).collect()
    model = {(r.symbol, r.gjr): r for r in fits.collect()}
    for r in rows:
        fit = model[r.symbol, r.gjr]
        t = np.random.default_rng(0).standard_t(fit.nu, 400_000) * math.sqrt((fit.nu - 2) / fit.nu * fit.last_var)
        assert r.n == 4000 and r.mad == pytest.approx(np.median(abs(t + fit.mu)), rel=0.08)
        assert r.mid == pytest.approx(fit.mu, abs=4 * math.sqrt(fit.last_var / 4000))
    assert paths.count() == 4 * 5 * 4000


def test_short_flat_and_empty_histories_have_no_fit(spark, series):
    few = bars(spark, {"S": series["A"][:10], "F": np.zeros(60)})
    assert garch.fit_garch(few, candidates=4, best=2, rounds=1).count() == 0
    assert garch.fit_garch(few.limit(0), candidates=4, best=2, rounds=1).count() == 0
