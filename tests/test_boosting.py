"""Boosted trees against a plain loop; folds that know earlier outcomes only."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import boosting


def plain_boost(x, y, teaches, n_trees, depth, rate, bins, squared=False):
    """The same trees by loops over nodes, features and bins."""
    n, k = x.shape
    b = np.empty((n, k), int)
    for j in range(k):
        cuts = np.unique(np.quantile(x[teaches, j], [i / bins for i in range(1, bins)], method="inverted_cdf"))
        b[:, j] = [(cuts < v).sum() for v in x[:, j]]
    m = y[teaches].mean()
    score = np.full(n, m if squared else np.log(m / (1 - m)))
    worth = lambda g, h: g * g / (h + 1)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (score - y, np.ones(n)) if squared else (p - y, p * (1 - p))
        node = np.ones(n, int)
        for _ in range(depth):
            after = node.copy()
            for v in set(node[teaches]):
                rows = teaches & (node == v)
                best = None
                for j in range(k):
                    for c in sorted(set(b[rows, j]))[:-1]:
                        left, right = rows & (b[:, j] <= c), rows & (b[:, j] > c)
                        if min(left.sum(), right.sum()) < 10 or min(h[left].sum(), h[right].sum()) < 1e-3:
                            continue
                        gain = round(worth(g[left].sum(), h[left].sum()) + worth(g[right].sum(), h[right].sum()) - worth(g[rows].sum(), h[rows].sum()), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, j, c
                if best:
                    mine = node == v
                    after[mine] = 2 * v + (b[mine, best[1]] > best[2])
            node = after
        for v in set(node[teaches]):
            rows = teaches & (node == v)
            score[node == v] -= rate * g[rows].sum() / (h[rows].sum() + 1)
    return score


def table(spark, groups):
    rows = [(s, i, *map(float, x[i]), float(y[i]), bool(t[i])) for s, (x, y, t) in groups.items() for i in range(len(y))]
    return spark.createDataFrame(rows, "symbol string, i int, a double, b double, c double, y double, teaches boolean").repartition(3)


def sample(seed, n=160):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)  # ties
    y = ((x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + rng.normal(0, 0.4, n)) > 0).astype(float)
    return x, y, np.arange(n) < n - 30


@pytest.mark.parametrize("squared", [False, True])
def test_trees_equal_a_plain_loop(spark, squared):
    groups = {"A": sample(1), "B": sample(2)}
    scored, made = boosting.boost(table(spark, groups), ("symbol",), ("a", "b", "c"), "y", "teaches", n_trees=3, depth=2, rate=0.3, bins=8, squared=squared)
    got = {(r.symbol, r.i): r.score for r in scored.collect()}
    for s, (x, y, t) in groups.items():
        want = plain_boost(x, y, t, 3, 2, 0.3, 8, squared)
        assert [got[s, i] for i in range(len(y))] == pytest.approx(want, abs=1e-9)
    assert {r.tree for r in made.collect()} == {0, 1, 2}


def walk(spark, n=150, cut=None, seed=5):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    feats = rng.normal(size=(n, 2))
    if cut is not None:  # another future
        close[cut:] *= np.exp(np.cumsum(rng.normal(0.3, 0.5, n - cut)))
    rows = [("S", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(close[i]), *(None if i < 3 else float(v) for v in feats[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double, a double, b double")


def test_folds_learn_from_known_outcomes_only(spark):
    rows = boosting.walk_forward_rows(walk(spark), ("a", "b"), min_train=60, retrain_every=25, horizon=5).collect()
    predicted = [r for r in rows if not r.teaches]
    assert sorted(r.n for r in predicted) == list(range(60, 150))
    for r in predicted:
        learnt = [q.n for q in rows if q.teaches and q.fold == r.fold]
        begins = min(q.n for q in predicted if q.fold == r.fold)
        assert learnt and min(learnt) == 3
        assert max(learnt) == (144 if r.tail else begins - 5 - 1)
    assert sorted(r.n for r in predicted if r.tail) == list(range(145, 150))


def test_predictions_do_not_depend_on_the_future(spark):
    run = lambda df: {r.n: r.prob for r in boosting.walk_forward_classifier(df, ("a", "b"), 60, 40, 5, n_trees=2, depth=2, bins=8).collect()}
    one, other = run(walk(spark)), run(walk(spark, cut=120))
    assert all(one[n] == other[n] for n in range(60, 120 - 5))
    assert sorted(one) == list(range(60, 150)) and all(0 < p < 1 for p in one.values())


def test_calibration_is_monotone_and_judged_on_the_second_half(spark):
    rows = boosting.walk_forward_classifier(walk(spark), ("a", "b"), 60, 40, 5, n_trees=2, depth=2, bins=8).orderBy("prob").collect()
    values = [r.calibrated for r in rows]
    assert all(x <= y + 1e-12 for x, y in zip(values, values[1:]))
    judged, known = sorted(r.n for r in rows if r.judged), sorted(r.n for r in rows if not r.tail)
    assert judged == known[len(known) // 2 :] and all(r.target is None for r in rows if r.tail)


def test_short_or_one_sided_histories_have_no_rows(spark):
    assert boosting.walk_forward_classifier(walk(spark, 40), ("a", "b"), 60, 40, 5, n_trees=1, depth=1).count() == 0
    rising = walk(spark).withColumn("close", F.unix_timestamp("ts").cast("double"))
    assert boosting.walk_forward_classifier(rising, ("a", "b"), 60, 40, 5, n_trees=1, depth=1).count() == 0
    assert boosting.walk_forward_classifier(walk(spark).limit(0), ("a", "b"), 60, 40, 5, n_trees=1, depth=1).count() == 0


def test_returns_and_importances(spark):
    df = walk(spark).withColumn("b", F.lead("close", 5).over(boosting.Window.partitionBy("symbol").orderBy("ts")) / F.col("close") - 1)
    df = df.withColumn("b", F.coalesce("b", F.lit(0.0)))
    rows = boosting.expected_return(df, ("a", "b"), 5, n_trees=5, depth=2, rate=0.3, bins=8).collect()
    assert len(rows) == 5 and all(abs(r.expected) < 0.5 for r in rows)
    gains = {r.feature: r.gain for r in boosting.importance(df, ("a", "b"), 5, n_trees=3, depth=2, bins=8).collect()}
    assert gains["b"] > 5 * gains.get("a", 0.0)
