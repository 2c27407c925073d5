"""Portfolio weights and principal components without a matrix: products with the correlation matrix are two aggregates over
the rows of returns, one per day and one per symbol, so nothing grows with the square of the symbols.

What a round brings to the driver is a few sums: two for each system of equations, a square of BLOCK numbers for components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import stored
from .portfolio import common_days
from .stats import returns

#: Vectors that are turned together; components converge by the ratio of the eigenvalue behind the last of them.
BLOCK = 8
ROUNDS = 300


def standardised(df: DataFrame) -> DataFrame:
    """symbol, ts, z, mean, sd: returns on the days that all symbols have, less their mean and over their deviation. Symbols
    without a deviation are left out."""
    rets = returns(common_days(df))
    stats = rets.groupBy("symbol").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd")).where("sd > 0")
    return stored(rets.join(stats, "symbol").select("symbol", "ts", ((F.col("ret") - F.col("mean")) / F.col("sd")).alias("z"), "mean", "sd"), "standardised")


def _product(z: DataFrame, vectors: DataFrame, names: list[str], days: int) -> DataFrame:
    """symbol and, per vector, the correlation matrix times it."""
    by_day = z.join(vectors.select("symbol", *names), "symbol").groupBy("ts").agg(*(F.sum(F.col("z") * F.col(n)).alias(n) for n in names))
    return z.select("symbol", "ts", "z").join(by_day, "ts").groupBy("symbol").agg(*((F.sum(F.col("z") * F.col(n)) / (days - 1)).alias(f"R{n}") for n in names))


def closed_form_weights(df: DataFrame, risk_free: float = 0.0, trading_days: float = 252.0, tolerance: float = 1e-11) -> DataFrame:
    """symbol, equal, gmv, tangency: equal weights, those of least variance, and those of the best ratio of mean beyond risk_free
    (a year) to deviation, each adding up to one. Both systems are solved by conjugate gradients on the scale of
    correlations, in as many rounds as there are symbols at most, but for rounding. Weights are null where returns do not
    determine them; a tangency whose parts add up to nothing is the portfolio of least variance."""
    z = standardised(df)
    days, k = (z.agg(F.count_distinct("ts"), F.count_distinct("symbol")).first() if not z.isEmpty() else (0, 0))
    state = z.groupBy("symbol").agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    right = {"g": 1 / F.col("sd"), "t": (F.col("mean") - risk_free / trading_days) / F.col("sd")}
    state = stored(state.select("symbol", "sd", *(F.lit(0.0).alias(f"x{n}") for n in right), *(b.alias(f"{v}{n}") for n, b in right.items() for v in "rp")), "gradients")
    norms = state.agg(*(F.sum(F.col(f"r{n}") * F.col(f"r{n}")).alias(n) for n in right)).first()
    start = {n: norms[n] or 0.0 for n in right}
    left, failed = dict(start), {n: days < 2 for n in right}
    for _ in range(4 * k + 20):
        open_ = [n for n in right if not failed[n] and left[n] > tolerance**2 * start[n]]
        if not open_:
            break
        made = stored(state.join(_product(z, state, [f"p{n}" for n in open_], days), "symbol"), "gradients")
        curved = made.agg(*(F.sum(F.col(f"p{n}") * F.col(f"Rp{n}")).alias(n) for n in open_)).first()
        failed |= {n: True for n in open_ if curved[n] <= 1e-13 * left[n]}
        open_ = [n for n in open_ if not failed[n]]
        step = {n: left[n] / curved[n] for n in open_}
        made = made.withColumns({f"x{n}": F.col(f"x{n}") + step[n] * F.col(f"p{n}") for n in open_} | {f"r{n}": F.col(f"r{n}") - step[n] * F.col(f"Rp{n}") for n in open_})
        made = stored(made.select(*state.columns), "gradients")
        after = made.agg(F.count(F.lit(1)), *(F.sum(F.col(f"r{n}") * F.col(f"r{n}")).alias(n) for n in open_)).first()
        state = made.withColumns({f"p{n}": F.col(f"r{n}") + after[n] / left[n] * F.col(f"p{n}") for n in open_})
        left |= {n: after[n] for n in open_}
    solved = {n: not failed[n] and left[n] <= 1e-16 * start[n] for n in right}
    raw = {n: F.col(f"x{n}") / F.col("sd") for n in right}
    sums = state.agg(*(F.sum(raw[n]).alias(n) for n in right)).first()
    share = {n: raw[n] / sums[n] if solved[n] and sums[n] else F.lit(None).cast("double") for n in right}
    tangency = share["t"] if not (solved["t"] and abs(sums["t"] * trading_days) <= 1e-10) else share["g"]
    return state.select("symbol", (F.lit(1.0) / max(k, 1)).alias("equal"), share["g"].alias("gmv"), tangency.alias("tangency"))


def components(df: DataFrame, n: int = 3, tolerance: float = 1e-9) -> DataFrame:
    """symbol, component (from 1), loading, eigenvalue, explained_pct of the n leading components of the correlation matrix, by
    block power iteration. A loading's sign is that which makes a component's largest loading positive, the last by name of
    equals. Components beyond the number of symbols are left out."""
    z = standardised(df)
    empty = df.sparkSession.createDataFrame([], "symbol string, component int, loading double, eigenvalue double, explained_pct double")
    if z.isEmpty():
        return empty
    days, k = z.agg(F.count_distinct("ts"), F.count_distinct("symbol")).first()
    if days < 2:
        return empty
    m = min(BLOCK, k)
    names = [f"v{i}" for i in range(m)]
    # Starts that no permutation of the symbols favours: numbers from hashes of their names.
    state = z.select("symbol").distinct().select("symbol", *((F.pmod(F.xxhash64("symbol", F.lit(i)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(v) for i, v in enumerate(names)))

    def gram(rows: DataFrame, a: list[str], b: list[str]) -> np.ndarray:
        got = rows.agg(*(F.sum(F.col(x) * F.col(y)) for x in a for y in b)).first()
        return np.array(got, float).reshape(len(a), len(b))

    def turned(rows: DataFrame, columns: list[str], by: np.ndarray) -> dict:
        return {f"v{j}": sum((F.col(c) * float(by[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(by.shape[1])}

    values = None
    for _ in range(ROUNDS):
        root = np.linalg.cholesky(gram(state, names, names))
        state = stored(state.select("symbol", *(c.alias(v) for v, c in turned(state, names, np.linalg.inv(root).T).items())), "block")
        made = stored(state.join(_product(z, state, names, days), "symbol"), "block")
        pushed = [f"R{v}" for v in names]
        small = gram(made, names, pushed)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        ritz = stored(made.select("symbol", *(c.alias(v) for v, c in turned(made, names, vectors).items()), *(c.alias(f"R{v}") for v, c in turned(made, pushed, vectors).items())), "block")
        off = ritz.agg(*(F.sum(F.pow(F.col(f"R{v}") - float(values[i]) * F.col(v), 2)) for i, v in enumerate(names[:n]))).first()
        if max(off) <= tolerance**2:
            break
        state = ritz.select("symbol", *(F.col(f"R{v}").alias(v) for v in names))
    else:
        raise RuntimeError(f"components still turned after {ROUNDS} rounds")
    top = [F.struct(F.lit(i + 1).alias("component"), F.col(v).alias("loading"), F.lit(float(values[i])).alias("eigenvalue"), F.lit(float(values[i]) / k * 100).alias("explained_pct")) for i, v in enumerate(names[:n])]
    out = stored(ritz.select("symbol", F.inline(F.array(*top))), "components")
    lead = out.groupBy("component").agg(F.max_by(F.col("loading"), F.struct(F.round(F.abs("loading"), 9), F.col("symbol"))).alias("_lead"))
    return out.join(lead, "component").withColumn("loading", F.col("loading") * F.signum("_lead")).select("symbol", "component", "loading", "eigenvalue", "explained_pct")
