"""Volatility that clusters: GARCH(1,1) and GJR with Student's t, fitted to all symbols at once, and paths drawn from the fits.

A symbol's returns are kept as arrays of CHUNK. The variance is linear in the variance before, so a chunk is first folded
from nothing, then the chunks' ends are chained, and only then is each chunk's likelihood summed from its true start: no row holds a
history, only arrays of CHUNK and one number per chunk. Chunks are folded in Arrow batches, all rows of a batch step by step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import back, clip, log_of, portable_int, portable_normal
from ..functions.store import stored

CHUNK = 256
#: What is searched: mean and (as a logarithm) long-run variance in units of the sample, persistence and the share of shocks
#: in it as log odds, freedom beyond two as a logarithm, share of falls in the shocks, cut to 0 and 1.
PARTS = ("m", "s", "p", "a", "f", "l")
START = {"m": (0.0, 0.1), "s": (0.0, 0.5), "p": (2.0, 1.5), "a": (-1.5, 1.2), "f": (1.6, 1.0), "l": (0.3, 0.4)}
CANDIDATES, BEST, ROUNDS = 96, 16, 30
LEAST_RETURNS = 30


def log_returns(df: DataFrame) -> DataFrame:
    """symbol, ts, r: log returns in percent."""
    return df.select("symbol", "ts", ((log_of("close") - back(log_of("close"))) * 100).alias("r")).where("r IS NOT NULL")


def chunks(rets: DataFrame) -> DataFrame:
    """symbol, chunk, r (array), n, mean, var: the returns of each symbol with LEAST_RETURNS that are not all equal."""
    order = Window.partitionBy("symbol").orderBy("ts")
    stats = rets.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.var_pop("r").alias("var")).where(f"n >= {LEAST_RETURNS} AND var > 0")
    placed = rets.withColumn("i", F.row_number().over(order) - 1).withColumn("chunk", F.floor(F.col("i") / CHUNK))
    packed = placed.groupBy("symbol", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("r"))
    return packed.join(stats, "symbol")


def _odds(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def meaning(rows: DataFrame) -> DataFrame:
    """mu, omega, alpha, gamma, beta, nu of the searched numbers, given mean and var of the returns and gjr. Persistence stays
    under one (alpha + beta + gamma / 2), nu above 2.05."""
    persistence = 0.9999 * _odds(F.col("p"))
    shocks = persistence * _odds(F.col("a"))
    falls = F.when(F.col("gjr"), clip(F.col("l"), 0, 1)).otherwise(0.0)
    return rows.withColumns({
        "mu": F.col("mean") + F.col("m") * F.sqrt("var"), "omega": F.col("var") * F.exp(F.least(F.col("s"), F.lit(10.0))) * (1 - persistence), "alpha": shocks * (1 - falls),
        "gamma": 2 * shocks * falls, "beta": persistence - shocks, "nu": 2.05 + F.exp(F.least(F.col("f"), F.lit(6.0))),
    })


def _next(v: Column, r: Column) -> Column:
    """The variance after a return, given that before it."""
    e = r - F.col("mu")
    return F.col("omega") + (F.col("alpha") + F.when(e < 0, F.col("gamma")).otherwise(0.0)) * e * e + F.col("beta") * v


def _log_gamma(x: Column) -> Column:
    """By Stirling's series at x + 8, within 1e-12 for x > 0."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return series - sum((F.ln(x + i) for i in range(8)), F.lit(0.0))


@F.pandas_udf(T.StructType([T.StructField("v", T.DoubleType()), T.StructField("ll", T.DoubleType())]))  # no text: modules are imported before a session exists
def _folded(r: pd.Series, start: pd.Series, mu: pd.Series, omega: pd.Series, alpha: pd.Series, gamma: pd.Series, beta: pd.Series, nu: pd.Series) -> pd.DataFrame:
    """The variance after each chunk from the one at its start, and the part of its log likelihood that depends on returns."""
    size = r.map(len).to_numpy()
    wide = np.zeros((int(size.max(initial=0)), len(r)))
    for i, x in enumerate(r):
        wide[: len(x), i] = x
    mu, omega, alpha, gamma, beta, nu = (c.to_numpy() for c in (mu, omega, alpha, gamma, beta, nu))
    v, ll = start.to_numpy().copy(), np.zeros(len(r))
    with np.errstate(all="ignore"):  # what cannot be compared is ranked last
        for t, x in enumerate(wide):
            e = x - mu
            inside = t < size
            ll += np.where(inside, -0.5 * np.log(v) - (nu + 1) / 2 * np.log1p(e * e / (v * (nu - 2))), 0.0)
            v = np.where(inside, omega + (alpha + gamma * (e < 0)) * e * e + beta * v, v)
    return pd.DataFrame({"v": v, "ll": ll})


def likelihoods(packed: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """by, loglik, last_var (the variance of the return to come) of candidates(by, mu, omega, alpha, gamma, beta, nu). The first variance is
    that of the sample."""
    # Few bytes, much work: a number of partitions that is not coalesced.
    at = packed.join(candidates, [c for c in by if c in packed.columns]).repartition(packed.sparkSession.sparkContext.defaultParallelism, *by)
    parts = ("mu", "omega", "alpha", "gamma", "beta", "nu")
    own = at.withColumn("_end", _folded("r", F.lit(0.0), *parts)["v"]).withColumn("_decay", F.pow("beta", F.size("r").cast("double")))
    ends = own.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk", "_end", "_decay"))).alias("_ends"), F.first("var").alias("_var"))
    chained = F.aggregate("_ends", F.array("_var"), lambda seen, x: F.array_append(seen, x["_end"] + x["_decay"] * F.element_at(seen, -1)))
    starts = ends.select(*by, F.posexplode(chained).alias("chunk", "_start")).withColumn("chunk", F.col("chunk").cast("long"))
    last = starts.groupBy(*by).agg(F.max_by("_start", "chunk").alias("last_var"))
    summed = at.join(starts, [*by, "chunk"]).withColumn("_ll", _folded("r", "_start", *parts)["ll"])
    fixed = _log_gamma((F.col("nu") + 1) / 2) - _log_gamma(F.col("nu") / 2) - 0.5 * F.ln(math.pi * (F.col("nu") - 2))
    out = summed.groupBy(*by).agg((F.sum("_ll") + F.first("n") * F.first(fixed)).alias("loglik"))
    return out.join(last, by)


def fit_garch(df: DataFrame, gjr: tuple[bool, ...] = (False, True), candidates: int = CANDIDATES, best: int = BEST, rounds: int = ROUNDS) -> DataFrame:
    """symbol, gjr, n, mu, omega, alpha, gamma, beta, nu, loglik, last_var, in percent, of the most likely model found.

    Each round draws candidates around the mean of the round before, in all symbols and models at once, and keeps the best for the
    next mean and spread; the draws are numbered, so results do not depend on partitions. Symbols with fewer than LEAST_RETURNS returns, or equal
    ones only, have no row. Every round is written.
    """
    packed = stored(chunks(log_returns(df)), "garch-chunks")
    keys = packed.groupBy("symbol").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("var").alias("var"))
    keys = keys.select("*", F.explode(F.array(*map(F.lit, gjr))).alias("gjr"))
    state = keys.select("*", *(F.lit(v).alias(f"{c}_{part}") for c, (at, spread) in START.items() for part, v in (("at", at), ("by", spread), ("top", at))))
    state = stored(state.withColumn("loglik", F.lit(-1e300)), "garch")
    by = ["symbol", "gjr", "nth"]
    for number in range(rounds):
        drawn = state.select("*", F.explode(F.sequence(F.lit(0), F.lit(candidates))).alias("nth"))  # the last one is the best so far
        place = (F.lit(number) * (candidates + 1) + F.col("nth")) * len(PARTS)
        near = {c: F.when(F.col("nth") == candidates, F.col(f"{c}_top")).otherwise(F.col(f"{c}_at") + F.col(f"{c}_by") * portable_normal(place + j + 1)) for j, c in enumerate(PARTS)}
        drawn = stored(meaning(drawn.withColumns(near)).drop("loglik"), "garch-drawn")
        given = drawn.select(*by, "mu", "omega", "alpha", "gamma", "beta", "nu")
        made = drawn.join(likelihoods(packed, given, by).drop("last_var"), by).withColumn("loglik", F.coalesce(F.nanvl("loglik", F.lit(None).cast("double")), F.lit(-1e300)))
        rank = F.row_number().over(Window.partitionBy("symbol", "gjr").orderBy(F.desc("loglik"), "nth"))  # as many rows as candidates
        kept = made.withColumn("_rank", rank).where(F.col("_rank") <= best)
        first = lambda c: F.max(F.when(F.col("_rank") == 1, F.col(c)))
        moved = [(F.avg(c)).alias(f"{c}_at") for c in PARTS]
        spread = [(0.8 * F.stddev_pop(c) + 0.2 * F.first(f"{c}_by")).alias(f"{c}_by") for c in PARTS]
        state = stored(kept.groupBy("symbol", "gjr").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("var").alias("var"), *moved, *spread, *(first(c).alias(f"{c}_top") for c in PARTS), first("loglik").alias("loglik")), "garch")
    top = meaning(state.drop("loglik").withColumnsRenamed({f"{c}_top": c for c in PARTS}))
    top = top.select("symbol", "gjr", "n", "mu", "omega", "alpha", "gamma", "beta", "nu")
    return stored(top.join(likelihoods(packed, top.drop("n"), ["symbol", "gjr"]), ["symbol", "gjr"]), "garch")


def garch_paths(df: DataFrame, fits: DataFrame, n_days: int = 30, n_sims: int = 2000) -> DataFrame:
    """symbol, gjr, sim, day, s0, price from the last close of each fitted symbol. Draws of Student's t are exact for any freedom
    (a radius from one number, an angle from another) and numbered. A path is folded within its row."""
    ends = df.groupBy("symbol").agg(F.max_by("close", "ts").alias("s0"))
    order = fits.select("symbol").distinct().withColumn("_k", F.row_number().over(Window.orderBy("symbol")) - 1)  # one row per symbol
    sims = fits.join(ends, "symbol").join(order, "symbol").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))).alias("sim"))
    even = lambda i: (portable_int(i) + 0.5) / 2147483647.0

    def draw(day: Column) -> Column:
        place = ((F.col("_k") * n_sims + F.col("sim")) * n_days + day) * 2
        t = F.sqrt(F.col("nu") * (F.pow(even(place), -2 / F.col("nu")) - 1)) * F.cos(2 * math.pi * even(place + 1))
        return t * F.sqrt((F.col("nu") - 2) / F.col("nu"))

    zero = F.struct(F.col("last_var").alias("v"), F.lit(0.0).alias("walk"), F.array().cast("array<double>").alias("walks"))

    def step(s: Column, z: Column) -> Column:
        r = F.col("mu") + F.sqrt(s["v"]) * z
        walk = s["walk"] + r / 100
        return F.struct(_next(s["v"], r).alias("v"), walk.alias("walk"), F.array_append(s["walks"], walk).alias("walks"))

    drawn = sims.withColumn("_z", F.transform(F.sequence(F.lit(1), F.lit(n_days)), draw))
    walks = drawn.select("symbol", "gjr", "sim", "s0", F.posexplode(F.aggregate("_z", zero, step)["walks"]).alias("day", "walk"))
    return walks.select("symbol", "gjr", "sim", (F.col("day") + 1).alias("day"), "s0", (F.col("s0") * F.exp("walk")).alias("price"))
