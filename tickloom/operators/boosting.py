"""Gradient-boosted trees of many groups at once, and a walk-forward classifier on top.

A level of a tree is one aggregate over all rows of all groups (symbols, folds): gradients summed by node, feature and bin
combine before the shuffle; the best split of every node is found by a window over at most `bins` rows. Rows to be predicted
travel along with those that teach, without weight, so that no tree is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import stored
from .regression import apply_isotonic, fit_isotonic, logistic

#: Quantiles come from sketches of this accuracy: exact for groups below about half as many rows.
ACCURACY = 10_000
#: Penalty on a leaf's value, and the least sum of second derivatives and rows on either side of a split.
PENALTY, LEAST_CURVATURE, LEAST_ROWS = 1.0, 1e-3, 10


def binned(rows: DataFrame, by: Sequence[str], features: Sequence[str], teaches: str, bins: int = 32) -> DataFrame:
    """rows with _bins: for each feature the number of its group's cuts below it; cuts are quantiles of the rows that teach."""
    at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    cuts = rows.where(F.col(teaches)).groupBy(*by).agg(*(F.array_distinct(F.percentile_approx(f, at, ACCURACY)).alias(f"_cut_{f}") for f in features))
    below = lambda f: F.size(F.filter(F.col(f"_cut_{f}"), lambda cut: cut < F.col(f)))
    return rows.join(cuts, list(by)).withColumn("_bins", F.array(*(below(f) for f in features))).drop(*(f"_cut_{f}" for f in features))


def _worth(g: Column, h: Column) -> Column:
    return g * g / (h + PENALTY)


def _best_splits(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, _node, _split(feature, bin), gain: the best split of each node that has one. Ties go to the first feature and bin."""
    sums = rows.where("_teaches").select(*by, "_node", "_g", "_h", F.posexplode("_bins").alias("feature", "bin"))
    sums = sums.groupBy(*by, "_node", "feature", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(*by, "_node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(*by, "_node", "feature", "bin", *(F.sum(c).over(w).alias(f"{c}{s}") for c in "ghn" for w, s in ((upto, "_left"), (of, "_all"))))
    right = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ghn"}
    gain = _worth(F.col("g_left"), F.col("h_left")) + _worth(right["g"], right["h"]) - _worth(F.col("g_all"), F.col("h_all"))
    sums = sums.withColumn("gain", F.round(gain, 9)).where("gain > 0").where(F.least("n_left", right["n"]) >= LEAST_ROWS).where(F.least("h_left", right["h"]) >= LEAST_CURVATURE)
    first = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    return sums.groupBy(*by, "_node").agg(F.max_by(F.struct("feature", "bin"), first).alias("_split"), F.max("gain").alias("gain"))


def boost(rows: DataFrame, by: Sequence[str], features: Sequence[str], label: str, teaches: str, n_trees: int = 150, depth: int = 4, rate: float = 0.05, bins: int = 32, squared: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows with score, and the splits made (by, tree, feature, gain).

    Trees of each group learn from its rows where teaches holds and score all of them: log odds of the label, or, if squared, its
    value. Rows with a null feature, and teaching rows with a null label, are left out, as are groups without a teaching row. Every tree is
    written, so a lost executor costs one tree.
    """
    by, keep = list(by), rows.columns
    rows = rows.withColumns({"_teaches": F.coalesce(F.col(teaches), F.lit(False)), "_y": F.col(label).cast("double")}).na.drop(subset=list(features)).where("NOT _teaches OR _y IS NOT NULL")
    mean = rows.where("_teaches").groupBy(*by).agg(F.avg("_y").alias("_mean"))
    near = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_mean")))
    start = F.col("_mean") if squared else F.ln(near / (1 - near))
    rows = binned(rows, by, features, "_teaches", bins).join(mean, by).withColumn("score", start).select(*keep, "_teaches", "_y", "_bins", "score")
    rows, made = stored(rows, "boost"), []
    for tree in range(n_trees):
        p = logistic(F.col("score"))
        g, h = (F.col("score") - F.col("_y"), F.lit(1.0)) if squared else (p - F.col("_y"), p * (1 - p))
        at = rows.withColumns({"_g": g, "_h": h, "_node": F.lit(1)})
        for _ in range(depth):
            splits = stored(_best_splits(at, by), "splits")
            made.append(splits.select(*by, F.lit(tree).alias("tree"), "_split.feature", "gain"))
            goes_left = F.get("_bins", F.col("_split.feature")) <= F.col("_split.bin")
            node = F.when(F.col("_split").isNull(), F.col("_node")).otherwise(F.col("_node") * 2 + F.when(goes_left, 0).otherwise(1))
            at = at.join(splits.drop("gain"), [*by, "_node"], "left").withColumn("_node", node).drop("_split")
        leaves = at.where("_teaches").groupBy(*by, "_node").agg((-rate * F.sum("_g") / (F.sum("_h") + PENALTY)).alias("_value"))
        after = at.join(leaves, [*by, "_node"], "left").withColumn("score", F.col("score") + F.coalesce("_value", F.lit(0.0)))
        rows = stored(after.select(*keep, "_teaches", "_y", "_bins", "score"), "boost")
    empty = rows.select(*by, F.lit(0).alias("tree"), F.lit(0).alias("feature"), F.lit(0.0).alias("gain")).limit(0)
    for part in made:
        empty = empty.unionByName(part)
    return rows.select(*keep, "score"), empty


def walk_forward_rows(df: DataFrame, features: Sequence[str], min_train: int = 100, retrain_every: int = 20, horizon: int = 1, min_rows: int = 30) -> DataFrame:
    """symbol, ts, n, fold, teaches, tail, target, fwd and features: each bar once for each fold that learns from it or predicts it.

    A symbol's first fold begins at the first bar from min_train on by which min_rows complete bars with both outcomes are known;
    others follow every retrain_every bars. A fold that begins at bar i learns from bars before i - horizon, whose outcome was known by
    then, and predicts those until the next fold. The last fold learns from every bar with an outcome and predicts the
    horizon bars without one (tail). Bars with a null feature neither teach nor are predicted.
    """
    order = Window.partitionBy("symbol").orderBy("ts")
    of = Window.partitionBy("symbol")
    fwd = F.lead("close", horizon).over(order) / F.nullif(F.col("close").cast("double"), F.lit(0.0)) - 1
    rows = df.select("symbol", "ts", *(F.col(f).cast("double").alias(f) for f in features), fwd.alias("fwd"), (F.row_number().over(order) - 1).alias("n"), F.count(F.lit(1)).over(of).alias("_all"))
    rows = rows.withColumn("target", (F.col("fwd") > 0).cast("double"))
    whole = F.array_position(F.array(*(F.col(f).isNull() for f in features)), True) == 0
    outcome = F.when(whole, F.col("target"))
    known = order.rowsBetween(Window.unboundedPreceding, -(horizon + 1))
    ready = (F.col("n") >= min_train) & (F.count(outcome).over(known) >= min_rows) & (F.min(outcome).over(known) < F.max(outcome).over(known))
    labelled = F.col("_all") - horizon
    rows = rows.withColumn("_ready", F.when(ready & (F.col("n") < labelled), F.col("n"))).withColumn("_first", F.min("_ready").over(of)).where(whole)
    rows = rows.where("_first IS NOT NULL").withColumn("_folds", F.ceil((labelled - F.col("_first")) / retrain_every).cast("int"))
    teach_from = F.greatest(F.lit(0), F.ceil((F.col("n") + horizon + 1 - F.col("_first")) / retrain_every)).cast("int")
    teaching = F.when(F.col("n") < labelled, F.transform(F.sequence(F.least(teach_from, F.col("_folds")), F.col("_folds")), lambda f: F.struct(f.alias("fold"), F.lit(True).alias("teaches"))))
    own = F.when(F.col("n") >= labelled, F.col("_folds")).when(F.col("n") >= F.col("_first"), F.floor((F.col("n") - F.col("_first")) / retrain_every).cast("int"))
    predicted = F.when(own.isNotNull() & (F.col("n") >= min_train), F.array(F.struct(own.alias("fold"), F.lit(False).alias("teaches"))))
    none = F.array().cast("array<struct<fold:int,teaches:boolean>>")
    uses = F.concat(F.coalesce(teaching, none), F.coalesce(predicted, none))
    return rows.select("symbol", "ts", "n", "target", "fwd", *features, (F.col("n") >= labelled).alias("tail"), F.inline(uses))


def walk_forward_classifier(df: DataFrame, features: Sequence[str], min_train: int = 100, retrain_every: int = 20, horizon: int = 1, n_trees: int = 150, depth: int = 4, rate: float = 0.05, bins: int = 32) -> DataFrame:
    """symbol, ts, n, fold, tail, target, prob, score, calibrated, judged of each predicted bar.

    prob: chance of a higher close after horizon bars by trees that knew earlier outcomes only; score: 2 * prob - 1. Where 50 predictions
    or more have outcomes of both kinds, steps of isotonic calibration are fitted to the first half of them; calibrated is the
    value after them, judged marks the second half, which the steps have not seen. Target is null in the tail.
    """
    rows = stored(walk_forward_rows(df, features, min_train, retrain_every, horizon), "walk-forward")
    scored, _ = boost(rows, ("symbol", "fold"), features, "target", "teaches", n_trees, depth, rate, bins)
    made = scored.where("NOT teaches").select("symbol", "ts", "n", "fold", "tail", F.when(~F.col("tail"), F.col("target")).alias("target"), logistic(F.col("score")).alias("prob"))
    of = Window.partitionBy("symbol")
    outcomes = {"_known": F.count("target").over(of), "_nth": F.sum(F.col("target").isNotNull().cast("long")).over(of.orderBy("n")), "_both": F.min("target").over(of) < F.max("target").over(of)}
    made = stored(made.withColumns(outcomes), "predicted")
    enough = (F.col("_known") >= 50) & F.col("_both")
    first = F.col("_nth") <= F.floor(F.col("_known") / 2)
    steps = fit_isotonic(made.where(enough & first & ~F.col("tail")), ("symbol",), "prob", "target")
    made = apply_isotonic(made, steps, ("symbol",), "prob", "calibrated")
    return made.select("symbol", "ts", "n", "fold", "tail", "target", "prob", (2 * F.col("prob") - 1).alias("score"), "calibrated", (enough & ~first & ~F.col("tail")).alias("judged"))


def expected_return(df: DataFrame, features: Sequence[str], horizon: int = 1, min_rows: int = 30, n_trees: int = 150, depth: int = 4, rate: float = 0.05, bins: int = 32) -> DataFrame:
    """symbol, ts, expected: the return after horizon bars that trees expect at each symbol's last horizon bars, from all known."""
    rows = walk_forward_rows(df, features, 0, 1_000_000_000, horizon, min_rows).where("tail OR fold > 0").withColumn("fold", F.lit(0))
    scored, _ = boost(rows, ("symbol",), features, "fwd", "teaches", n_trees, depth, rate, bins, squared=True)
    return scored.where("NOT teaches").select("symbol", "ts", F.col("score").alias("expected"))


def importance(df: DataFrame, features: Sequence[str], horizon: int = 1, **trees) -> DataFrame:
    """symbol, feature, splits, gain: what the trees that know all outcomes of a symbol split by."""
    rows = walk_forward_rows(df, features, 0, 1_000_000_000, horizon).where("teaches AND fold > 0")
    _, made = boost(rows, ("symbol",), features, "target", "teaches", **trees)
    named = F.get(F.array(*map(F.lit, features)), F.col("feature"))
    return made.groupBy("symbol", named.alias("feature")).agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
