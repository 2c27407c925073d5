"""Hierarchical risk parity without a matrix in one place: correlations by tiles, the single-linkage tree as a minimum spanning
tree grown by all clusters at once, and variances of all halves of all levels as two aggregates over return rows.

Only the order of the leaves is made in one task, from the tree: one row per symbol.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import stored
from .weights import standardised

#: Symbols of a tile's side; a task holds two sides of their returns and one tile.
TILE = 256


def correlations(z: DataFrame) -> DataFrame:
    """a, b, corr of every pair a < b of standardised(symbol, ts, z): one product of two blocks of TILE series per tile."""
    series = z.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ts", "z")))["z"].alias("z"))
    nth = F.row_number().over(Window.orderBy("symbol")) - 1  # one row per symbol
    series = stored(series.select("symbol").withColumn("block", F.floor(nth / TILE).cast("int")).join(series, "symbol"), "series")
    last = series.agg(F.max("block")).first()[0] or 0
    rows = series.select(F.col("symbol").alias("a"), F.col("z").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(last))).alias("j"))
    columns = series.select(F.col("symbol").alias("b"), F.col("z").alias("y"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(left["x"].to_list()), np.stack(right["y"].to_list())
        product = x @ y.T / (x.shape[1] - 1)
        a, b = left["a"].to_numpy(), right["b"].to_numpy()
        i, j = np.nonzero(a[:, None] < b[None, :])
        return pd.DataFrame({"a": a[i], "b": b[j], "corr": product[i, j]})

    return rows.groupBy("i", "j").cogroup(columns.groupBy("i", "j")).applyInPandas(tile, "a string, b string, corr double")


def spanning_tree(edges: DataFrame) -> DataFrame:
    """The edges (a, b, d) of the minimum spanning forest; ties go to the lesser (a, b). A round adds the least edge that leaves each
    cluster, and clusters that are joined take one name by pointer doubling; clusters at least halve with each round."""
    edges = stored(edges, "edges")
    tree = edges.limit(0)
    names = edges.select(F.col("a").alias("symbol")).union(edges.select("b")).distinct().withColumn("cluster", F.col("symbol"))
    while True:
        side = lambda s: names.select(F.col("symbol").alias(s), F.col("cluster").alias(f"of_{s}"))  # noqa: E731, B023
        open_ = stored(edges.join(side("a"), "a").join(side("b"), "b").where("of_a <> of_b").select("a", "b", "d", "of_a", "of_b"), "open-edges")
        ends = open_.select("d", "a", "b", F.inline(F.array(F.struct(F.col("of_a").alias("cluster"), F.col("of_b").alias("to")), F.struct(F.col("of_b").alias("cluster"), F.col("of_a").alias("to")))))
        least = stored(ends.groupBy("cluster").agg(F.min(F.struct("d", "a", "b", "to")).alias("e")), "least-edges")
        if least.isEmpty():
            return tree
        tree = stored(tree.unionByName(least.select("e.a", "e.b", "e.d").distinct()), "tree")
        points = least.select("cluster", F.col("e.to").alias("to"))
        back = points.select(F.col("cluster").alias("to"), F.col("to").alias("on"))
        # Two clusters with the same least edge point at each other: the lesser name is their root.
        root = (F.col("on") == F.col("cluster")) & (F.col("cluster") < F.col("to"))
        points = stored(points.join(back, "to").select("cluster", F.when(root, F.col("cluster")).otherwise(F.col("to")).alias("to")), "points")
        while True:
            back = points.select(F.col("cluster").alias("to"), F.col("to").alias("on"))
            further = stored(points.join(back, "to").select("cluster", F.col("on").alias("to"), (F.col("on") != F.col("to")).alias("moved")), "points")
            points = further.select("cluster", "to")
            if further.where("moved").isEmpty():
                break
        names = stored(names.join(points, "cluster").select("symbol", F.col("to").alias("cluster")), "clusters")
        edges = open_.select("a", "b", "d")


def _places(tree: pd.DataFrame) -> pd.DataFrame:
    """symbol, place in the order of the single-linkage tree: edges join clusters by rising distance, the older cluster to the left."""
    symbols = sorted({*tree["a"], *tree["b"]})
    age = {s: i for i, s in enumerate(symbols)}  # of a cluster, by its first leaf; single symbols are the oldest
    first, last, follows = {s: s for s in symbols}, {s: s for s in symbols}, {}

    def head(s: str) -> str:
        while first[s] != s:
            first[s] = first[first[s]]
            s = first[s]
        return s

    for n, (a, b) in enumerate(tree.sort_values(["d", "a", "b"])[["a", "b"]].itertuples(index=False)):
        left, right = sorted((head(a), head(b)), key=age.get)
        follows[last[left]], last[left], first[right], age[left] = right, last[right], left, len(symbols) + n
    at, order = head(symbols[0]), []
    while at is not None:
        order.append(at)
        at = follows.get(at)
    return pd.DataFrame({"symbol": order, "place": range(len(order))})


def parity_weights(df: DataFrame) -> DataFrame:
    """symbol, place (among the leaves), hrp: weights of hierarchical risk parity over the days that all symbols have, which add up to one.

    The leaves are halved down to single symbols; a half gets the share of its sibling's variance in that of both, each half held by
    inverse variances, and a weight is the product of its shares. The variance of such a half is that of its summed
    return rows, so no covariance is needed. Symbols without a deviation are left out; fewer than two common returns give no rows.
    """
    z = standardised(df)
    k = z.select("symbol").distinct().count()
    distance = F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("corr")) / 2))
    order = z.select("symbol").distinct().withColumn("place", F.lit(0))
    if k > 1:
        tree = spanning_tree(correlations(z).select("a", "b", distance.alias("d")))
        order = tree.groupBy().applyInPandas(_places, "symbol string, place int")
    # The halves that a leaf is in, from the whole down: (first, end) of the parent, and the first leaf of the half.
    halves = order.withColumns({"lo": F.lit(0), "hi": F.lit(k), "path": F.array().cast("array<struct<p_lo:int,p_hi:int,lo:int>>")})
    for _ in range(max(k - 1, 0).bit_length()):
        middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        split, right = F.col("hi") - F.col("lo") > 1, F.col("place") >= middle
        lo, hi = F.when(split & right, middle).otherwise(F.col("lo")), F.when(split & ~right, middle).otherwise(F.col("hi"))
        step = F.when(split, F.array_append("path", F.struct(F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), lo.alias("lo")))).otherwise(F.col("path"))
        halves = halves.select("symbol", "place", lo.alias("lo"), hi.alias("hi"), step.alias("path"))
    halves = stored(halves.select("symbol", "place", F.explode_outer("path").alias("half")).select("symbol", "place", "half.*"), "halves")
    node, both = ["p_lo", "p_hi", "lo"], Window.partitionBy("p_lo", "p_hi")
    inverse = z.groupBy("symbol").agg((1 / F.first("sd") / F.first("sd")).alias("w"))
    held = halves.where("lo IS NOT NULL").join(inverse, "symbol").withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*node)))
    days = z.select("symbol", "ts", (F.col("z") * F.col("sd")).alias("ret")).join(held, "symbol").groupBy(*node, "ts").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    shares = days.groupBy(*node).agg(F.var_samp("ret").alias("v")).withColumn("share", 1 - F.col("v") / F.sum("v").over(both)).select(*node, "share")
    return halves.join(shares, node, "left").groupBy("symbol").agg(F.first("place").alias("place"), F.product(F.coalesce("share", F.lit(1.0))).alias("hrp"))
