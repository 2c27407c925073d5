"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """node, component for every node of links(a, b): component is the smallest node reachable. Each round is written
    to the shared folder, so a lost executor costs one round. The rounds needed grow with the logarithm of the paths' lengths."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        lower = stored(lower, "lower")
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = stored(lower.join(jump, "to", "left").select("node", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("was")).alias("moved")), "labels")
        labels = after.select("node", "component")
        if after.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"labels still moved after {MAX_ROUNDS} rounds")
