"""Mixing sources to target weights.

Sizes are added up per source, shares of the mix are dealt by weight with a ceiling per source, and each document is
taken floor(rate) times plus once more with probability frac(rate), drawn from a hash of its id and a seed.

Defined results: a null text has size 0; documents without a source form one group, ordered last; a null id is drawn
like an empty one; equal ids get equal draws, so reruns agree; an empty table gives an empty mix. Other columns pass
through mix(), which emits each document as often as it is taken; an input column mix_copy gives way to the new one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, is_small, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"
#: Up to so many sources, each a name and a few numbers, are broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 2_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """source, source_size, target, rate from rows of source and size.

    The shares are the water level at which the ceilings max_repeats * source_size and level * weight add up to the
    wanted total: sources are put in order of ceiling per weight, and the level is set by the first that does not reach its own.
    The windows run over one row per source.
    """
    n = len(weights)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % n + 1).cast("int"))
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    return (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(filled), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(filled), F.lit(0)))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
        .select("source", "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"))
    )


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    """How often a document is taken: floor(rate), and once more if its draw in [0, 1) is below the fraction."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    draw = F.conv(digits, 16, 10).cast("long") / F.lit(float(16**12))
    return F.floor(rate).cast("long") + (draw < rate - F.floor(rate)).cast("long")


def _with_rates(rows: DataFrame, rates: DataFrame, source_col: str) -> DataFrame:
    """rows, and one more column: source_size, target and rate of their source."""
    key, found = free_name(rows, "mix_source"), free_name(rows, "mix_rates")
    rates = rates.select(F.col("source").alias(key), F.struct("source_size", "target", "rate").alias(found))
    side = F.broadcast(rates) if is_small(rates, BROADCAST_SOURCES) else rates
    return rows.join(side, rows[source_col].eqNullSafe(side[key]), "left").select(*(rows[c] for c in rows.columns), found)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs; texts are read once."""
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), "sizes")
    rates = stored(targets(sizes), "rates")
    out = _with_rates(sizes, rates, "source")
    return out.select("doc_id", "size", F.col("mix_rates.source_size").alias("source_size"), F.col("mix_rates.target").alias("target"), (F.col("size") * copies(F.col("doc_id"), F.col("mix_rates.rate"))).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its copy number in mix_copy (from 1)."""
    rates = stored(targets(docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))), "rates")
    out = _with_rates(docs, rates, source_col)
    taken = copies(F.col(id_col), F.col(out.columns[-1])["rate"]).cast("int")
    numbers = F.when(taken > 0, F.sequence(F.lit(1), taken)).otherwise(F.array().cast("array<int>"))
    return out.select(*(c for c in docs.columns if c.lower() != "mix_copy"), F.explode(numbers).alias("mix_copy"))
