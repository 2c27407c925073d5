"""Blended scores and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, rolling
from .indicators import ma_crossover, zscore


def signal_of(score: Column, entry: float = 0.5) -> Column:
    return F.when(score <= -entry, "SELL").when(score >= entry, "BUY").otherwise("HOLD")


def composite(df: DataFrame, mr_window: int = 20, fast: int = 10, slow: int = 30, mr_weight: float = 0.5, legs: dict[str, float] | None = None) -> DataFrame:
    """composite from mean reversion and momentum, then blended with further score columns (legs: column -> weight)
    wherever those are known."""
    df = zscore(ma_crossover(df, fast, slow).drop("signal"), mr_window).drop("signal")
    score = clip(mr_weight * clip(F.col("z"), -3, 3) / -3 + (1 - mr_weight) * F.coalesce(F.signum("diff"), F.lit(0.0)), -1, 1)
    for name, weight in (legs or {}).items():
        score = F.when(F.col(name).isNotNull() & score.isNotNull(), clip((1 - weight) * score + weight * F.col(name), -1, 1)).otherwise(score)
    df = df.withColumn("composite", score)
    return df.withColumn("signal", signal_of(F.col("composite")))


def regime_gate(df: DataFrame, window: int = 200) -> DataFrame:
    """Mutes buying while the column bench is not above its mean: regime_ok, composite and signal anew."""
    df = df.withColumn("regime_ok", F.coalesce(F.col("bench") > rolling(F.avg, "bench", window), F.lit(False)))
    gated = F.when(F.col("regime_ok") | F.col("composite").isNull(), F.col("composite")).otherwise(F.least("composite", F.lit(0.0)))
    return df.withColumn("composite", gated).withColumn("signal", signal_of(F.col("composite")))


def position_size(base: float, score: Column, confidence: Column, realized_vol: Column, vol_target: float = 0.20, low: float = 0.25, high: float = 1.5) -> Column:
    """base scaled by conviction beyond the entry level, model confidence and a volatility target, within [0.01, 1]; a part
    that is unknown scales by one."""
    conviction = F.coalesce(low + (high - low) * clip((F.abs(score) - 0.5) / 0.5, 0, 1), F.lit(1.0))
    trust = F.coalesce(low + (1 - low) * clip(confidence, 0, 1), F.lit(1.0))
    target = F.when(realized_vol > 1e-6, clip(vol_target / realized_vol, 0.25, 2.0)).otherwise(1.0)
    return clip(base * conviction * trust * target, 0.01, 1.0)
