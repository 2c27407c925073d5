"""Points and leagues of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .strategies import BENCHMARK

#: Weights of the components and points by place (fixed values).
WEIGHTS = {"excess_return": 25, "sharpe": 20, "win_rate": 15, "profit_factor": 15, "max_drawdown": 15, "consistency": 10}
LEAGUE = (10, 8, 6, 5, 4, 3, 2, 1)


def norm(x: Column, low: float, high: float, neutral: float = 0.0) -> Column:
    return F.coalesce(F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))), F.lit(neutral))


def points(metrics: DataFrame, min_trades: int = 3) -> DataFrame:
    """Adds a points column per component and points in all. The benchmark's return is looked up in the same rows."""
    bench = metrics.where(F.col("strategy") == BENCHMARK).select("symbol", F.col("total_return_pct").alias("_bench"))
    df = metrics.join(bench, "symbol", "left")
    parts = {
        "excess_return": norm(F.col("total_return_pct") - F.col("_bench"), -20, 20),
        "sharpe": norm(F.col("sharpe_ratio"), -1, 3, 0.25),
        "win_rate": norm(F.col("win_rate_pct"), 20, 70),
        "profit_factor": norm(F.col("profit_factor"), 0, 3),
        "max_drawdown": 1 - norm(F.abs("max_drawdown_pct"), 0, 50),
        "consistency": norm(F.col("consistency_pct"), 0, 100),
    }
    df = df.withColumns({f"pts_{k}": F.bround(v * float(WEIGHTS[k]), 1) for k, v in parts.items()})
    total = sum((F.col(f"pts_{k}") for k in WEIGHTS), F.lit(0.0))
    active = F.when(F.col("strategy") == BENCHMARK, 1.0).otherwise(0.3 + 0.7 * F.least(F.lit(1.0), F.col("n_trades") / float(min_trades)))
    return df.withColumn("points", F.bround(total * active, 1)).drop("_bench")


def league(df: DataFrame, by: tuple[str, ...], result: str, name: str = "strategy") -> DataFrame:
    """place and league_points by the result, names breaking ties; rows without a result get none."""
    order = Window.partitionBy(*by).orderBy(F.col(result).desc(), name)
    df = df.where(F.col(result).isNotNull()).withColumn("place", F.row_number().over(order))
    table = F.array(*(F.lit(x) for x in LEAGUE))
    return df.withColumn("league_points", F.coalesce(F.get(table, F.col("place") - 1), F.lit(1)))
