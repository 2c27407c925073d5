"""Votes, verdicts and rankings over a universe of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import back, change, clip, ratio


def _bands(x: Column, steps: list[tuple[float, float]], rest: float, above: bool) -> Column:
    """Score of the first step that x passes."""
    out = None
    for edge, score in steps:
        hit = x > edge if above else x < edge
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return F.when(x.isNotNull(), out.otherwise(rest))


def fundamental_score(df: DataFrame) -> DataFrame:
    """Mean of the sub-scores that are known, by bands of each figure (fixed values)."""
    der = F.when(F.col("der") > 10, F.col("der") / 100).otherwise(F.col("der"))
    parts = F.array(
        _bands(F.when(F.col("pe") > 0, F.col("pe")), [(15, 1.0), (25, 0.6), (40, 0.3)], 0.1, False),
        _bands(F.when(F.col("pbv") > 0, F.col("pbv")), [(1, 1.0), (3, 0.6)], 0.3, False),
        _bands(F.col("roe"), [(0.20, 1.0), (0.10, 0.6), (0.0, 0.3)], 0.0, True),
        _bands(der, [(0.5, 1.0), (1.0, 0.6), (2.0, 0.3)], 0.1, False),
        _bands(F.col("profit_margin"), [(0.15, 1.0), (0.05, 0.6), (0.0, 0.3)], 0.0, True),
        _bands(F.col("revenue_growth"), [(0.15, 1.0), (0.05, 0.6), (0.0, 0.4)], 0.1, True),
    )
    known = F.filter(parts, lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known).cast("double"), F.lit(0.0))
    return df.withColumn("fundamental_score", mean)


def format_amount(x: Column) -> Column:
    """Amounts in trillions, billions or millions, as text."""
    out = F.when(F.abs(x) >= 1e12, F.format_string("%.2fT", x / 1e12)).when(F.abs(x) >= 1e9, F.format_string("%.2fB", x / 1e9))
    return out.when(F.abs(x) >= 1e6, F.format_string("%.2fM", x / 1e6)).otherwise(F.format_string("%.0f", x))


def gainers(df: DataFrame, n: int = 10, min_price: float | None = None, max_price: float | None = None, min_change: float | None = None) -> DataFrame:
    """The n symbols whose last close rose most against the one before; ties by name."""
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    df = df.withColumns({"prev_close": back("close"), "pct_change": change("close") * 100}).withColumn("_rn", F.row_number().over(newest)).where("_rn = 1 AND pct_change IS NOT NULL")
    for test in (min_price is not None and F.col("close") >= min_price, max_price is not None and F.col("close") <= max_price, min_change is not None and F.col("pct_change") >= min_change):
        if test is not False:
            df = df.where(test)
    return df.select("symbol", F.col("close").alias("last"), "prev_close", "pct_change", "volume").orderBy(F.col("pct_change").desc(), "symbol").limit(n)


def vote(df: DataFrame, w_signal: float = 0.34, w_mc: float = 0.33, w_bt: float = 0.33, w_fund: float = 0.0) -> DataFrame:
    """overall from the columns composite, prob_profit, win_rate_pct, n_trades and fundamental_score; unknown is one half."""
    signal = F.coalesce((F.col("composite") + 1) / 2, F.lit(0.5))
    past = F.when(F.col("n_trades") >= 3, F.col("win_rate_pct") / 100).otherwise(0.5)
    parts = ((signal, w_signal), (F.coalesce("prob_profit", F.lit(0.5)), w_mc), (F.coalesce(past, F.lit(0.5)), w_bt), (F.coalesce("fundamental_score", F.lit(0.5)), w_fund))
    total = sum((v * w for v, w in parts), F.lit(0.0)) / (w_signal + w_mc + w_bt + w_fund)
    values = [v for v, w in parts if w]
    return df.withColumn("overall", total).withColumn("component_spread", F.greatest(*values) - F.least(*values))


def verdict(df: DataFrame, z_guard: float = 1.5) -> DataFrame:
    """BUY, SELL or HOLD by overall; a BUY is held back where the price is stretched or nobody trades it."""
    guards = F.concat_ws(" + ", F.when(F.col("z") >= z_guard, "Z-Guard"), F.when(F.col("tier") == "hard_illiquid", "Liquidity-Guard"))
    buy = F.when(guards == "", "BUY").otherwise(F.concat(F.lit("HOLD ("), guards, F.lit(")")))
    return df.withColumn("verdict", F.when(F.col("overall") >= 0.55, buy).when(F.col("overall") <= 0.45, "SELL").otherwise("HOLD"))


def scalp_swing(df: DataFrame) -> DataFrame:
    """scalp from signal, volume ratio and z; swing from the back-test, the simulation and, where known, the fundamentals. Other
    unknown parts are one half."""
    half = lambda c: F.coalesce(c, F.lit(0.5))
    spike = half(F.when(F.col("volume_ratio").isNotNull(), F.least(F.lit(1.0), F.col("volume_ratio") / 3)))
    scalp = (half((F.col("composite") + 1) / 2) + spike + half(clip((-F.col("z") / 3 + 1) / 2, 0, 1))) / 3
    slow = half(F.when(F.col("n_trades") >= 3, F.col("win_rate_pct") / 100)) + half(F.col("prob_profit"))
    swing = F.when(F.col("fundamental_score").isNotNull(), (slow + F.col("fundamental_score")) / 3).otherwise(slow / 2)
    return df.withColumn("scalp", scalp).withColumn("swing", swing)


def regime_weights(regime: Column) -> Column:
    """Weights of signal, simulation, back-test and fundamentals by volatility regime (fixed values)."""
    make = lambda *w: F.struct(*(F.lit(x).alias(n) for n, x in zip(("signal", "mc", "bt", "fund"), w)))
    return F.when(regime == "high", make(0.35, 0.20, 0.35, 0.10)).otherwise(make(0.20, 0.40, 0.25, 0.15))


def news_sentiment(articles: DataFrame) -> DataFrame:
    """Mean over articles of the mean of their known entity scores; articles without a score are left out."""
    scores = articles.select("symbol", "article_id", F.explode("entities.sentiment_score").alias("score")).where("score IS NOT NULL")
    per_article = scores.groupBy("symbol", "article_id").agg(F.avg("score").alias("score"))
    return per_article.groupBy("symbol").agg(F.avg("score").alias("sentiment"), F.count(F.lit(1)).alias("n_articles"))


def order_ticket(df: DataFrame, capital: float = 1e8, fraction: float = 0.2, lot: int = 100) -> DataFrame:
    """Quantity in whole lots for a fixed fraction of the capital."""
    return df.withColumn("quantity", (F.floor(ratio(F.lit(capital * fraction), "close") / lot) * lot).cast("long")).withColumn("value", F.col("quantity") * F.col("close"))


#: How far the parts of a vote may lie apart before they differ, and before they contradict each other (fixed values).
SLIGHT, CONTRARY = 0.2, 0.4


def regime_vote(df: DataFrame) -> DataFrame:
    """overall by the weights of the column regime, how far the parts agree (contrary, slight, agreed), and a sentence that says so."""
    parts = {"signal": F.coalesce((F.col("composite") + 1) / 2, F.lit(0.5)), "mc": F.coalesce("prob_profit", F.lit(0.5))}
    parts |= {"bt": F.coalesce(F.when(F.col("n_trades") >= 3, F.col("win_rate_pct") / 100).otherwise(0.5), F.lit(0.5)), "fund": F.coalesce("fundamental_score", F.lit(0.5))}
    weights = regime_weights(F.col("regime"))
    overall = sum((weights[k] * v for k, v in parts.items()), F.lit(0.0))
    apart = F.greatest(*parts.values()) - F.least(*parts.values())
    out = df.withColumn("overall", overall).withColumn("agreement", F.when(apart > CONTRARY, "contrary").when(apart > SLIGHT, "slight").otherwise("agreed"))
    lean = F.when(F.col("overall") >= 0.55, "leans up").when(F.col("overall") <= 0.45, "leans down").otherwise("is undecided")
    return out.withColumn("narrative", F.concat(F.col("symbol"), F.lit(" "), lean, F.lit(" in a "), F.col("regime"), F.lit(" volatility regime"), F.when(F.col("agreement") == "contrary", ", but its parts contradict each other.").when(F.col("agreement") == "slight", ", with parts that differ a little.").otherwise(".")))


#: Windows, levels and weight of the signals by holding period, days to simulate and days of a test fold (fixed values).
PRESETS = {
    "swing": {"mr_window": 20, "mr_z_entry": 1.5, "fast": 10, "slow": 30, "mr_weight": 0.5, "mc_days": 15, "fold_test_days": 60},
    "position": {"mr_window": 40, "mr_z_entry": 1.75, "fast": 20, "slow": 60, "mr_weight": 0.4, "mc_days": 45, "fold_test_days": 120},
    "long_term": {"mr_window": 90, "mr_z_entry": 2.0, "fast": 50, "slow": 150, "mr_weight": 0.3, "mc_days": 90, "fold_test_days": 252},
}


def movers(df: DataFrame) -> DataFrame:
    """How many symbols rose, fell or stood still at their last bar."""
    last = df.withColumn("_c", change("close")).groupBy("symbol").agg(F.max_by("_c", "ts").alias("_c")).where("_c IS NOT NULL")
    return last.agg(*(F.count_if(test).alias(name) for name, test in (("up", F.col("_c") > 0), ("down", F.col("_c") < 0), ("flat", F.col("_c") == 0))))


def enrich(df: DataFrame, sentiment: DataFrame, by: str = "symbol") -> DataFrame:
    """Every row of df with the sentiment of its news. It is shown and changes no score."""
    return df.join(sentiment.select(F.col("symbol").alias(by), "sentiment"), by, "left")
