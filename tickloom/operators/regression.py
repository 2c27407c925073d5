"""Models of many groups at once: logistic regression, isotonic calibration, and walk-forward models on top.

A round of a fit is one aggregate over all rows of all groups (symbols, folds): sums combine before the shuffle, so neither
a long history nor a large group meets in one task. The few sums of a group are solved in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import stored
from .evaluation import resampled

ROUNDS = 60
#: Steps of a round are held within this, which matters for far starts only.
LONGEST_STEP = 5.0


def solved(df: DataFrame, matrix: list[list[str]], right: list[str]) -> tuple[DataFrame, list[Column]]:
    """The solution of a symmetric positive definite system per row: names of its columns by place. Elimination in stages of
    columns, so that no expression grows."""
    k = len(right)
    for p in range(k):
        stage = {}
        for i in range(p + 1, k):
            share = F.col(matrix[i][p]) / F.col(matrix[p][p])
            stage |= {f"_m{p}_{i}_{j}": F.col(matrix[i][j]) - share * F.col(matrix[p][j]) for j in range(p + 1, k)}
            stage[f"_b{p}_{i}"] = F.col(right[i]) - share * F.col(right[p])
        df = df.withColumns(stage) if stage else df
        matrix = [[f"_m{p}_{i}_{j}" if i > p and j > p else matrix[i][j] for j in range(k)] for i in range(k)]
        right = [f"_b{p}_{i}" if i > p else right[i] for i in range(k)]
    for i in reversed(range(k)):
        known = sum((F.col(matrix[i][j]) * F.col(f"_s{j}") for j in range(i + 1, k)), F.lit(0.0))
        df = df.withColumn(f"_s{i}", (F.col(right[i]) - known) / F.col(matrix[i][i]))
    return df, [F.col(f"_s{i}") for i in range(k)]


def logistic(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def linear(coef: str, features: Sequence[str]) -> Column:
    """Intercept and weighted features."""
    return sum((F.get(coef, F.lit(i + 1)) * F.col(f) for i, f in enumerate(features)), F.get(coef, F.lit(0)))


def fit_logistic(rows: DataFrame, by: Sequence[str], features: Sequence[str], label: str, penalty: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """by, coef (intercept first), n: for each group the weights that minimise log loss + penalty / 2 * sum of squared
    weights, the intercept left free. Newton rounds: gradient and Hessian of all groups are one aggregate. Rows with a null are left
    out; groups with one class have no row in the result."""
    by, k = list(by), len(features) + 1
    rows = stored(rows.select(*by, *(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_y")).na.drop(), "logistic-rows")
    start = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_y").alias("_low"), F.max("_y").alias("_high")).where("_low < _high")
    coef = stored(start.select(*by, "n", F.array(*[F.lit(0.0)] * k).alias("coef")), "logistic")
    x = [F.lit(1.0), *map(F.col, features)]
    for _ in range(ROUNDS):
        at = rows.join(coef, by).withColumn("_p", logistic(linear("coef", features)))
        weight = F.col("_p") * (1 - F.col("_p"))
        ridge = [0.0] + [penalty] * (k - 1)
        sums = [F.sum((F.col("_y") - F.col("_p")) * x[i]).alias(f"g{i}") for i in range(k)]
        sums += [F.sum(weight * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        made = at.groupBy(*by).agg(F.first("n").alias("n"), F.first("coef").alias("coef"), *sums)
        made = made.withColumns({f"g{i}": F.col(f"g{i}") - ridge[i] * F.get("coef", F.lit(i)) for i in range(k)} | {f"h{i}_{i}": F.col(f"h{i}_{i}") + ridge[i] for i in range(k)})
        made, step = solved(made, [[f"h{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)], [f"g{i}" for i in range(k)])
        held = [F.greatest(F.lit(-LONGEST_STEP), F.least(F.lit(LONGEST_STEP), s)) for s in step]
        moved = F.greatest(*map(F.abs, held)) if k > 1 else F.abs(held[0])
        after = stored(made.select(*by, "n", F.array(*(F.get("coef", F.lit(i)) + s for i, s in enumerate(held))).alias("coef"), moved.alias("_moved")), "logistic")
        coef = after.select(*by, "n", "coef")
        if after.where((F.col("_moved") > tolerance) | F.isnan("_moved")).isEmpty():
            return coef
    raise RuntimeError(f"weights still moved after {ROUNDS} rounds")


def fit_isotonic(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, low, high, value, n: the non-decreasing steps nearest to y, by least squares, in order of x; equal x share a step.
    Each round merges all stretches of neighbouring steps that do not rise, in all groups at once; pooling in any order
    ends at the same steps."""
    by = list(by)
    steps = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("low")).agg(F.sum(F.col(y).cast("double")).alias("_s"), F.count(F.lit(1)).alias("n"))
    steps = stored(steps.withColumn("high", F.col("low")), "isotonic")
    order = Window.partitionBy(*by).orderBy("low")
    while True:
        mean = F.col("_s") / F.col("n")
        rises = F.lag(mean).over(order) < mean
        run = F.sum(F.coalesce(rises, F.lit(True)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        marked = steps.withColumn("_rises", F.coalesce(rises, F.lit(True))).withColumn("_run", run)
        merged = marked.groupBy(*by, "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("_s").alias("_s"), F.sum("n").alias("n"), F.bool_and("_rises").alias("_still"))
        merged = stored(merged, "isotonic")
        steps = merged.select(*by, "low", "high", "_s", "n")
        if merged.where(~F.col("_still")).isEmpty():
            return steps.select(*by, "low", "high", mean.alias("value"), "n")


def apply_isotonic(df: DataFrame, steps: DataFrame, by: Sequence[str], x: str, name: str) -> DataFrame:
    """df with name: the value of the step of x, between two steps a straight line, beyond them the outer value; null for a null
    x or a group without steps. Rows and steps are
    sorted together, once up and once down."""
    by = list(by)
    knot = lambda c: F.struct(F.col(c).cast("double").alias("at"), F.col("value").alias("value"))
    knots = steps.select(*by, F.explode(F.array(knot("low"), knot("high"))).alias("_knot")).distinct()
    both = df.withColumn("_row", F.struct(*df.columns)).select(*by, F.col(x).cast("double").alias("_at"), "_row").unionByName(knots.withColumn("_at", F.col("_knot.at")), allowMissingColumns=True)
    nearest = lambda at: F.last("_knot", ignorenulls=True).over(Window.partitionBy(*by).orderBy(at, F.col("_knot").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    before, after = nearest(F.col("_at").asc()), nearest(F.col("_at").desc())
    both = both.withColumns({"_before": before, "_after": after}).where("_row IS NOT NULL")
    share = (F.col("_at") - F.col("_before.at")) / (F.col("_after.at") - F.col("_before.at"))
    between = F.col("_before.value") + share * (F.col("_after.value") - F.col("_before.value"))
    value = F.when(F.col("_at").isNull(), None).when(F.col("_before").isNull(), F.col("_after.value"))
    value = value.when(F.col("_after").isNull() | (F.col("_before.at") == F.col("_at")), F.col("_before.value")).otherwise(between)
    return both.select("_row.*", value.alias(name))


def _skill(brier: Column, rate: Column) -> Column:
    base = rate * (1 - rate)
    return F.when(base > 0, 1 - brier / base)


def meta_model(feats: DataFrame, features: Sequence[str] = ("vote_signal", "vote_mc", "vote_bt"), label: str = "target", n_folds: int = 4, min_rows: int = 60, min_fold: int = 20, horizon: int = 15, n_resamples: int = 1000) -> DataFrame:
    """A logistic model of the label per symbol, tested walk-forward; symbols with too few rows are left out.

    n rows without nulls are cut into n_folds + 1 blocks; fold f learns from the blocks before and predicts block f + 1. Steps
    of isotonic calibration are fitted to the predictions of the first half of the folds, Brier scores are taken over the
    others, and the score's range comes from blocks of horizon days drawn within folds. Returns n_samples, n_oos, the weights of a
    fit to all rows (intercept, then w_<feature>), brier_model, brier_baseline, baseline_rate_pct, skill, skill_p5, skill_p50,
    skill_p95 (null under 100 resamples with both classes) and significant (p5 above zero).
    """
    of = Window.partitionBy("symbol")
    rows = feats.select("symbol", "ts", *features, F.col(label).cast("double").alias("_y")).na.drop()
    rows = rows.withColumns({"_i": F.row_number().over(of.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(of)})
    rows = rows.withColumn("_size", F.floor(F.col("_n") / (n_folds + 1))).where((F.col("_n") >= min_rows) & (F.col("_size") >= min_fold))
    rows = stored(rows.withColumn("_block", F.floor(F.col("_i") / F.col("_size")).cast("int")), "meta-rows")
    learn = rows.withColumn("fold", F.explode(F.sequence(F.least("_block", F.lit(n_folds)), F.lit(n_folds))))
    coef = fit_logistic(learn, ("symbol", "fold"), features, "_y")
    tested = rows.where(F.col("_block").between(1, n_folds)).withColumn("fold", F.col("_block") - 1).join(coef.select("symbol", "fold", "coef"), ["symbol", "fold"])
    tested = tested.select("symbol", "ts", "fold", "_y", logistic(linear("coef", features)).alias("_p"))
    tested = tested.withColumn("_nth", F.dense_rank().over(of.orderBy("fold")))
    tested = stored(tested.withColumns({"_folds": F.max("_nth").over(of), "_all": F.count(F.lit(1)).over(of)}).where("_all >= 20"), "meta-tested")
    first = F.greatest(F.lit(1), F.floor(F.col("_folds") / 2))
    steps = fit_isotonic(tested.where(F.col("_nth") <= first), ("symbol",), "_p", "_y")
    judged = tested.where((F.col("_nth") > first) | (F.col("_folds") == 1)).select("symbol", "ts", "fold", "_y", "_p")
    judged = stored(apply_isotonic(judged, steps, ("symbol",), "_p", "_c"), "meta-judged")
    error = F.pow(F.col("_c") - F.col("_y"), 2)
    scores = judged.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_oos"), F.avg(error).alias("brier_model"), F.avg("_y").alias("_rate"))
    scores = scores.select("symbol", "n_oos", "brier_model", (F.col("_rate") * (1 - F.col("_rate"))).alias("brier_baseline"), (F.col("_rate") * 100).alias("baseline_rate_pct"), F.coalesce(_skill(F.col("brier_model"), F.col("_rate")), F.lit(0.0)).alias("skill"))
    spread = skill_range(judged, "_c", "_y", n_resamples, max(horizon, 5))
    final = coef.where(F.col("fold") == n_folds).select("symbol", F.col("n").alias("n_samples"), *(F.get("coef", F.lit(i)).alias(name) for i, name in enumerate(["intercept", *(f"w_{f}" for f in features)])))
    return final.join(scores, "symbol").join(spread, "symbol", "left").withColumn("significant", F.coalesce(F.col("skill_p5") > 0, F.lit(False)))


def skill_range(df: DataFrame, predicted: str, actual: str, n_resamples: int = 1000, block: int = 15) -> DataFrame:
    """symbol, skill_p5, skill_p50, skill_p95 over resamples of df(symbol, fold, ts): blocks of neighbouring rows are drawn within
    each fold. Resamples with one class have no skill; under 100 others the range is null."""
    order = Window.partitionBy("symbol", "fold").orderBy("ts")
    nth = df.select("symbol", "fold", F.col(predicted).alias("p"), F.col(actual).alias("a"), (F.row_number().over(order) - 1).cast("long").alias("i"))
    samples = resampled(nth, {"_brier": F.pow(F.col("p") - F.col("a"), 2), "_rate": F.col("a")}, n_resamples, block, by=("symbol", "fold"))
    samples = samples.withColumn("skill", _skill(F.col("_brier") / F.col("n"), F.col("_rate") / F.col("n")))
    enough = F.count("skill") >= 100
    return samples.groupBy("symbol").agg(*(F.when(enough, F.percentile("skill", F.lit(p / 100))).alias(f"skill_p{p}") for p in (5, 50, 95)))


def meta_label_model(samples: DataFrame, features: Sequence[str], min_train: int = 20, n_folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """How a logistic filter on trades does walk-forward, per symbol with min_train + 10 trades or more.

    samples: symbol, ts, label, return_pct and features of each trade, known when it was signalled. The first min_train trades
    only teach; the others are cut into n_folds blocks, each predicted from all trades before it, with features scaled by what those
    trades show. Returns n_samples, n_oos, base_win_rate, base_avg_return, coverage, filtered_win_rate,
    filtered_avg_return, skipped_win_rate, bss.
    """
    of = Window.partitionBy("symbol")
    rows = samples.select("symbol", "ts", "label", "return_pct", *(F.col(f).cast("double").alias(f) for f in features)).na.drop()
    rows = rows.withColumns({"_i": F.row_number().over(of.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(of)}).where(F.col("_n") >= min_train + 10)
    block = F.floor((F.col("_i") - min_train) * n_folds / (F.col("_n") - min_train))
    rows = stored(rows.withColumn("_block", F.when(F.col("_i") < min_train, -1).otherwise(block).cast("int")), "label-rows")
    learn = rows.where(F.col("_block") < n_folds - 1).withColumn("fold", F.explode(F.sequence(F.col("_block") + 1, F.lit(n_folds - 1))))
    scale = learn.groupBy("symbol", "fold").agg(*(f(c).alias(f"{n}{c}") for c in features for n, f in (("_m_", F.avg), ("_d_", F.stddev_pop))))
    scaled = lambda df: df.join(scale, ["symbol", "fold"]).withColumns({c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_d_{c}"), F.lit(0.0)), F.lit(0.0)) for c in features})
    coef = fit_logistic(scaled(learn), ("symbol", "fold"), features, "label")
    tested = scaled(rows.where("_block >= 0").withColumn("fold", F.col("_block"))).join(coef.select("symbol", "fold", "coef"), ["symbol", "fold"])
    tested = tested.withColumn("_p", logistic(linear("coef", features)))
    take, win, ret = F.col("_p") >= threshold, F.col("label").cast("double"), F.col("return_pct")
    out = tested.groupBy("symbol").agg(
        F.first("_n").alias("n_samples"), F.count(F.lit(1)).alias("n_oos"), (F.avg(win) * 100).alias("base_win_rate"), F.avg(ret).alias("base_avg_return"), F.avg(take.cast("double")).alias("coverage"),
        (F.avg(F.when(take, win)) * 100).alias("filtered_win_rate"), F.avg(F.when(take, ret)).alias("filtered_avg_return"), (F.avg(F.when(~take, win)) * 100).alias("skipped_win_rate"),
        F.avg(F.pow(F.col("_p") - win, 2)).alias("_brier"), F.avg(win).alias("_rate"),
    )
    return out.where("n_oos >= 10").withColumn("bss", F.coalesce(_skill(F.col("_brier"), F.col("_rate")), F.lit(0.0))).drop("_brier", "_rate")
