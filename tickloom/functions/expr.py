"""Expressions that every operator uses: null instead of NaN or infinity, windows of bars, portable normals."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars_order():
    """The bars of a symbol in order."""
    return Window.partitionBy("symbol").orderBy("ts")


def so_far():
    """All bars up to and with the present one."""
    return bars_order().rowsBetween(Window.unboundedPreceding, 0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_bars(n: int, shift: int = 0):
    """The n bars that end shift bars ago."""
    return bars_order().rowsBetween(-(n - 1) - shift, -shift)


def rolling(fn: Callable[[Column], Column], c: Column | str, n: int, shift: int = 0) -> Column:
    """fn over the last n bars; null until all n values are there."""
    c, w = col(c), last_bars(n, shift)
    return F.when(F.count(c).over(w) == n, fn(c).over(w))


def ratio(a: Column | str, b: Column | str) -> Column:
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    """Between the bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def back(c: Column | str, n: int = 1) -> Column:
    return F.lag(col(c), n).over(bars_order())


def change(c: Column | str, n: int = 1) -> Column:
    """Relative change over n bars."""
    return ratio(c, back(c, n)) - 1


def log_of(c: Column | str) -> Column:
    return F.ln(F.nullif(col(c).cast("double"), F.lit(0.0)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, minus zero as zero; the last step of a query."""
    return df.select(*(F.when(F.round(c, digits) == 0, F.lit(0.0)).otherwise(F.round(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: Coefficients of Abramowitz and Stegun 26.2.17 (fixed values).
PHI = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, within 7.5e-8."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(PHI):
        poly = (poly + F.lit(c)) * t
    tail = F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi)) * poly
    return F.when(x.isNotNull(), F.when(x >= 0, 1 - tail).otherwise(tail))


def portable_int(i: Column) -> Column:
    """A number below 2**31 - 1 for each draw number, from integer arithmetic that any SQL engine repeats."""
    p = F.lit(2147483647).cast("long")
    i = i.cast("long") % p
    x = (48271 * i + 12345) % p
    x = (x * x + 16807 * i + 1) % p
    return (x * x + 69621) % p


def portable_normal(i: Column) -> Column:
    """A standard normal for each draw number below 2**31, from integer arithmetic that any SQL engine repeats."""
    p = F.lit(2147483647).cast("long")
    i = i.cast("long")
    x = (48271 * i + 12345) % p
    x = (x * x + 16807 * i + 1) % p
    x = (x * x + 69621) % p
    y = (69621 * i + 777) % p
    y = (y * y + 40014 * i + 7) % p
    y = (y * y + 48271) % p
    u, v = ((k.cast("double") + 0.5) / 2147483647.0 for k in (x, y))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)
