"""Bars (symbol, ts, open, high, low, close, volume) from tables of priced rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("open", "high", "low", "close", "volume")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_bars(rows: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, order: Sequence[str]) -> DataFrame:
    """One bar per symbol and ts: first and last price by the total order of `order`, range, summed volume. The
    aggregates combine before the shuffle, so no symbol's rows meet in one task."""
    key = F.struct(*order)
    rows = rows.select(symbol.alias("symbol"), ts.cast("timestamp").alias("ts"), price.alias("price"), volume.cast("double").alias("size"), key.alias("key"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.sum("size").alias("volume"),
    )


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _line_bars(rows: DataFrame, symbol: Column, unit: str) -> DataFrame:
    return build_bars(rows, symbol, F.date_trunc(unit, "l_shipdate"), F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)), F.col("l_quantity"), LINE_ORDER)


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_bars(read_table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"), "day")


def benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_bars(read_table(spark, sf_dir, "lineitem"), F.lit("ALL"), "day")


def bars_daily_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read_table(spark, sf_dir, name)
    where = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    return _line_bars(t("lineitem").join(where, F.col("l_suppkey") == F.col("s_suppkey")), F.col("r_name"), "day")


def bars_weekly(spark: SparkSession, sf_dir: str, by: str = "p_brand") -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", by)
    return _line_bars(read_table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")), F.col(by), "week")


def bars_weekly_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return build_bars(rows, F.col("c_mktsegment"), F.date_trunc("week", "o_orderdate"), F.col("o_totalprice"), F.lit(1), ("o_orderkey",))


def bars_events(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    return build_bars(read_table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc(unit, "ts"), F.col("value"), F.lit(1), ("ts", "event_id"))


def valid_bars(bars: DataFrame) -> DataFrame:
    """Bars without a null or NaN price or volume."""
    numbers = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), *(F.expr(f"nanvl(try_cast({c} AS DOUBLE), NULL)").alias(c) for c in COLUMNS))
    return numbers.dropna(subset=list(COLUMNS))


def normalise_symbol(symbol: Column, suffix: str = ".JK") -> Column:
    """Exchange codes in upper case with their suffix, once."""
    up = F.upper(F.trim(symbol))
    return F.when(up.endswith(suffix), up).otherwise(F.concat(up, F.lit(suffix)))


def from_json_values(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Bars from provider payloads {"meta": {"symbol"}, "values": [{"datetime", "open", ...}]}; what is no number becomes null."""
    fields = ", ".join(f"{c}: STRING" for c in ("datetime", *COLUMNS))
    parsed = payloads.select(F.from_json(column, f"meta STRUCT<symbol: STRING>, values ARRAY<STRUCT<{fields}>>").alias("p"))
    rows = parsed.select(F.col("p.meta.symbol").alias("symbol"), F.inline("p.values"))
    return valid_bars(rows.withColumnRenamed("datetime", "ts"))


def from_epoch_rows(rows: DataFrame) -> DataFrame:
    """Bars from (symbol, ms, open, high, low, close, volume) with epoch milliseconds."""
    return valid_bars(rows.withColumn("ts", F.timestamp_millis("ms")))


def clean_codes(codes: DataFrame, column: str) -> DataFrame:
    """symbol: distinct codes in upper case, without spaces around them, with dashes for dots; empty ones are left out."""
    code = F.regexp_replace(F.upper(F.trim(column)), "\\.", "-")
    return codes.select(code.alias("symbol")).where("symbol <> ''").distinct()


def quoted_in(pairs: DataFrame, column: str, quote: str) -> DataFrame:
    """symbol: the distinct trading pairs BASE/QUOTE with that quote."""
    return pairs.select(F.col(column).alias("symbol")).where(F.endswith("symbol", F.lit(f"/{quote}"))).distinct()


def first_with(least: int, *sources: DataFrame) -> DataFrame:
    """The first of the sources that has so many rows, else the last: universes fall back on a list of their own. Only as
    many rows as that are read to decide."""
    for source in sources[:-1]:
        if source.limit(least).count() >= least:
            return source
    return sources[-1]
