"""Logs as tables on disk that are appended to and updated in place, and the cache of a scan as JSON.

A log is partitioned by the month of its day. An update rewrites only the months that hold rows to change: the new months are
written beside the log first and then take the place of the old ones by a dynamic partition overwrite, which Spark commits as
a whole. So a run that fails leaves the log as it was, and a run repeated changes nothing. One writer at a time is assumed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.store import stored
from ..operators.logs import backfill, fresh_rows

MONTH = "log_month"
AGE_DAYS = 7
SIGNAL_LOG = "symbol string, log_date date, composite double, verdict string, close_at_signal double, fwd_return_pct double"
ARENA_LOG = "date date, symbol string, strategy string, position double, close double"
CACHED = "symbol string, signal string, score double, mc_prob_profit double, win_rate double, liq_tier string"


def load(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The log at path; one without rows where there is none yet."""
    names = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        return spark.read.schema(StructType([*names.fields]).add(MONTH, "string")).parquet(path).select(*names.names, MONTH)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], StructType([*names.fields]).add(MONTH, "string"))


def append(path: str, rows: DataFrame, schema: str, keys: list[str], day: str) -> None:
    """Appends the rows whose keys the log lacks, one per key. Only the log's keys in the months of the new rows are read."""
    spark = rows.sparkSession
    rows = rows.withColumn(MONTH, F.date_format(day, "yyyy-MM"))
    log = load(spark, path, schema)
    known = log.join(rows.select(MONTH).distinct(), MONTH, "left_semi").select(*keys)
    columns = StructType.fromDDL(schema)
    for f in columns.fields:
        rows = rows if f.name in rows.columns else rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    new = fresh_rows(known, rows.select(*(F.col(f.name).cast(f.dataType) for f in columns.fields), MONTH), keys)
    stored(new, "log-rows").write.mode("append").partitionBy(MONTH).parquet(path)


def fill_forward_returns(path: str, bars: DataFrame, today: dt.date, ahead: int = 5, min_age: int = AGE_DAYS) -> int:
    """Fills fwd_return_pct of rows without one that are min_age days old and have `ahead` later bars; returns the months that were
    rewritten. Younger rows and known values stay as they are."""
    spark = bars.sparkSession
    log = load(spark, path, SIGNAL_LOG)
    due = F.col("fwd_return_pct").isNull() & (F.col("log_date") <= F.lit(today - dt.timedelta(days=min_age)))
    made = backfill(log.where(due).drop("fwd_return_pct"), bars.where(F.to_date("ts") <= F.lit(today)), ahead).where("fwd_return_pct IS NOT NULL")
    made = stored(made.select("symbol", "log_date", MONTH, F.col("fwd_return_pct").alias("_made")), "log-made")
    months = made.select(MONTH).distinct()
    n = months.count()
    if n:
        touched = log.join(months, MONTH, "left_semi").join(made.drop(MONTH), ["symbol", "log_date"], "left")
        touched = touched.withColumn("fwd_return_pct", F.when(due, F.col("_made")).otherwise(F.col("fwd_return_pct"))).select(*log.columns)
        stored(touched, "log-months").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    return n


def write_cache(rows: DataFrame, path: str) -> None:
    """One JSON document per symbol, unknown values included, in place of what path held."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHED).json(path)
