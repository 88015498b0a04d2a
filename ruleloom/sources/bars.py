"""Bars (OHLCV) from transactions, and the time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.windows import with_rn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from(rows: DataFrame, *, ticker: Column, time: Column, price: str, order: str, volume: Column | None = None) -> DataFrame:
    """One bar per ticker and time: first, highest, lowest and last price, and volume; with ``rn``."""
    grouped = rows.groupBy(ticker.alias("ticker"), time.alias("open_dt")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        (F.count("*") if volume is None else F.sum(volume)).cast("double").alias("volume"),
    )
    return with_rn(grouped)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals, a ticker per order priority."""
    o = table(spark, sf_dir, "orders")
    return bars_from(o, ticker=F.col("o_orderpriority"), time=F.col("o_orderdate"), price="o_totalprice", order="o_orderkey")


def total_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of all order totals under one ticker."""
    o = table(spark, sf_dir, "orders")
    return bars_from(o, ticker=F.lit("ALL"), time=F.col("o_orderdate"), price="o_totalprice", order="o_orderkey")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values, a ticker per event type."""
    e = table(spark, sf_dir, "events")
    return bars_from(e, ticker=F.col("event_type"), time=F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"), price="value", order="event_id")


ORDER_BARS_SQL = """
b0 AS (SELECT o_orderpriority AS ticker, o_orderdate AS open_dt, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY open_dt) - 1 AS rn FROM b0)"""
TOTAL_BARS_SQL = ORDER_BARS_SQL.replace("o_orderpriority AS ticker", "'ALL' AS ticker")
EVENT_BARS_SQL = """
b0 AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS open_dt, arg_min(value, event_id) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY open_dt) - 1 AS rn FROM b0)"""


def to_time(c: Column, unit: str | None = None) -> Column:
    """A timestamp column from text, or from an epoch number of the given unit (s, ms, us, ns)."""
    n = c.cast("bigint")
    if unit is None:
        return F.to_timestamp_ntz(c.cast("string")) if unit is None else c
    at = {"s": lambda: F.timestamp_seconds(n), "ms": lambda: F.timestamp_millis(n), "us": lambda: F.timestamp_micros(n), "ns": lambda: F.timestamp_micros(F.expr("1") * F.floor(n / 1000).cast("bigint"))}[unit]()
    return at.cast("timestamp_ntz")


def epoch_unit(df: DataFrame, column: str) -> str:
    """Unit of an epoch column by the size of its median."""
    median = df.select(F.percentile(F.abs(F.col(column)), F.lit(0.5))).first()[0] or 0.0
    return "s" if median < 1e10 else "ms" if median < 1e13 else "us" if median < 1e16 else "ns"


def normalise_axis(df: DataFrame, time_col: str, *, unit: str | None = None) -> DataFrame:
    """``open_dt`` from a timestamp, text or epoch column, whichever it is."""
    kind = dict(df.dtypes)[time_col]
    if kind.startswith("timestamp"):
        return df.withColumn("open_dt", F.col(time_col).cast("timestamp_ntz"))
    if kind in ("bigint", "int", "double"):
        return df.withColumn("open_dt", to_time(F.col(time_col), unit or epoch_unit(df, time_col)))
    return df.withColumn("open_dt", to_time(F.col(time_col)))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null: Spark compares NaN as the largest number."""
    wild = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*(F.when(~wild(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def bar_hours(bars: DataFrame) -> DataFrame:
    """Median hours between bars, per ticker."""
    from ruleloom.functions.windows import lag

    step = (F.unix_micros(F.col("open_dt").cast("timestamp")) - lag(F.unix_micros(F.col("open_dt").cast("timestamp")))) / 3.6e9
    return bars.withColumn("step", step).groupBy("ticker").agg(F.percentile("step", F.lit(0.5)).alias("bar_hours"))
