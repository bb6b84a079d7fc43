"""OHLCV bars (symbol, date, open, high, low, close, volume, amount) derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type; open and close by time, ties by value. Partial aggregates before the shuffle."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), hour.alias("date"), "ts", "value")
    at = F.struct("ts", "value")
    return events.groupBy("symbol", "date").agg(F.min(at)["value"].alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(at)["value"].alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"))


def bars_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each supplier's line items; price per unit, ties in time by order, line and price."""
    day = F.col("l_shipdate").cast("date")
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.date_sub(day, F.weekday(day)).alias("date"), F.struct(day, "l_orderkey", "l_linenumber", price.alias("p")).alias("at"), price.alias("p"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("a"))
    return rows.groupBy("symbol", "date").agg(F.min("at")["p"].alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max("at")["p"].alias("close"), F.sum("q").alias("volume"), F.sum("a").alias("amount"))


def bars_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a bar of its own: thousands of rows a symbol and more, the number grows with the table."""
    value = F.col("value").cast("double")
    volume = F.floor(value).cast("double") + 1
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("date"), *[value.alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"))
    return rows.withColumn("amount", F.col("close") * F.col("volume"))


def dividends_of(bars: DataFrame, every: int = 100) -> DataFrame:
    """Synthetic events on every 100th bar of a symbol: cash of 1 % of the close, one share for ten, no rights."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    return bars.withColumn("_n", n).filter(F.col("_n") % every == 0).select("symbol", F.col("date").alias("ex_date"), (F.col("close") * 0.01).alias("cash_div"), F.lit(0.1).alias("share_div"), F.lit(None).cast("double").alias("rights_issue_price"), F.lit(None).cast("double").alias("rights_issue_ratio"))


def stock_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension of symbols: suppliers with nation as industry and region as area."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("area"))
