"""Market breadth: counts of rising and falling symbols per date, and the indicators built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..windows import lag, last, ratio, so_far


def build_breadth(bars: DataFrame) -> DataFrame:
    """date, up/down/flat/total_count, up/down_rate over the symbols that have a previous close."""
    change = bars.withColumn("_p", lag("close")).filter("_p is not null")
    out = change.groupBy("date").agg(F.count_if(F.col("close") > F.col("_p")).alias("up_count"), F.count_if(F.col("close") < F.col("_p")).alias("down_count"), F.count_if(F.col("close") == F.col("_p")).alias("flat_count"), F.count("*").alias("total_count"))
    return out.withColumns({"up_rate": ratio("up_count", "total_count"), "down_rate": ratio("down_count", "total_count")})


def with_breadth(df: DataFrame, breadth: DataFrame | None = None) -> DataFrame:
    """up_count and down_count as they are, from a breadth table by date, or zero. A breadth table has a row a date."""
    if "up_count" in df.columns and "down_count" in df.columns:
        return df
    if breadth is None:
        return df.withColumns({"up_count": F.lit(0), "down_count": F.lit(0)})
    joined = df.join(breadth.select("date", "up_count", "down_count"), "date", "left")
    return joined.fillna(0, ["up_count", "down_count"])


def abi(df: DataFrame, n: int = 10) -> DataFrame:
    """The period only names the column."""
    up, down = F.col("up_count"), F.col("down_count")
    return df.withColumn(f"abi{n}", F.coalesce(ratio(F.abs(up - down) * 100, up + down), F.lit(0.0)))


def adl(df: DataFrame) -> DataFrame:
    return df.withColumn("adl", F.sum(F.col("up_count") - F.col("down_count")).over(so_far()))


def _full(value: Column, n: int) -> Column:
    """Null until the window is full."""
    return F.when(F.count(F.lit(1)).over(last(n)) == n, value)


def adr(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn(f"adr{n}", _full(ratio(F.avg("up_count").over(last(n)) * 100, F.avg("down_count").over(last(n))), n))


def obos(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn(f"obos{n}", _full(F.avg("up_count").over(last(n)) - F.avg("down_count").over(last(n)), n))
