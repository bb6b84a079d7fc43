"""Cost indicators: volume-weighted typical prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..windows import last, mean, so_far


def _vwap(frame: WindowSpec) -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum("volume").over(frame)
    return F.when(volume == 0, F.col("close")).otherwise(F.try_divide(F.sum(typical * F.col("volume")).over(frame), volume))


def cyc(df: DataFrame, windows: tuple[int, ...] = (5, 13, 34)) -> DataFrame:
    """The close where there is no volume."""
    df = df.withColumns({**{f"cyc{n}": _vwap(last(n)) for n in windows}, "cyc_inf": _vwap(so_far())})
    return df.withColumn("cyc", F.col(f"cyc{windows[0]}"))


def cys(df: DataFrame, n: int = 13) -> DataFrame:
    df = df.withColumn("_c", _vwap(last(n)))
    df = df.withColumn("cys", F.when(F.col("_c") > 0, F.try_divide(F.col("close") - F.col("_c"), "_c") * 100).otherwise(0.0))
    return df.withColumn("cys_ma5", mean("cys", 5)).drop("_c")
