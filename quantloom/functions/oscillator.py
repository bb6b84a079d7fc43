"""Oscillators: RSI, KDJ, CCI, ROC and MTM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rolling import rolled
from ..windows import ewm, lag, mean, ratio


def rsi(df: DataFrame, windows: tuple[int, ...] = (14,)) -> DataFrame:
    """Exponentially weighted gains and losses; 100 where there is no loss."""
    change = F.coalesce(F.col("close") - lag("close"), F.lit(0.0))
    df = df.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))})
    for n in windows:
        gain, loss = ewm("_gain", n), ewm("_loss", n)
        df = df.withColumns({"_g": gain, "_l": loss})
        df = df.withColumn(f"rsi{n}", F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("_g", "_l"))))
    return df.withColumn("rsi", F.col(f"rsi{windows[0]}")).drop("_gain", "_loss", "_g", "_l")


def kdj(df: DataFrame, windows: tuple[int, ...] = (14,)) -> DataFrame:
    """K and D are plain means of three rows; the bare names stand for the window of 14 only."""
    for n in windows:
        df = rolled(df, n, {"_low": ("min", "low"), "_high": ("max", "high")})
        df = df.withColumn("_rsv", ratio((F.col("close") - F.col("_low")) * 100, F.col("_high") - F.col("_low")))
        df = df.withColumn(f"k{n}", mean("_rsv", 3)).withColumn(f"d{n}", mean(f"k{n}", 3))
        df = df.withColumn(f"j{n}", 3 * F.col(f"k{n}") - 2 * F.col(f"d{n}"))
        if n == 14:
            df = df.withColumns({c: F.col(f"{c}14") for c in "kdj"})
    return df.drop("_rsv", "_low", "_high")


def cci(df: DataFrame, windows: tuple[int, ...] = (14,)) -> DataFrame:
    """Deviation is the mean of each row's distance from its own mean, not from the current one."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    for n in windows:
        df = df.withColumn("_m", mean("_tp", n)).withColumn("_dev", mean(F.abs(F.col("_tp") - F.col("_m")), n))
        df = df.withColumn(f"cci{n}", ratio(F.col("_tp") - F.col("_m"), F.col("_dev") * 0.015))
    return df.withColumn("cci", F.col(f"cci{windows[0]}")).drop("_tp", "_m", "_dev")


def roc(df: DataFrame, windows: tuple[int, ...] = (12,)) -> DataFrame:
    df = df.withColumns({f"roc{n}": ratio((F.col("close") - lag("close", n)) * 100, lag("close", n)) for n in windows})
    return df.withColumn("roc", F.col(f"roc{windows[0]}"))


def mtm(df: DataFrame, windows: tuple[int, ...] = (12,)) -> DataFrame:
    df = df.withColumns({f"mtm{n}": F.col("close") - lag("close", n) for n in windows})
    return df.withColumn("mtm", F.col(f"mtm{windows[0]}"))
