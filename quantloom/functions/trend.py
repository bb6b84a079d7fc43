"""Trend indicators. Each function takes bars (symbol, date, open, high, low, close, ...) and adds its columns.

Warm-up rows use the bars there are (as rolling means with a minimum of one row do), unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..windows import ewm, lag, last, mean, ratio, total


def _alias(df: DataFrame, name: str, source: str) -> DataFrame:
    """The bare column name stands for the first window asked for."""
    return df.withColumn(name, F.col(source))


def ma(df: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    return _alias(df.withColumns({f"ma{n}": mean("close", n) for n in windows}), "ma", f"ma{windows[0]}")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd_hist is the plain difference, not doubled."""
    df = df.withColumn("macd", ewm("close", fast) - ewm("close", slow)).withColumn("macd_signal", ewm("macd", signal))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def dmi(df: DataFrame, windows: tuple[int, ...] = (14,)) -> DataFrame:
    """Directional movement by rolling sums; true range from the previous close."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    df = df.withColumns({
        "_tr": F.greatest("high", lag("close")) - F.least("low", lag("close")),
        "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    for n in windows:
        df = df.withColumns({f"{s}di_{n}": ratio(total(c, n) * 100, total("_tr", n)) for s, c in (("p", "_plus"), ("n", "_minus"))})
        p, m = F.col(f"pdi_{n}"), F.col(f"ndi_{n}")
        df = df.withColumn("_dx", F.when(p + m == 0, 0.0).otherwise(ratio(F.abs(p - m) * 100, p + m)))
        df = df.withColumn(f"adx_{n}", mean("_dx", n)).withColumn(f"adxr_{n}", (F.col(f"adx_{n}") + lag(f"adx_{n}", n)) / 2)
    for c in ("pdi", "ndi", "adx", "adxr"):
        df = _alias(df, c, f"{c}_{windows[0]}")
    return df.drop("_tr", "_plus", "_minus", "_dx")


def trix(df: DataFrame, windows: tuple[int, ...] = (12,), signal: int = 9) -> DataFrame:
    for n in windows:
        df = df.withColumn("_e", ewm("close", n)).withColumn("_e", ewm("_e", n)).withColumn("_e", ewm("_e", n))
        df = df.withColumn(f"trix{n}", ratio(F.col("_e") - lag("_e"), lag("_e")) * 100)
        df = df.withColumn(f"trma{n}", ewm(f"trix{n}", signal))
    return _alias(_alias(df.drop("_e"), "trix", f"trix{windows[0]}"), "trma", f"trma{windows[0]}")


def dma(df: DataFrame, short: int = 10, long: int = 50, signal: int = 10) -> DataFrame:
    df = df.withColumn("dma", mean("close", short) - mean("close", long))
    return df.withColumn("ama", mean("dma", signal))


def fsl(df: DataFrame) -> DataFrame:
    h, l, c, o = (F.col(x) for x in ("high", "low", "close", "open"))
    return df.withColumns({"swl": (h + l + c) / 3, "sws": (h + l + c + o) / 4})


def expma(df: DataFrame, windows: tuple[int, ...] = (12, 50)) -> DataFrame:
    return _alias(df.withColumns({f"expma{n}": ewm("close", n) for n in windows}), "expma", f"expma{windows[0]}")


def bbi(df: DataFrame) -> DataFrame:
    return df.withColumn("bbi", (mean("close", 3) + mean("close", 6) + mean("close", 12) + mean("close", 24)) / 4)
