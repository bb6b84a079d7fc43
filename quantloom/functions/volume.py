"""Volume indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..windows import lag, mean, prior, ratio, so_far, total


def _side(sign: int) -> Column:
    """The volume of bars that close above (1), below (-1) or at (0) the close before; 0 on other bars."""
    return F.when(F.signum(F.col("close") - lag("close")) == sign, F.col("volume")).otherwise(0.0)


def vol_ma(df: DataFrame, windows: tuple[int, ...] = (5, 10)) -> DataFrame:
    df = df.withColumns({f"vol_ma{n}": mean("volume", n) for n in windows})
    return df.withColumn("vol_ma", F.col(f"vol_ma{windows[0]}"))


def vol_tdx(df: DataFrame, n: int = 5) -> DataFrame:
    return df.withColumn("vol_tdx", mean("volume", n))


def obv(df: DataFrame) -> DataFrame:
    signed = F.coalesce(F.signum(F.col("close") - lag("close")) * F.col("volume"), F.lit(0.0))
    return df.withColumn("_s", signed).withColumn("obv", F.sum("_s").over(so_far())).drop("_s")


def vr(df: DataFrame, windows: tuple[int, ...] = (26,)) -> DataFrame:
    df = df.withColumns({"_up": _side(1), "_down": _side(-1), "_flat": _side(0)})
    for n in windows:
        half = total("_flat", n) / 2
        df = df.withColumn(f"vr{n}", (total("_up", n) + half) / (total("_down", n) + half + 1e-4) * 100)
    return df.withColumn("vr", F.col(f"vr{windows[0]}")).drop("_up", "_down", "_flat")


def psy(df: DataFrame, windows: tuple[int, ...] = (12,)) -> DataFrame:
    """Rising bars in the window, always divided by its length."""
    df = df.withColumn("_up", F.when(F.col("close") > lag("close"), 1.0).otherwise(0.0))
    df = df.withColumns({f"psy{n}": total("_up", n) / n * 100 for n in windows})
    return df.withColumn("psy", F.col(f"psy{windows[0]}")).drop("_up")


def cr(df: DataFrame, windows: tuple[int, ...] = (26,)) -> DataFrame:
    """By volume, unlike the textbook's prices."""
    df = df.withColumns({"_up": _side(1), "_down": _side(-1)})
    for n in windows:
        up, down = total("_up", n), total("_down", n)
        df = df.withColumn(f"cr{n}", (up - down) / (up + down + 1e-4) * 100)
    return df.withColumn("cr", F.col(f"cr{windows[0]}")).drop("_up", "_down")


def hsl(df: DataFrame, float_share: float | None = None) -> DataFrame:
    """Turnover rate; without the float, volume against its mean of 60 bars, times five."""
    rate = F.col("volume") / float_share * 100 if float_share else ratio("volume", mean("volume", 60), 0.0) * 5
    df = df.withColumn("hsl", rate)
    return df.withColumns({"hsl_ma5": mean("hsl", 5), "hsl_ma10": mean("hsl", 10)})


def lb(df: DataFrame, n: int = 5) -> DataFrame:
    """Volume against the mean of the n volumes before; 1 where there is none."""
    return df.withColumn("lb", F.coalesce(ratio("volume", F.avg("volume").over(prior(n))), F.lit(1.0)))
