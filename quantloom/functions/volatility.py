"""Volatility and sentiment indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rolling import rolled
from ..windows import lag, last, mean, ratio, so_far, total


def boll(df: DataFrame, windows: tuple[int, ...] = (20,), width: float = 2.0) -> DataFrame:
    """Sample deviation; null on a symbol's first row."""
    for n in windows:
        df = df.withColumn(f"mb{n}", mean("close", n)).withColumn("_s", F.stddev_samp("close").over(last(n)))
        df = df.withColumns({f"up{n}": F.col(f"mb{n}") + width * F.col("_s"), f"dn{n}": F.col(f"mb{n}") - width * F.col("_s")})
    return df.withColumns({c: F.col(f"{c}{windows[0]}") for c in ("mb", "up", "dn")}).drop("_s")


def wr(df: DataFrame, windows: tuple[int, ...] = (10, 6)) -> DataFrame:
    """Positive scale; wr and wr1 are the first window, wr2 the second."""
    for n in windows:
        df = rolled(df, n, {"_low": ("min", "low"), "_high": ("max", "high")})
        df = df.withColumn(f"wr{n}", ratio((F.col("_high") - F.col("close")) * 100, F.col("_high") - F.col("_low")))
    df = df.drop("_low", "_high")
    df = df.withColumns({"wr": F.col(f"wr{windows[0]}"), "wr1": F.col(f"wr{windows[0]}")})
    return df.withColumn("wr2", F.col(f"wr{windows[1]}")) if len(windows) > 1 else df


def brar(df: DataFrame, windows: tuple[int, ...] = (26,)) -> DataFrame:
    zero = F.lit(0.0)
    df = df.withColumns({
        "_ho": F.greatest(F.col("high") - F.col("open"), zero), "_ol": F.greatest(F.col("open") - F.col("low"), zero),
        "_hc": F.greatest(F.col("high") - lag("close"), zero), "_cl": F.greatest(lag("close") - F.col("low"), zero),
    })
    for n in windows:
        df = df.withColumns({f"ar{n}": total("_ho", n) / (total("_ol", n) + 1e-4) * 100, f"br{n}": total("_hc", n) / (total("_cl", n) + 1e-4) * 100})
    return df.withColumns({"ar": F.col(f"ar{windows[0]}"), "br": F.col(f"br{windows[0]}")}).drop("_ho", "_ol", "_hc", "_cl")


def asi(df: DataFrame, signal: int = 20) -> DataFrame:
    """The swing index of each bar, not accumulated; 0 where there is no range."""
    o1, h1, l1, c1 = (lag(c) for c in ("open", "high", "low", "close"))
    df = df.withColumns({
        "_tr": F.greatest(F.abs(h1 - F.col("close")), F.abs(l1 - F.col("close")), F.abs(h1 - l1)),
        "_si": F.col("open") - c1 + 0.5 * (F.col("open") - F.col("close")) + 0.25 * (c1 - o1),
    })
    df = df.withColumn("asi", F.when(F.col("_tr") != 0, ratio("_si", "_tr") * 16).otherwise(0.0))
    return df.withColumn("asi_sig", mean("asi", signal)).drop("_tr", "_si")


def emv(df: DataFrame, windows: tuple[int, ...] = (14,), scale: float = 1e8) -> DataFrame:
    """Midpoint move per boxed volume; 0 where high equals low."""
    mid, spread = (F.col("high") + F.col("low")) / 2, F.col("high") - F.col("low")
    df = df.withColumn("_mid", mid)
    one = F.when(spread == 0, 0.0).otherwise(ratio((F.col("_mid") - lag("_mid")) * scale, ratio("volume", spread)))
    df = df.withColumn("_emv", one)
    df = df.withColumns({f"emv{n}": mean("_emv", n) for n in windows})
    return df.withColumn("emv", F.col(f"emv{windows[0]}")).drop("_mid", "_emv")


def mcst(df: DataFrame, windows: tuple[int, ...] = (12,)) -> DataFrame:
    """Cumulative mean price by amount; 0 while there is no volume."""
    df = df.withColumn("mcst", ratio(F.sum("amount").over(so_far()), F.sum("volume").over(so_far()), 0.0))
    return df.withColumns({f"mcst_ma{n}": mean("mcst", n) for n in windows})
