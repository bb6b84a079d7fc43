"""Signals as columns: signal is buy, sell or hold; position is 1 after a buy and 0 after a sale or before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..windows import KEY, TIME, lag, last, prior, ratio, row, so_far


def _emit(df: DataFrame, buy: Column, sell: Column) -> DataFrame:
    df = df.withColumn("signal", F.when(buy, "buy").when(sell, "sell").otherwise("hold"))
    held = F.when(F.col("signal") == "buy", 1).when(F.col("signal") == "sell", 0)
    return df.withColumn("position", F.coalesce(F.last(held, True).over(so_far()), F.lit(0)))


def trend_following(df: DataFrame, short: int = 10, long: int = 20) -> DataFrame:
    """Crosses of two means, from the row at which the long one is full."""
    df = df.withColumns({"_s": F.avg("close").over(last(short)), "_l": F.avg("close").over(last(long))})
    late = row() > long
    up, down = (F.col("_s") > F.col("_l")) & (lag("_s") <= lag("_l")), (F.col("_s") < F.col("_l")) & (lag("_s") >= lag("_l"))
    return _emit(df, late & up, late & down).drop("_s", "_l")


def mean_reversion(df: DataFrame, low: float = 30, high: float = 70) -> DataFrame:
    """On a column rsi."""
    return _emit(df, F.col("rsi") < low, F.col("rsi") > high)


def momentum(df: DataFrame, n: int = 12) -> DataFrame:
    df = df.withColumn("_m", F.when(row() > n, ratio(F.col("close") - lag("close", n), lag("close", n))).otherwise(0.0))
    late = row() > n
    return _emit(df, late & (F.col("_m") > 0) & (F.col("_m") > lag("_m")), late & (F.col("_m") < 0) & (F.col("_m") < lag("_m"))).drop("_m")


def breakout(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """A close beyond the close before it by `width` mean true ranges of the n rows before."""
    p = lag("close")
    df = df.withColumn("_tr", F.when(p.isNull(), 0.0).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))))
    df = df.withColumns({"_atr": F.avg("_tr").over(prior(n)), "_p": p})
    late, span = row() > n, width * F.col("_atr")
    return _emit(df, late & (F.col("close") > F.col("_p") + span), late & (F.col("close") < F.col("_p") - span)).drop("_tr", "_atr", "_p")


def ma_state(df: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """The level, not the cross: buy while the short mean is above the long one, once that is full."""
    s, l, late = F.avg("close").over(last(short)), F.avg("close").over(last(long)), row() >= long
    return _emit(df, late & (s > l), late & (s < l))


def _window_ema(column: str, n: int) -> Column:
    """An exponential mean that begins anew at the first of the last n values: a fixed-weight sum of the window."""
    a = 2.0 / (n + 1)
    weights = F.array(*[F.lit((1 - a) ** (n - 1) if i == 0 else a * (1 - a) ** (n - 1 - i)) for i in range(n)])
    values = F.collect_list(column).over(last(n))  # at most n values
    return F.when(row() >= n, F.aggregate(F.zip_with(values, weights, lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v))


def macd_state(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Crosses of a MACD whose means are seeded anew at each bar; lines that touched at the bar before do not cross."""
    df = df.withColumn("_d", _window_ema("close", fast) - _window_ema("close", slow))
    df = df.withColumn("_g", F.when(F.count("_d").over(last(signal)) == signal, _window_ema("_d", signal)))
    up, down = (F.col("_d") > F.col("_g")) & (lag("_d") < lag("_g")), (F.col("_d") < F.col("_g")) & (lag("_d") > lag("_g"))
    return _emit(df, up, down).drop("_d", "_g")


def multi_factor(df: DataFrame) -> DataFrame:
    """Votes of means (0.3), MACD (0.4) and RSI (0.3); beyond 0.3 either way."""
    from .alpha import rsi

    vote = lambda: F.when(F.col("signal") == "buy", 1.0).when(F.col("signal") == "sell", -1.0).otherwise(0.0)
    df = ma_state(df).withColumn("_a", vote())
    df = rsi(macd_state(df).withColumn("_b", vote()), (14,))
    c = F.when((row() > 14) & (F.col("rsi_14") < 30), 1.0).when((row() > 14) & (F.col("rsi_14") > 70), -1.0).otherwise(0.0)
    score = F.round(0.3 * F.col("_a") + 0.4 * F.col("_b") + 0.3 * c, 6)
    return _emit(df.withColumn("score", score), F.col("score") > 0.3, F.col("score") < -0.3).drop("_a", "_b", "rsi_14")


def multi_indicator(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """symbol, score, signal at each symbol's last bar from the indicator columns rsi, wr, macd, k and d: (value - 50) / 50 for
    rsi and wr, macd over its greatest absolute value, (k - d) / 100 for kdj, weighted (equally by default); beyond 0.3 either
    way. A missing value gives no score and hold."""
    weights = weights or {name: 0.25 for name in ("rsi", "wr", "macd", "kdj")}
    at_end = {c: F.max_by(c, TIME) for c in ("rsi", "wr", "macd", "k", "d") if c in df.columns}
    ends = df.groupBy(KEY).agg(*[c.alias(n) for n, c in at_end.items()], *([F.max(F.abs("macd")).alias("_most")] if "macd" in at_end else []))
    parts = {"rsi": (F.col("rsi") - 50) / 50, "wr": (F.col("wr") - 50) / 50, "macd": ratio("macd", "_most"), "kdj": (F.col("k") - F.col("d")) / 100}
    score = sum((parts[name] * weight for name, weight in weights.items()), F.lit(0.0))
    return ends.withColumn("score", score).select(KEY, "score", F.when(F.col("score") > 0.3, "buy").when(F.col("score") < -0.3, "sell").otherwise("hold").alias("signal"))


STRATEGIES = {"trend": trend_following, "momentum": momentum, "breakout": breakout, "ma": ma_state, "macd": macd_state, "multi_factor": multi_factor}
