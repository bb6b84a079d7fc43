"""Preparation of bars: de-duplication, cleaning, filling, resampling, sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from ..windows import KEY, TIME, lag, row, so_far, w

REQUIRED = ("date", "open", "high", "low", "close", "volume", "amount")
#: Symbols whose bounds are broadcast.
MOST = 500_000
NUMBERS = ("open", "high", "low", "close", "volume", "amount")


def preprocess(df: DataFrame) -> DataFrame:
    """One bar a symbol and date (ties: the least by all columns). A frame that lacks a required column stays as it is."""
    if not set(REQUIRED) <= set(df.columns):
        return df
    first = Window.partitionBy(KEY, TIME).orderBy(*[F.col(c) for c in df.columns if c not in (KEY, TIME)])
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def clean(df: DataFrame) -> DataFrame:
    return df.dropna().filter(F.col("volume") > 0)


def _trimmed(df: DataFrame, columns: tuple[str, ...], low_high: Callable[[str], tuple[Column, Column]]) -> DataFrame:
    """Column after column, rows within bounds computed over each symbol. The bars and each column's bounds (a row a symbol) are
    written once, so no step repeats the ones before it and the bars are only scanned, not sorted or shuffled."""
    df = written(df)
    for c in columns:
        low, high = low_high(c)
        bounds = written(df.groupBy(KEY).agg(low.alias("_lo"), high.alias("_hi")))
        small = F.broadcast(bounds) if bounds.count() <= MOST else bounds
        df = df.join(small, KEY).filter(F.col(c).between(F.col("_lo"), F.col("_hi")) | F.col("_lo").isNull()).drop("_lo", "_hi")
    return df


def clean_iqr(df: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close"), t: float = 3.0) -> DataFrame:
    """Column after column: the quartiles of each are those of the rows that the columns before left."""

    def low_high(c: str) -> tuple[Column, Column]:
        q1, q3 = F.percentile(c, 0.25), F.percentile(c, 0.75)
        return q1 - t * (q3 - q1), q3 + t * (q3 - q1)

    return _trimmed(df, columns, low_high)


def clean_zscore(df: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close"), t: float = 3.0) -> DataFrame:
    """Column after column, by sample deviation; a column without deviation keeps all rows."""

    def low_high(c: str) -> tuple[Column, Column]:
        mean, s = F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))
        return mean - t * s, mean + t * s

    return _trimmed(df, columns, low_high)


def fill(df: DataFrame, how: str = "forward", columns: tuple[str, ...] = NUMBERS) -> DataFrame:
    """Nulls from the last value (forward), the next one (backward) or the symbol's mean."""
    frames = {"forward": lambda c: F.last(c, True).over(so_far()), "backward": lambda c: F.first(c, True).over(w().rowsBetween(0, Window.unboundedFollowing)), "mean": lambda c: F.coalesce(c, F.avg(c).over(Window.partitionBy(KEY)))}
    return df.withColumns({c: frames[how](c) for c in columns})


def quality_report(df: DataFrame) -> DataFrame:
    """One row: rows, nulls of each column, bars without volume."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in NUMBERS], F.count_if(F.col("volume") == 0).alias("zero_volume"))


def convert_types(df: DataFrame, kind: str = "float", columns: tuple[str, ...] = NUMBERS) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


def nan_to_zero(df: DataFrame, columns: tuple[str, ...] = NUMBERS) -> DataFrame:
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(0.0)) for c in columns})


def resample(df: DataFrame, to: str = "1w", iso_year: bool = False) -> DataFrame:
    """Weekly or monthly bars. Weeks are ISO weeks within the calendar year, so the last days of December may fall in the
    group of January's week 1; iso_year takes the year that the ISO week belongs to."""
    day = F.col(TIME).cast("date")
    year = F.extract(F.lit("YEAROFWEEK"), day) if iso_year and to == "1w" else F.year(day)
    part = F.weekofyear(day) if to == "1w" else F.month(day)
    at = lambda c: F.struct(TIME, c)
    extra = [F.sum(c).alias(c) for c in ("pct_chg", "change") if c in df.columns]
    return df.groupBy(KEY, year.cast("int").alias("year"), part.cast("int").alias("part")).agg(F.min(TIME).alias(TIME), F.min(at("open"))["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(at("close"))["close"].alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), *extra)


def sample_uniform(df: DataFrame, target: int) -> DataFrame:
    """Every (rows / target)-th bar of each symbol, the first one included."""
    step = F.greatest(F.floor(F.count("*").over(Window.partitionBy(KEY)) / target), F.lit(1))
    return df.withColumns({"_step": step, "_n": row() - 1}).filter(F.col("_n") % F.col("_step") == 0).drop("_step", "_n")


def sample_adaptive(df: DataFrame, target: int) -> DataFrame:
    """About `target` bars a symbol: the first and the last, then those that moved more than the upper quartile of moves
    (largest first), then others spread evenly. Kept bars stay in time order."""
    all_ = Window.partitionBy(KEY)
    df = df.withColumns({"_n": row(), "_all": F.count("*").over(all_), "_move": F.coalesce(F.abs(F.col("close") - lag("close")), F.lit(0.0))})
    df = df.join(df.groupBy(KEY).agg(F.percentile("_move", 0.75).alias("_q")), KEY)
    edge = (F.col("_n") == 1) | (F.col("_n") == F.col("_all"))
    df = df.withColumn("_kind", F.when(edge, 0).when(F.col("_move") > F.col("_q"), 1).otherwise(2))
    own = Window.partitionBy(KEY, "_kind")
    df = df.withColumn("_turn", F.row_number().over(own.orderBy(F.when(F.col("_kind") == 1, -F.col("_move")), "_n"))).withColumn("_of", F.count("*").over(own))
    spread = F.when(F.col("_kind") == 2, F.pmod(F.col("_turn") * target, F.col("_of"))).otherwise(F.lit(0))
    rank = F.row_number().over(all_.orderBy("_kind", spread, "_turn"))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= target).drop("_n", "_all", "_move", "_q", "_kind", "_turn", "_of", "_rank")


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol, after indicators, so that their warm-up is right."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))).filter(F.col("_n") <= n).drop("_n")


def extremes(df: DataFrame) -> DataFrame:
    """Highest high and lowest low of each symbol and when they were (first, on ties)."""
    return df.groupBy(KEY).agg(F.max("high").alias("max_high"), F.max(F.struct("high", -F.unix_micros(F.col(TIME).cast("timestamp")), F.col(TIME).alias("t")))["t"].alias("max_at"), F.min("low").alias("min_low"), F.min(F.struct("low", TIME))[TIME].alias("min_at"))
