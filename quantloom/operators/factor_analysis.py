"""Plain factors of one symbol's bars and their test against the same row's return.

They differ from the alpha factors: windows hold the current row and give null until they are full, denominators of RSI, KDJ
and WR are raised by a small constant instead of being tested for 0, and factors are held against the return of their own row.
Everything is a window expression over the symbol, or an aggregation by symbol.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from ..windows import KEY, corr, ewm, lag, last, ratio
from .order_stats import below, percentiles, value_counts

SMALL = 1e-10


def _full(value: Callable[[], Column], c: str | Column, n: int) -> Column:
    """value where the last n rows all have c."""
    return F.when(F.count(c).over(last(n)) == n, value())


def _mean(c: str | Column, n: int) -> Column:
    return _full(lambda: F.avg(c).over(last(n)), c, n)


def _position(n: int, top: bool = False) -> Column:
    """Where the close lies in the range of the last n rows, in percent from the bottom (or the top)."""
    low, high = _full(lambda: F.min("low").over(last(n)), "low", n), _full(lambda: F.max("high").over(last(n)), "high", n)
    return (high - F.col("close") if top else F.col("close") - low) / (high - low + SMALL) * 100


def _macd(df: DataFrame) -> DataFrame:
    df = df.withColumn("macd", ewm("close", 12) - ewm("close", 26)).withColumn("macd_signal", ewm("macd", 9))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def _rsi(df: DataFrame) -> DataFrame:
    change = F.col("close") - lag("close")
    df = df.withColumns({"_g": F.greatest(change, change * 0), "_l": F.greatest(-change, change * 0)})  # null for the first row
    return df.withColumn("rsi", 100 - 100 / (1 + _mean("_g", 14) / (_mean("_l", 14) + SMALL))).drop("_g", "_l")


def _boll(df: DataFrame) -> DataFrame:
    middle, s = _mean("close", 20), _full(lambda: F.stddev_samp("close").over(last(20)), "close", 20)
    return df.withColumns({"boll_mid": middle, "boll_upper": middle + 2 * s, "boll_lower": middle - 2 * s})


def _kdj(df: DataFrame) -> DataFrame:
    df = df.withColumn("_p", _position(9)).withColumn("kdj_k", ewm("_p", 3)).withColumn("kdj_d", ewm("kdj_k", 3))
    return df.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d")).drop("_p")


def _ma(df: DataFrame) -> DataFrame:
    return df.withColumns({f"ma{n}": _mean("close", n) for n in (5, 10, 20, 60)})


def _atr(df: DataFrame) -> DataFrame:
    before = lag("close")
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))  # skips nulls
    return df.withColumn("_t", true_range).withColumn("atr", _mean("_t", 14)).drop("_t")


def _wr(df: DataFrame) -> DataFrame:
    return df.withColumn("wr", _position(14, top=True))


def _cci(df: DataFrame) -> DataFrame:
    """Each distance is from its own row's mean, so that the first value comes after two windows."""
    df = df.withColumn("_p", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_m", _mean("_p", 14))
    df = df.withColumn("_d", F.abs(F.col("_p") - F.col("_m")))
    return df.withColumn("cci", ratio(F.col("_p") - F.col("_m"), _mean("_d", 14) * 0.015)).drop("_p", "_m", "_d")


def _momentum(name: str, n: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(name, ratio(F.col("close") - lag("close", n), lag("close", n)))


FACTORS = {
    "macd": _macd, "rsi": _rsi, "boll": _boll, "kdj": _kdj, "ma": _ma, "atr": _atr, "wr": _wr, "cci": _cci,
    **{f"mom{k}m": _momentum(f"mom{k}m", n) for k, n in ((1, 20), (3, 60), (6, 120), (12, 240))},
}


def with_factors(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """bars plus the columns of the named factors (all by default); unknown names are an error."""
    for name in names if names is not None else FACTORS:
        bars = FACTORS[name.lower()](bars)
    return bars


def validity(df: DataFrame, columns: list[str], buckets: int = 5) -> DataFrame:
    """symbol, factor, n, ic, long_return, short_return, long_short_return: Pearson correlation of each factor column with the
    same row's return, and the mean returns of the symbol's last and first bucket that have rows. Buckets are (edge, next
    edge] between linear percentiles. Rows without factor or return are left out; a symbol without any has no row."""
    made = df.withColumn("_y", ratio(F.col("close") - lag("close"), lag("close")))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = made.select(KEY, pairs.alias("p"), "_y").select(KEY, "p.factor", "p.x", F.col("_y").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    keys = [KEY, "factor"]
    long = written(long)
    counted = below(written(value_counts(long, keys, "x")), keys, "x", few=False)
    edges = percentiles(counted, keys, "x", [i / buckets for i in range(1, buckets)]).select(*keys, "e")
    edges = edges.join(long.groupBy(*keys).agg(F.count("*").alias("n"), corr("x", "y").alias("ic")), keys)
    placed = long.join(edges.select(*keys, "e"), keys).withColumn("b", F.size(F.filter("e", lambda e: e < F.col("x"))))
    means = placed.groupBy(*keys, "b").agg(F.avg("y").alias("m"))
    ends = means.groupBy(*keys).agg(F.max_by("m", "b").alias("long_return"), F.min_by("m", "b").alias("short_return"))
    return edges.join(ends, keys).select(*keys, "n", "ic", "long_return", "short_return", (F.col("long_return") - F.col("short_return")).alias("long_short_return"))


def combine(df: DataFrame, columns: list[str], name: str = "factor_combination") -> DataFrame:
    """The plain sum of factor columns, a missing one as 0."""
    return df.withColumn(name, sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)))


def factor_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """symbol, a, b, r for every pair of factor columns, from one aggregation by symbol."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.groupBy(KEY).agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(KEY, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select(KEY, "p.*")
