"""Indicators of symbols too long for one task.

Windows keep a symbol's bars in one task, which suits thousands of bars and not millions of ticks. Here the rows of each symbol are
numbered without sorting it in one task (pieces of its time range, sums of the pieces below as bases) and cut into slices of
equal length. A slice is a symbol of its own to the indicator functions: its key is the symbol with the slice's number. It gets
as many rows before its first one as the indicator reaches back (the halo), which are dropped afterwards. Exponential means
reach back until the weights left add up to less than 2^-60 of the whole, below the last bit of a double. Running
sums have no reach: each slice sums its own rows and gets the sum of the slices before it, carried over the slices' totals.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import indicator_of, with_indicators
from ..scratch import written
from ..windows import KEY, TIME, lag, mean, ratio
from .order_stats import below, same_keys
from .rolling import shared_rolling

AT = "_at"
#: Rows of all symbols that make a task of slices, on average.
TASK = 100_000


def fades(span: int) -> int:
    """Rows after which an exponential mean's older weights are below 2^-60 of all."""
    return 0 if span <= 1 else math.ceil(60 * math.log(2) / -math.log(1 - 2 / (span + 1)))


#: Rows before a row that an indicator with these parameters reads.
REACH: dict[str, Callable[..., int]] = {
    "ma": lambda windows: max(windows),
    "macd": lambda fast, slow, signal: fades(max(fast, slow)) + fades(signal),
    "dmi": lambda windows: 1 + 3 * max(windows),
    "trix": lambda windows, signal: 3 * fades(max(windows)) + 1 + fades(signal),
    "dma": lambda short, long, signal: max(short, long) + signal,
    "fsl": lambda: 0,
    "expma": lambda windows: fades(max(windows)),
    "bbi": lambda: 24,
    "rsi": lambda windows: 1 + fades(max(windows)),
    "kdj": lambda windows: max(windows) + 6,
    "cci": lambda windows: 2 * max(windows),
    "roc": lambda windows: max(windows),
    "mtm": lambda windows: max(windows),
    "vol_ma": lambda windows: max(windows),
    "vol_tdx": lambda n: n,
    "vr": lambda windows: 1 + max(windows),
    "psy": lambda windows: 1 + max(windows),
    "cr": lambda windows: 1 + max(windows),
    "hsl": lambda float_share: 70,
    "lb": lambda n: n,
    "boll": lambda windows, width: max(windows),
    "wr": lambda windows: max(windows),
    "brar": lambda windows: 1 + max(windows),
    "asi": lambda signal: 1 + signal,
    "emv": lambda windows, scale: 1 + max(windows),
    "cys": lambda n: n + 5,
}


def reach(name: str, **params) -> int:
    """How far back the named indicator reads, with its defaults where params say nothing."""
    one = indicator_of(name)
    given = inspect.signature(one.run).bind_partial(None, **{**one.params, **params})
    given.apply_defaults()
    return REACH[name](*list(given.arguments.values())[1:])


def numbered(bars: DataFrame, size: int = 100_000) -> DataFrame:
    """A written table of bars plus _at, the row's place in its symbol by time, from 0. No task sorts more than about `size` rows
    of a symbol; rows of one time stand next to each other in any order."""
    bars = written(bars)
    longest, symbols = bars.groupBy(KEY).agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    pieces = max(1, -(-(longest or 0) // size))
    # few: else Spark, which goes by the size of the file, may broadcast the bars to their pieces
    placed = below(bars.withColumn("n", F.lit(1)), [KEY], TIME, pieces=pieces, few=symbols * pieces <= 200_000, at_once=0)
    return written(placed.withColumn(AT, F.col("before")).drop("n", "before", "total"))


def over_slices(table: DataFrame, run: Callable[[DataFrame], DataFrame], back: int, size: int = 100_000) -> DataFrame:
    """run() over the slices of a numbered table, for functions that read at most `back` rows before a row."""
    own = F.floor(F.col(AT) / size)
    into = F.explode(F.sequence(own, F.floor((F.col(AT) + back) / size)))
    cut = table.withColumn("_slice", into).withColumn("_own", F.col("_slice") == own).withColumn(KEY, F.struct(F.col(KEY).alias("of"), F.col("_slice").alias("number")))
    # a number of tasks by the rows: Spark would put slices together up to so many bytes of shuffled data, several times that in sorts
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK))
    out = run(cut.drop("_slice").repartition(tasks, KEY)).filter("_own").drop("_own")
    return out.withColumn(KEY, F.col(f"{KEY}.of"))


def long_rolling(bars: DataFrame, windows: Iterable[int], size: int = 20_000) -> DataFrame:
    """shared_rolling() for symbols of any length: the same columns, no task holds more of a symbol than some slices."""
    windows = tuple(windows)
    if not windows:
        return bars
    return over_slices(numbered(bars), lambda df: shared_rolling(df, windows), max(windows) - 1, size).drop(AT)


def running(table: DataFrame, sums: dict[str, Column], size: int = 100_000) -> DataFrame:
    """A numbered table plus running sums over each symbol: within the slices, and the totals of the slices before."""
    of = [KEY, "_slice"]
    within = Window.partitionBy(*of).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    mine = table.withColumn("_slice", F.floor(F.col(AT) / size)).withColumns({f"_v{i}": c for i, c in enumerate(sums.values())})
    local = written(mine.withColumns({f"_v{i}": F.sum(f"_v{i}").over(within) for i in range(len(sums))}))  # read twice
    totals = local.groupBy(*of).agg(*[F.max_by(f"_v{i}", AT).alias(f"_t{i}") for i in range(len(sums))])
    before = Window.partitionBy(KEY).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*of, *[F.sum(f"_t{i}").over(before).alias(f"_t{i}") for i in range(len(sums))])
    both = same_keys(local, carried, of)
    total = lambda i: F.coalesce(F.col(f"_v{i}") + F.col(f"_t{i}"), F.col(f"_v{i}"), F.col(f"_t{i}"))
    return both.withColumns({name: total(i) for i, name in enumerate(sums)}).drop("_slice", *[f"_{c}{i}" for c in "vt" for i in range(len(sums))])


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")


#: Indicators with running sums: what is summed, and what the sums give. _signed is the volume with the sign of the close's move.
RUNNING = {
    "obv": ({"obv": lambda: F.col("_signed")}, {}),
    "mcst": ({"_amount": lambda: F.col("amount"), "_volume": lambda: F.col("volume")}, {"mcst": lambda: ratio("_amount", "_volume", 0.0)}),
    "cyc": ({"_paid": _typical, "_volume": lambda: F.col("volume")}, {"cyc_inf": lambda: F.when(F.col("_volume") == 0, F.col("close")).otherwise(F.try_divide("_paid", "_volume"))}),
}


def long_indicators(bars: DataFrame, names: list[str], size: int = 100_000, **params: dict) -> DataFrame:
    """with_indicators() for symbols of any length: the same columns, values equal up to the order of sums. Whatever is bounded
    is made in one pass over the slices, all running sums in a second one."""
    unknown = [n for n in names if n not in REACH and n not in RUNNING]
    if unknown:
        raise KeyError(f"no reach is known for {', '.join(unknown)}")
    of = {n: dict(indicator_of(n).params) | params.get(n, {}) for n in names}
    table = numbered(bars, size)
    bounded = [n for n in names if n in REACH or n == "cyc"]
    longest = lambda n, default: max(of[n].get("windows", default))
    back = [reach(n, **of[n]) if n in REACH else longest(n, (34,)) for n in bounded] + [1] * ("obv" in names)
    signed = F.coalesce(F.signum(F.col("close") - lag("close")) * F.col("volume"), F.lit(0.0))

    def made(df: DataFrame) -> DataFrame:
        df = with_indicators(df, bounded, **params) if bounded else df
        df = df.drop("cyc_inf") if "cyc" in bounded else df
        return df.withColumn("_signed", signed) if "obv" in names else df

    if back:
        table = over_slices(table, made, max(back), size)
    summed = [n for n in names if n in RUNNING]
    if summed:
        table = running(table, {c: what() for n in summed for c, what in RUNNING[n][0].items()}, size)
        table = table.withColumns({c: what() for n in summed for c, what in RUNNING[n][1].items()}).drop("_signed", "_amount", "_volume", "_paid")
    if "mcst" in names:
        windows = of["mcst"].get("windows", (12,))
        table = over_slices(table, lambda df: df.withColumns({f"mcst_ma{n}": mean("mcst", n) for n in windows}), max(windows), size)
    return table.drop(AT)
