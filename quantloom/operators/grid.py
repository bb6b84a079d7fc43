"""Parameter grids of any size: combinations are rows of data, so a plan for a thousand is the plan for one.

Bars are numbered and cut into slices of equal length that bring along as many rows before them as the widest window reaches back, so
a long symbol is many tasks. Each slice becomes one array with running sums, made once. Each row takes from it what every distinct
width gives (the difference of two running sums, a close so many rows ago), and each combination picks its widths from the row's list.
Nothing is sorted or summed again for another combination.

Means are compared exactly, as sums of prices in millionths times the other mean's count, so equal means never differ by the last bit.
With turns=True only rows that can begin a trade leave their slice, which is what a backtest's shuffle then carries.

Null closes count in no mean; a comparison with an empty mean gives hold. Rows of one symbol and time stand in any order. A
null symbol is a symbol of its own. No bars or no combinations give no rows. Of other columns none is read. Prices in millionths
must fit a long integer times the squared width of a window, else Spark's overflow error is raised.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..windows import KEY, TIME
from .long_symbols import AT, numbered, over_slices


class Reader:
    """What a strategy reads at a row, `back` rows ago: the row's number, its close, and what its widths give. A width is named by its
    place in the list of distinct widths."""

    def __init__(self, back: int = 0):
        self.back, self.number = back, F.col("_number") - back

    def close(self, back: int = 0) -> Column:
        return F.col(f"_close{self.back + back}")

    def _of(self, width: Column, name: str, back: int) -> Column:
        return F.get("_widths", width)[f"{name}{self.back + back}"]

    def close_before(self, width: Column, back: int = 0) -> Column:
        """The close `width` rows before the row `back` rows ago."""
        return self._of(width, "close", back)

    def above(self, a: Column, b: Column, back: int = 0) -> Column:
        """1, 0 or -1 as the mean over the first width is above, at or below that over the second; null where one has no close."""
        (sa, na), (sb, nb) = ((self._of(w, "sum", back), self._of(w, "many", back)) for w in (a, b))
        return F.when((na > 0) & (nb > 0), F.signum(sa * nb - sb * na))


@dataclass(frozen=True)
class Strategy:
    """The parameters (widths), what a width must give, how many rows before its own a decision reads, and the decision."""

    params: tuple[str, ...]
    gives: tuple[str, ...]
    depth: int
    decide: Callable[[Reader, Column], tuple[Column, Column]]


def _ma_state(at: Reader, p: Column) -> tuple[Column, Column]:
    side, late = at.above(p["short_at"], p["long_at"]), at.number >= p["long"]
    return late & (side > 0), late & (side < 0)


def _trend(at: Reader, p: Column) -> tuple[Column, Column]:
    now, before = (at.above(p["short_at"], p["long_at"], b) for b in (0, 1))
    late = at.number > p["long"]
    return late & (now > 0) & (before <= 0), late & (now < 0) & (before >= 0)


def _momentum(at: Reader, p: Column) -> tuple[Column, Column]:
    def moved(back: int) -> Column:
        then = at.close_before(p["n_at"], back)
        return F.when(at.number - back > p["n"], F.try_divide(at.close(back) - then, then)).otherwise(0.0)

    late = at.number > p["n"]
    return late & (moved(0) > 0) & (moved(0) > moved(1)), late & (moved(0) < 0) & (moved(0) < moved(1))


#: Strategies of operators.signals in the form that reads windows by parameter.
STRATEGIES = {
    "ma_state": Strategy(("short", "long"), ("sum", "many"), 0, _ma_state),
    "trend_following": Strategy(("short", "long"), ("sum", "many"), 1, _trend),
    "momentum": Strategy(("n",), ("close",), 1, _momentum),
}


def combinations(params: dict[str, list]) -> list[dict]:
    return [dict(zip(params, values)) for values in product(*params.values())]


def signal_grid(bars: DataFrame, strategy: str, params: dict[str, list[int]], size: int | None = None, turns: bool = False) -> DataFrame:
    """symbol, date, close, param_id, the parameters and signal, for each bar and combination (param_id counts combinations
    from 0, the last parameter changing fastest). turns leaves out holds and repeats of the row before within a slice; trades() of
    the rest are the same. `size` is the rows of a slice, by default four times what the widest window reaches back."""
    how = STRATEGIES[strategy]
    if set(params) != set(how.params):
        raise ValueError(f"{strategy} takes {', '.join(how.params)}")
    combos = combinations(params)
    widths = sorted({v for c in combos for v in c.values()})
    if any(v < 1 for v in widths):
        raise ValueError("windows have at least one row")
    lags = range(how.depth + 1 + turns)
    back = max(widths, default=1) + len(lags)
    size = size or max(256, 4 * back)
    of = ["param_id", *params]
    places = {w: i for i, w in enumerate(widths)}
    literal = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")
    table = literal([{"param_id": i, **c, **{f"{k}_at": places[v] for k, v in c.items()}} for i, c in enumerate(combos)], f"struct<{', '.join(f'{c}:int' for c in [*of, *[f'{c}_at' for c in params]])}>")
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def arrays(cut: DataFrame) -> DataFrame:
        so_far = Window.partitionBy(KEY).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
        # a number of tasks is given: few bytes of bars become many rows
        summed = cut.repartition(tasks, KEY).withColumns({"_sum": F.sum(F.round(F.col("close") * 1_000_000).cast("long")).over(so_far), "_many": F.count("close").over(so_far)})
        one = F.struct(F.col(AT).alias("at"), F.col(TIME).alias("time"), "close", F.col("_sum").alias("sum"), F.col("_many").alias("many"), F.col("_own").alias("own"))
        return summed.groupBy(KEY).agg(F.sort_array(F.collect_list(one)).alias("_rows")).withColumn("_own", F.lit(True))

    held = over_slices(numbered(bars.select(KEY, TIME, F.col("close").cast("double").alias("close"))), arrays, back, size)
    rows = F.col("_rows")

    def row(x: Column) -> Column:
        here = (x["at"] - F.get(rows, F.lit(0))["at"]).cast("int")

        def given(w: Column) -> Column:
            upto = lambda name, i: F.coalesce(F.get(rows, i)[name], F.lit(0).cast("long"))
            made = {"close": lambda b: F.get(rows, here - b - w)["close"], "sum": lambda b: upto("sum", here - b) - upto("sum", here - b - w), "many": lambda b: upto("many", here - b) - upto("many", here - b - w)}
            return F.struct(*[made[g](b).alias(f"{g}{b}") for g in how.gives for b in lags])

        closes = [F.get(rows, here - b)["close"].alias(f"_close{b}") for b in lags]
        return F.struct(x["time"].alias("_time"), (x["at"] + 1).alias("_number"), *closes, F.transform(literal(widths, "int"), given).alias("_widths"))

    each = held.select(KEY, F.explode(F.transform(F.filter(rows, lambda x: x["own"]), row)).alias("_x")).select(KEY, "_x.*", F.explode(table).alias("_p"))

    def signal(back: int) -> Column:
        buy, sell = how.decide(Reader(back), F.col("_p"))
        return F.when(buy, "buy").when(sell, "sell").otherwise("hold")

    out = each.withColumn("signal", signal(0))
    if turns:
        first = (F.col("_number") - 1) % size == 0
        out = out.filter(F.col("signal") != "hold").filter(first | (signal(1) != F.col("signal")))
    return out.select(KEY, F.col("_time").alias(TIME), F.col("_close0").alias("close"), *[f"_p.{c}" for c in of], "signal")
