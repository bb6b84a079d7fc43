"""Rolling extremes, sums and means whose cost does not grow with the width.

A sliding frame aggregates its rows anew for every row. Here a symbol's rows fall into blocks as long as the window, so that a
window is the end of one block and the beginning of the next: one running aggregate forward in the block, one backward,
and the two meet. Sums are never differences of large sums, so nothing cancels. Narrow windows slide as before."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..windows import KEY, lag, last, row

#: From this width on blocks are cheaper than sliding.
WIDE = 50

_AGGREGATES = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "mean": F.avg}


def _meet(how: str, a: Column, b: Column) -> Column:
    """Both parts of a window; either may be null."""
    if how in ("min", "max"):
        return (F.least if how == "min" else F.greatest)(a, b)
    return F.coalesce(a + b, a, b)


def rolled(df: DataFrame, n: int, made: dict[str, tuple[str, Column | str]], wide: int = WIDE) -> DataFrame:
    """df plus made: name -> (min, max, sum, count or mean; column), over the current row and the n-1 before it. Rows at a
    symbol's beginning use what there is, null values are left out, a window without values gives null (count 0)."""
    if n < wide:
        return df.withColumns({name: _AGGREGATES[how](F.col(c) if isinstance(c, str) else c).over(last(n)) for name, (how, c) in made.items()})
    parts = {}
    for i, (how, c) in enumerate(made.values()):
        for base in ("sum", "count") if how == "mean" else (how,):
            parts[f"_rolled_{base}{i}"] = (base, f"_rolled_c{i}")
    values = {f"_rolled_c{i}": F.col(c) if isinstance(c, str) else c for i, (_, c) in enumerate(made.values())}
    df = df.withColumns({**values, "_rolled_at": row() - 1}).withColumn("_rolled_block", F.floor(F.col("_rolled_at") / n))
    block = Window.partitionBy(KEY, "_rolled_block")
    ahead, back = (block.orderBy(by).rowsBetween(Window.unboundedPreceding, 0) for by in (F.col("_rolled_at"), F.col("_rolled_at").desc()))
    df = df.withColumns({f"{p}_f": _AGGREGATES[how](c).over(ahead) for p, (how, c) in parts.items()})
    df = df.withColumns({f"{p}_b": _AGGREGATES[how](c).over(back) for p, (how, c) in parts.items()})
    whole = F.col("_rolled_at") % n == n - 1  # the window is a block
    df = df.withColumns({p: F.when(whole, F.col(f"{p}_f")).otherwise(_meet(how, lag(f"{p}_b", n - 1), F.col(f"{p}_f"))) for p, (how, _) in parts.items()})
    out = {}
    for i, (name, (how, _)) in enumerate(made.items()):
        out[name] = F.try_divide(f"_rolled_sum{i}", f"_rolled_count{i}") if how == "mean" else F.col(f"_rolled_{how}{i}")
    return df.withColumns(out).drop("_rolled_at", "_rolled_block", *values, *parts, *[f"{p}_{s}" for p in parts for s in "fb"])


def shared_rolling(df: DataFrame, windows: Iterable[int]) -> DataFrame:
    """high_n, low_n and mean_n for each window; narrow ones share one sort, wide ones cost no more than narrow ones."""
    for n in windows:
        df = rolled(df, n, {f"high_{n}": ("max", "high"), f"low_{n}": ("min", "low"), f"mean_{n}": ("mean", "close")})
    return df
