"""A pipeline of steps as data, folded into one logical plan that Catalyst then optimises as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rolling import shared_rolling  # noqa: F401


def _column(c):
    return F.expr(c) if isinstance(c, str) else c


STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "filter": lambda df, s: df.filter(s["condition"]),
    "select": lambda df, s: df.select(*map(_column, s["columns"])),
    "with_columns": lambda df, s: df.withColumns({k: _column(v) for k, v in s["columns"].items()}),
    "group_by": lambda df, s: df.groupBy(*s["by"]).agg(*[_column(v).alias(k) for k, v in s["aggs"].items()]),
    "sort": lambda df, s: df.orderBy(*s["by"], ascending=not s.get("descending", False)),
    "join": lambda df, s: df.join(s["right"], s["on"], s.get("how", "inner")),
    "limit": lambda df, s: df.limit(s["n"]),
    "transform": lambda df, s: s["run"](df),
}


def run_steps(df: DataFrame, steps: Iterable[dict]) -> DataFrame:
    """Fold steps such as {"op": "filter", "condition": "close > 1"} over df."""

    def one(frame: DataFrame, step: dict) -> DataFrame:
        if step["op"] not in STEPS:
            raise ValueError(f"no step {step['op']!r}; there are {', '.join(STEPS)}")
        return STEPS[step["op"]](frame, step)

    return reduce(one, steps, df)


def compose(*functions: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: reduce(DataFrame.transform, functions, df)
