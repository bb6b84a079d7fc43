"""Recursions over one symbol's bars that window functions cannot express: one Arrow group a symbol.

A symbol's bars are thousands of rows, so a group is small; only the columns that the recursion reads go to Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..windows import KEY, TIME


def per_symbol(df: DataFrame, fold, inputs: tuple[str, ...], outputs: dict[str, str]) -> DataFrame:
    """df plus outputs (name: type) by fold(frame of inputs in time order) -> dict of arrays."""
    names = [c for c in df.columns if c not in outputs]
    df = df.select(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{k}` {v}" for k, v in outputs.items()])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME, kind="stable").reset_index(drop=True)
        return pdf.assign(**fold(pdf[list(inputs)]))[[*names, *outputs]]

    return df.groupBy(KEY).applyInPandas(run, schema)


def sar_values(high: np.ndarray, low: np.ndarray, close: np.ndarray, step: float, most: float, textbook: bool) -> np.ndarray:
    """A fall is a rise of the mirrored prices, so one rule serves both: `near` and `far` are the side of the stop and the
    side of the extreme, multiplied by the direction. By default the stop is lifted to the last two near prices; the
    textbook holds it below them."""
    n = len(close)
    out = np.full(n, np.nan)
    if n < 2:
        return out
    side = 1 if close[1] > close[0] else -1
    prices = {1: (low, high), -1: (-high, -low)}
    bound = min if textbook else max
    near, far = prices[side]
    stop, extreme, pace = near[0], far[0], step
    out[0] = side * stop
    for i in range(1, n):
        stop = bound(stop + pace * (extreme - stop), near[max(i - 2, 0) : i].min() if textbook else near[max(i - 2, 0) : i].max())
        if near[i] < stop:  # turned: the old extreme becomes the stop
            side = -side
            stop = -extreme
            near, far = prices[side]
            extreme, pace = far[i], step
        elif far[i] > extreme:
            extreme, pace = far[i], min(pace + step, most)
        out[i] = side * stop
    return out


def sar(df: DataFrame, step: float = 0.02, most: float = 0.2, textbook: bool = False) -> DataFrame:
    """Parabolic stop and reverse; null for a symbol with one bar."""
    fold = lambda f: {"sar": pd.Series(sar_values(*(f[c].to_numpy(float) for c in ("high", "low", "close")), step, most, textbook)).astype(object).where(lambda s: s.notna(), None)}
    return per_symbol(df, fold, ("high", "low", "close"), {"sar": "double"})
