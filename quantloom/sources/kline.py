"""One reader of bars: universe, symbols, dates and price adjustment in a single call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.adjust import apply_factors, swap_prices, with_adjusted_prices
from ..windows import KEY, TIME


def valid_code(code: Column) -> Column:
    """Whether a six-digit exchange code is one of a listed stock, index or fund; false for null."""
    c, n = code.cast("string"), code.try_cast("int")
    starts = lambda *p: c.rlike(f"^({'|'.join(p)})")
    main = (
        F.when(starts("900", "200"), False).when(starts("000"), True).when(starts("6"), n.between(600000, 603999) | n.between(688000, 688999))
        .when(starts("399"), True).when(starts("0", "3"), n.between(0, 2999) | n.between(300000, 300999)).when(starts("8"), True)
        .when(starts("92"), n.between(920000, 920999)).otherwise(starts("51", "58", "15", "16"))
    )
    return F.coalesce(c.rlike(r"^[0-9]{6}$") & main, F.lit(False))


def universe(codes: DataFrame, code: str = "code") -> DataFrame:
    """Rows with a valid code, each code once."""
    return codes.filter(valid_code(F.col(code))).dropDuplicates([code])


def kline(daily: DataFrame, factors: DataFrame | None = None, symbols: list | None = None, start=None, end=None, adjust: str = "none") -> DataFrame:
    """Bars of the symbols between two dates (both included) with qfq_* and hfq_* prices and factors; open to close are those
    of `adjust` (none, qfq or hfq). Filters stay on plain columns, so that they reach the scan, and on both sides of the join.
    A row without a factor takes the last one of the symbol within the dates, else 1; without a factor table all are 1."""
    if adjust not in ("none", "qfq", "hfq"):
        raise ValueError(f"unknown adjustment {adjust}")

    def cut(df: DataFrame) -> DataFrame:
        df = df if symbols is None else df.filter(F.col(KEY).isin(symbols))
        df = df if start is None else df.filter(F.col(TIME) >= start)
        return df if end is None else df.filter(F.col(TIME) <= end)

    if factors is None:
        out = with_adjusted_prices(cut(daily).withColumns({"qfq_factor": F.lit(1.0), "hfq_factor": F.lit(1.0)}))
    else:
        out = apply_factors(cut(daily), cut(factors), fill=True)
    return swap_prices(out, adjust)
