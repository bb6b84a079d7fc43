"""Window frames over one symbol's bars, and the few expressions that Spark's functions lack.

Bars of a symbol stay together (Window.partitionBy("symbol")); all indicators asked for in one call share that one shuffle
and sort, since Catalyst puts window expressions of equal partitioning and order over a single exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

KEY, TIME = "symbol", "date"


def w() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def last(n: int) -> WindowSpec:
    """The current row and the n-1 before it."""
    return w().rowsBetween(-(n - 1), 0)


def prior(n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w().rowsBetween(-n, -1)


def so_far() -> WindowSpec:
    return w().rowsBetween(Window.unboundedPreceding, 0)


def row() -> Column:
    return F.row_number().over(w())


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(w())


def mean(c: str | Column, n: int) -> Column:
    return F.avg(c).over(last(n))


def total(c: str | Column, n: int) -> Column:
    return F.sum(c).over(last(n))


def ewm(c: Column | str, span: int) -> Column:
    """Exponentially weighted mean, weights (1 - 2/(span+1))^age, divided by their sum; a native window expression."""
    return InternalFunction.ewm(F.col(c) if isinstance(c, str) else c, 2.0 / (span + 1.0), False).over(w())


def corr(a: Column | str, b: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows that have both; null where either is constant (F.corr raises there under ANSI)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(at(F.covar_pop(x, y)), at(F.stddev_pop(x)) * at(F.stddev_pop(y)))


def ratio(a: Column | str, b: Column | str, otherwise: float | None = None) -> Column:
    """a / b; null, or `otherwise`, where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    q = F.try_divide(a, b)
    return q if otherwise is None else F.when(b == 0, F.lit(otherwise)).otherwise(q)


def quotient(a: Column | str, b: Column | str) -> Column:
    """a / b of doubles as floating point has it: infinite, or NaN for 0 / 0, where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(F.try_divide(a, b))
