"""Backtests: all in on a buy, all out on a sell, at the close; costs are taken from the sale.

Windows find the trades (a buy while flat, a sell while invested: signals other than hold that differ from the one before).
Capital compounds with a least commission, which is a recursion, but over a symbol's trades only; it runs in one Arrow group
a symbol and parameter set. Equity is the trades joined back to the bars and carried forward.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..windows import KEY, TIME, corr
from .costs import MARKETS


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("param_id", KEY) if c in df.columns]


def trades(signals: DataFrame, capital: float = 100_000.0, market: str = "plain") -> DataFrame:
    """Keys, date, signal, price, shares, capital (after the trade), cost, trade (from 1), paid for each trade."""
    keys = _keys(signals)
    at = Window.partitionBy(*keys).orderBy(TIME)
    turns = signals.filter("signal <> 'hold'").withColumn("_p", F.lag("signal").over(at)).filter("(_p is null and signal = 'buy') or _p <> signal")
    # sells before the first buy are no trades
    turns = turns.withColumn("_b", F.max(F.col("signal") == "buy").over(at.rowsBetween(Window.unboundedPreceding, 0))).filter("_b").select(*keys, TIME, "signal", F.col("close").alias("price"))
    rates = MARKETS[market]
    names = [*keys, TIME, "signal", "price", "shares", "capital", "cost", "trade"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME, kind="stable").reset_index(drop=True)
        money, held, bought, out = capital, 0.0, 0.0, []
        for i, (signal, price) in enumerate(zip(pdf["signal"], pdf["price"])):
            if signal == "buy":
                held, bought, money = money / price, price, 0.0
                out.append((held, money, 0.0, i + 1))
            else:
                paid, got = held * bought, held * price
                cost = max(paid * rates["commission"], rates["least"]) + max(got * rates["commission"], rates["least"]) + got * rates["tax"] + held * (price - bought) * rates["slippage"] + (paid + got) * (rates["transfer"] + rates["handling"] + rates["regulatory"])
                money = got - cost
                out.append((held, money, cost, i + 1))
        return pdf.join(pd.DataFrame(out, columns=["shares", "capital", "cost", "trade"]))[names]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema.fields) + ", shares double, capital double, cost double, trade int"
    return turns.groupBy(*keys).applyInPandas(fold, schema)


def equity(bars: DataFrame, done: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Keys, date, equity: shares at the close while invested, the capital otherwise."""
    keys = _keys(bars)
    at = Window.partitionBy(*keys).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    state = done.select(*keys, TIME, F.struct(F.when(F.col("signal") == "buy", F.col("shares")).otherwise(0.0).alias("shares"), "capital").alias("_s"))
    df = bars.select(*keys, TIME, "close").join(state, [*keys, TIME], "left").withColumn("_s", F.last("_s", True).over(at))
    return df.select(*keys, TIME, F.when(F.col("_s.shares") > 0, F.col("_s.shares") * F.col("close")).otherwise(F.coalesce("_s.capital", F.lit(capital))).alias("equity"))


def portfolio_equity(bars: DataFrame, done: DataFrame, n_symbols: int, capital: float = 100_000.0, compat: bool = False) -> DataFrame:
    """date, equity of an equal split over symbols. A symbol without a bar on a date keeps its last value, and its share of
    the cash before its first. compat counts the initial capital on top, as the original engine did."""
    share = capital / n_symbols
    own = equity(bars, done, share)
    delta = own.withColumn("_d", F.col("equity") - F.lag("equity", 1, share).over(Window.partitionBy(KEY).orderBy(TIME)))
    daily = delta.groupBy(TIME).agg(F.sum("_d").alias("_d"))
    # one row a date: the running total is over dates, not bars
    total = F.sum("_d").over(Window.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)) + capital * (2 if compat else 1)
    return daily.select(TIME, total.alias("equity"))


def grid(bars: DataFrame, strategy: Callable[..., DataFrame], params: dict[str, list], keep: Column | None = None) -> DataFrame:
    """Signals of every parameter combination in long form (param_id and the parameters as columns), from one sort of the
    bars: each combination adds columns and one explode turns them into rows."""
    combos = [dict(zip(params, values)) for values in product(*params.values())]
    df = bars
    for i, combo in enumerate(combos):
        df = strategy(df, **combo).withColumnRenamed("signal", f"_signal{i}").drop("position")
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("param_id"), *[F.lit(v).alias(k) for k, v in combo.items()], F.col(f"_signal{i}").alias("signal")) for i, combo in enumerate(combos)])).alias("_g")
    return df.select(KEY, TIME, "close", rows).select(KEY, TIME, "close", "_g.*")


def sensitivity(metrics: DataFrame, params: list[str]) -> DataFrame:
    """param, metric, r (Pearson) and deviation (population) of each metric over a grid's results."""
    pairs = [(p, m) for p in params for m in ("total_return", "sharpe_ratio", "max_drawdown")]
    one = metrics.agg(*[F.struct(corr(p, m).alias("r"), F.stddev_pop(m).alias("deviation")).alias(f"c{i}") for i, (p, m) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.lit(m).alias("metric"), F.col(f"c{i}.r").alias("r"), F.col(f"c{i}.deviation").alias("deviation")) for i, (p, m) in enumerate(pairs)])).alias("p")).select("p.*")


def best(metrics: DataFrame, by: str = "total_return") -> DataFrame:
    """The best parameter set of each symbol: greatest value, least for max_drawdown; ties by param_id."""
    order = F.asc(by) if by == "max_drawdown" else F.desc(by)
    return metrics.withColumn("_n", F.row_number().over(Window.partitionBy(KEY).orderBy(order, "param_id"))).filter("_n = 1").drop("_n")
