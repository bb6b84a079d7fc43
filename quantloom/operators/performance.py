"""Performance of equity curves and trades; one row for each symbol (and parameter set)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..windows import KEY, TIME, ratio

YEAR = math.sqrt(252)


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("param_id", KEY) if c in df.columns]


def round_trips(trades: DataFrame) -> DataFrame:
    """Each buy with the sell that follows: keys, buy_date, sell_date, buy_price, sell_price, shares, profit, cost."""
    keys = _keys(trades)
    at = Window.partitionBy(*keys).orderBy("trade")
    nxt = lambda c: F.lead(c).over(at)
    df = trades.select(*keys, "signal", F.col(TIME).alias("buy_date"), nxt(TIME).alias("sell_date"), F.col("price").alias("buy_price"), nxt("price").alias("sell_price"), "shares", nxt("cost").alias("cost"))
    df = df.filter("signal = 'buy' and sell_date is not null").drop("signal")
    return df.withColumn("profit", (F.col("sell_price") - F.col("buy_price")) * F.col("shares"))


def _with_returns(equity: DataFrame) -> DataFrame:
    at = Window.partitionBy(*_keys(equity)).orderBy(TIME)
    peak = F.max("equity").over(at.rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumns({"r": ratio(F.col("equity") - F.lag("equity").over(at), F.lag("equity").over(at)), "drawdown": ratio((peak - F.col("equity")) * 100, peak)})


def drawdown_curve(equity: DataFrame) -> DataFrame:
    return _with_returns(equity).drop("r")


def performance(equity: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """total_return, annual_return, sharpe_ratio (population deviation), max_drawdown, volatility, all in percent but for the
    ratio; winning_rate, average_profit_loss and trades_count with trades."""
    keys = _keys(equity)
    first, final = F.min(F.struct(TIME, "equity"))["equity"], F.max(F.struct(TIME, "equity"))["equity"]
    sd = F.stddev_pop("r")
    out = _with_returns(equity).groupBy(*keys).agg(
        ((final - first) / first * 100).alias("total_return"), ((F.pow(final / first, F.lit(252.0) / F.count("*")) - 1) * 100).alias("annual_return"),
        F.when(sd > 0, F.avg("r") / F.nullif(sd, F.lit(0.0)) * YEAR).otherwise(0.0).alias("sharpe_ratio"), F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(sd * YEAR * 100, F.lit(0.0)).alias("volatility"),
    )
    if trades is None:
        return out
    gain, loss = F.avg(F.when(F.col("profit") > 0, F.col("profit"))), F.avg(F.when(F.col("profit") <= 0, -F.col("profit")))
    loss = F.coalesce(loss, F.lit(1.0))
    won = round_trips(trades).groupBy(*keys).agg((F.count_if(F.col("sell_price") > F.col("buy_price")) / F.count("*") * 100).alias("winning_rate"), F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / F.nullif(loss, F.lit(0.0))).otherwise(0.0).alias("average_profit_loss"), F.count("*").alias("trades_count"))
    return out.join(won, keys, "left").fillna(0, ["winning_rate", "average_profit_loss", "trades_count"])


def advanced(equity: DataFrame, risk_free: float = 0.02, market: DataFrame | None = None) -> DataFrame:
    """sortino, calmar, downside_risk, recovery (return over drawdown), longest_drawdown (bars under water), sharpe_126 (last
    126 returns); alpha, beta and information_ratio against market (date, m: market return)."""
    keys = _keys(equity)
    df = _with_returns(equity)
    at = Window.partitionBy(*keys).orderBy(TIME)
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(TIME))))
    df = df.withColumn("_top", F.sum(F.when(F.col("drawdown") == 0, 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_under", F.sum(F.when(F.col("drawdown") > 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "_top")))
    if market is not None:
        df = df.join(market.select(TIME, "m"), TIME, "left")
    daily, down = risk_free / 252, F.when(F.col("r") < 0, F.col("r"))
    recent = F.when(F.col("_k") <= 126, F.col("r"))
    first, final, n = F.min(F.struct(TIME, "equity"))["equity"], F.max(F.struct(TIME, "equity"))["equity"], F.count("*")
    annual = (F.pow(final / first, F.lit(252.0) / n) - 1) * 100
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    made: list[Column] = [
        safe((F.avg("r") - daily) * YEAR, F.stddev_pop(down)).alias("sortino"), safe(annual, F.max("drawdown")).alias("calmar"),
        F.coalesce(F.stddev_pop(down) * YEAR * 100, F.lit(0.0)).alias("downside_risk"), safe((final - first) / first * 100, F.max("drawdown")).alias("recovery"),
        F.max("_under").alias("longest_drawdown"), safe((F.avg(recent) - daily) * YEAR, F.stddev_pop(recent)).alias("sharpe_126"),
    ]
    if market is not None:
        beta = F.try_divide(F.covar_samp("r", "m"), F.var_pop("m"))
        made += [beta.alias("beta"), ((F.avg("r") - daily - beta * (F.avg("m") - daily)) * 252).alias("alpha"), safe(F.avg(F.col("r") - F.col("m")) * YEAR, F.stddev_pop(F.col("r") - F.col("m"))).alias("information_ratio")]
    return df.groupBy(*keys).agg(*made)


def trade_statistics(trades: DataFrame) -> DataFrame:
    """profit_factor, expectancy, average_return, average_holding_days and turnover of the round trips."""
    keys = _keys(trades)
    df = round_trips(trades)
    gain, loss = F.sum(F.greatest("profit", F.lit(0.0))), F.sum(F.greatest(-F.col("profit"), F.lit(0.0)))
    days = F.datediff("sell_date", "buy_date")
    return df.groupBy(*keys).agg(F.try_divide(gain, loss).alias("profit_factor"), F.avg("profit").alias("expectancy"), F.avg(ratio(F.col("sell_price") - F.col("buy_price"), "buy_price")).alias("average_return"), F.avg(days).alias("average_holding_days"), F.sum(F.col("shares") * (F.col("buy_price") + F.col("sell_price"))).alias("turnover"))
