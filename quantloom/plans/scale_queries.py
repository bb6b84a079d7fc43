"""Queries of the forms for long symbols, wide windows and stores, each with its SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import backtest
from ..operators.grid import signal_grid
from ..operators.long_symbols import long_indicators, long_rolling
from ..scratch import folder
from ..sources.bar_store import BarStore
from ..sources.bars import bars_hour, bars_tick, bars_week
from ..sources.day_file import read_day_files, write_day_files
from ..windows import lag as lag_of
from ..windows import mean, total
from .indicator_queries import rounded
from .sqltext import BARS_HOUR, BARS_TICK, BARS_WEEK, NUDGE, ewm, lag, last, so_far, staged

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LONG = "ma60 macd macd_signal rsi14 expma50 mb20 up20 psy12 roc12 obv mcst mcst_ma12 cyc13 cyc_inf".split()
_vwap = lambda over: f"coalesce({over('sum(close * volume)')} / nullif({over('sum(volume)')}, 0), close)"
QUERIES["indicators_long"] = lambda spark, sf_dir: rounded(long_indicators(bars_tick(spark, sf_dir), ["ma", "macd", "rsi", "expma", "boll", "psy", "roc", "obv", "mcst", "cyc"], size=500), *_LONG)
SQL["indicators_long"] = staged([
    {"ma60": last("avg(close)", 60), "macd": f"{ewm('close', 12)} - {ewm('close', 26)}", "ch": f"coalesce(close - {lag('close')}, 0)", "expma50": ewm("close", 50), "mb20": last("avg(close)", 20), "sd": last("stddev_samp(close)", 20), "p": lag("close"), "roc12": f"(close - {lag('close', 12)}) * 100 / nullif({lag('close', 12)}, 0)", "sg": f"CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END", "mcst": f"coalesce({so_far('sum(amount)')} / nullif({so_far('sum(volume)')}, 0), 0)", "cyc13": _vwap(lambda e: last(e, 13)), "cyc_inf": _vwap(so_far)},
    {"macd_signal": ewm("macd", 9), "up20": "mb20 + 2 * sd", "g": "greatest(ch, 0)", "l": "greatest(-ch, 0)", "obv": so_far("sum(sg)"), "mcst_ma12": last("avg(mcst)", 12), "psy12": f"{last('sum(CASE WHEN close > p THEN 1.0::DOUBLE ELSE 0 END)', 12)} / 12 * 100"},
    {"eg": ewm("g", 14), "el": ewm("l", 14)}, {"rsi14": "CASE WHEN el = 0 THEN 100 ELSE 100 - 100 / (1 + eg / nullif(el, 0)) END"},
], _LONG, bars=BARS_TICK)

_WIDE = [f"{c}_{n}" for n in (20, 300, 700) for c in ("high", "low", "mean")]
QUERIES["rolling_wide"] = lambda spark, sf_dir: rounded(long_rolling(bars_tick(spark, sf_dir), (20, 300, 700)), *_WIDE)
SQL["rolling_wide"] = staged([{f"{a}_{n}": last(e, n) for n in (20, 300, 700) for a, e in (("high", "max(high)"), ("low", "min(low)"), ("mean", "avg(close)"))}], _WIDE, bars=BARS_TICK)


def day_files(spark, sf_dir):
    """Weekly bars of all suppliers written as .day files, of which two years are read back."""
    path = f"{folder(spark)}/day-{uuid.uuid4().hex}"
    write_day_files(bars_week(spark, sf_dir), path)
    read = read_day_files(spark, path, low=dt.date(1994, 7, 1), high=dt.date(1996, 6, 30))
    return read.select("symbol", "date", "open", "close", F.col("volume").cast("long").alias("volume"), F.col("amount").cast("long").alias("amount"))


QUERIES["day_files"] = day_files
SQL["day_files"] = f"""SELECT CAST(symbol AS VARCHAR) AS symbol, date, floor(open * 100 + 0.5 + 1.37e-8) / 100 AS open, floor(close * 100 + 0.5 + 1.37e-8) / 100 AS close,
  CAST(floor(volume + 1.37e-8) AS BIGINT) AS volume, CAST(floor(amount + 1.37e-8) AS BIGINT) AS amount FROM ({BARS_WEEK}) WHERE date BETWEEN DATE '1994-07-01' AND DATE '1996-06-30'"""


def bar_store(spark, sf_dir):
    """Weekly bars of all suppliers in a store: loaded, then revised in 1995 and added to in 1996 by a batch that is given twice;
    three years are read back under windows."""
    bars = bars_week(spark, sf_dir)
    name = f"bars_{uuid.uuid4().hex}"
    store = BarStore.create(spark, name, bars.schema, f"{folder(spark)}/{name}", buckets=16)
    store.upsert(bars, "load")
    dearer = bars.filter((F.year("date") == 1995) & (F.col("symbol") % 2 == 0)).withColumns({c: F.col(c) * 2 for c in ("open", "high", "low", "close")})
    more = bars.filter((F.year("date") == 1996) & (F.col("symbol") % 10 == 0)).withColumn("symbol", -1 - F.col("symbol"))
    for _ in range(2):
        store.upsert(dearer.unionByName(more), "revision")
    df = store.read(dt.date(1994, 1, 1), dt.date(1996, 12, 31))
    return rounded(df.withColumns({"mean8": mean("close", 8), "change": F.col("close") - lag_of("close"), "total": total("volume", 12)}), "close", "mean8", "change", "total")


QUERIES["bar_store"] = bar_store
SQL["bar_store"] = staged([{"mean8": last("avg(close)", 8), "change": f"close - {lag('close')}", "total": last("sum(volume)", 12)}], ["close", "mean8", "change", "total"], bars=f"""
  WITH loaded AS ({BARS_WEEK}) SELECT symbol, date, close * CASE WHEN year(date) = 1995 AND symbol % 2 = 0 THEN 2 ELSE 1 END AS close, volume FROM loaded WHERE year(date) BETWEEN 1994 AND 1996
  UNION ALL SELECT -1 - symbol, date, close, volume FROM loaded WHERE year(date) = 1996 AND symbol % 10 = 0""")

_GRID = {"short": list(range(2, 22)), "long": list(range(25, 75))}


def grid_wide(spark, sf_dir):
    """A thousand combinations of two means on hourly bars: trades, costs and the capital after the last sale of each."""
    done = backtest.trades(signal_grid(bars_hour(spark, sf_dir), "ma_state", _GRID, turns=True))
    sums = done.groupBy("symbol", "param_id").agg(F.count("*").alias("n_trades"), F.sum("cost").alias("cost"), F.max_by(F.when(F.col("signal") == "sell", F.col("capital")), F.when(F.col("signal") == "sell", F.col("trade"))).alias("capital"))
    return rounded(sums, "cost", "capital", keys=("symbol", "param_id", "n_trades"), digits=2)


QUERIES["grid_wide"] = grid_wide
SQL["grid_wide"] = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT symbol, date, close, CAST(round(close * 1000000) AS BIGINT) AS c, row_number() OVER w AS i FROM ({BARS_HOUR}) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
sums AS MATERIALIZED (SELECT symbol, i, sum(c) OVER (PARTITION BY symbol ORDER BY i) AS s FROM b UNION ALL SELECT DISTINCT symbol, 0, 0 FROM b),
means AS MATERIALIZED (SELECT b.symbol, b.i, n, CAST(s.s - t.s AS HUGEINT) AS s FROM b CROSS JOIN range(2, 75) r(n) JOIN sums s ON s.symbol = b.symbol AND s.i = b.i JOIN sums t ON t.symbol = b.symbol AND t.i = greatest(b.i - n, 0)),
sides AS (SELECT b.symbol, b.date, b.close AS price, CAST((y.n - 25) + (x.n - 2) * 50 AS INTEGER) AS param_id, sign(x.s * least(b.i, y.n) - y.s * least(b.i, x.n)) AS side
  FROM b JOIN means x ON x.symbol = b.symbol AND x.i = b.i AND x.n BETWEEN 2 AND 21 JOIN means y ON y.symbol = b.symbol AND y.i = b.i AND y.n BETWEEN 25 AND 74 WHERE b.i >= y.n),
turns AS (SELECT *, lag(side) OVER (PARTITION BY symbol, param_id ORDER BY date) AS p FROM sides WHERE side <> 0),
n AS MATERIALIZED (SELECT symbol, param_id, side, price, row_number() OVER (PARTITION BY symbol, param_id ORDER BY date) AS trade FROM (
  SELECT *, max(side) OVER (PARTITION BY symbol, param_id ORDER BY date) AS bought FROM turns WHERE p IS NULL AND side = 1 OR p <> side) WHERE bought = 1),
fold AS (
  SELECT symbol, param_id, trade, side, 100000.0::DOUBLE / price AS shares, 0.0::DOUBLE AS capital, price AS bought, 0.0::DOUBLE AS cost FROM n WHERE trade = 1
  UNION ALL
  SELECT symbol, param_id, trade, side, CASE side WHEN 1 THEN capital / price ELSE shares END, CASE side WHEN 1 THEN 0 ELSE shares * price - paid END, CASE side WHEN 1 THEN price ELSE bought END, CASE side WHEN 1 THEN 0 ELSE paid END
  FROM (SELECT n.*, f.shares, f.capital, f.bought, greatest(f.shares * f.bought * 0.0003, 5) + greatest(f.shares * n.price * 0.0003, 5) + f.shares * n.price * 0.001 + f.shares * (n.price - f.bought) * 0.0001 AS paid
        FROM fold f JOIN n ON n.symbol = f.symbol AND n.param_id = f.param_id AND n.trade = f.trade + 1))
SELECT symbol, param_id, count(*) AS n_trades, round(sum(cost) + {NUDGE}, 2) AS cost, round(arg_max(capital, trade) FILTER (WHERE side = -1) + {NUDGE}, 2) AS capital FROM fold GROUP BY symbol, param_id"""
