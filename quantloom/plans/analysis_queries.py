"""Queries of the factor analysis, the bar reader, orders, and the helpers of text, dates and universes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjust, backtest, costs, factor_analysis, market, performance, prep
from ..sources.bars import bars_hour, bars_week, dividends_of, stock_basic, table
from ..sources.kline import kline, valid_code
from ..windows import lag as lagged
from ..windows import ratio
from ..windows import so_far as frame
from .indicator_queries import rounded
from .market_queries import _BASIC, _EQUITY, _EVENTS, _GAPS, _gaps, _OHLC, _r, _trades
from .sqltext import BARS_HOUR, BARS_WEEK, NUDGE, ewm, lag, last, so_far, staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


# ---- plain factors and their test


def _full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN {last(f'count({c})', n)} = {n} THEN {last(f'{agg}({c})', n)} END"


_STAGES = [
    {"macd": f"{ewm('close', 12)} - {ewm('close', 26)}", "p": lag("close"), "tp": "(high + low + close) / 3", "lo9": _full("min", "low", 9), "hi9": _full("max", "high", 9), "lo14": _full("min", "low", 14), "hi14": _full("max", "high", 14), "boll_mid": _full("avg", "close", 20), "s20": _full("stddev_samp", "close", 20)}
    | {f"ma{n}": _full("avg", "close", n) for n in (5, 10, 60)} | {f"mom{k}m": f"(close - {lag('close', n)}) / nullif({lag('close', n)}, 0)" for k, n in ((1, 20), (3, 60), (6, 120), (12, 240))},
    {"macd_signal": ewm("macd", 9), "g": "CASE WHEN p IS NOT NULL THEN greatest(close - p, 0) END", "l": "CASE WHEN p IS NOT NULL THEN greatest(p - close, 0) END", "tr": "CASE WHEN p IS NULL THEN high - low ELSE greatest(high - low, abs(high - p), abs(low - p)) END", "rsv": "(close - lo9) / (hi9 - lo9 + 1e-10) * 100", "wr": "(hi14 - close) / (hi14 - lo14 + 1e-10) * 100", "tm": _full("avg", "tp", 14), "ret": "(close - p) / nullif(p, 0)"},
    {"macd_hist": "macd - macd_signal", "rsi": f"100 - 100 / (1 + {_full('avg', 'g', 14)} / ({_full('avg', 'l', 14)} + 1e-10))".replace("CASE", "(CASE").replace("END", "END)"), "boll_upper": "boll_mid + 2 * s20", "boll_lower": "boll_mid - 2 * s20", "kdj_k": ewm("rsv", 3), "atr": _full("avg", "tr", 14), "dev": "abs(tp - tm)"},
    {"kdj_d": ewm("kdj_k", 3), "cci": f"(tp - tm) / nullif(({_full('avg', 'dev', 14)}) * 0.015, 0)"},
    {"kdj_j": "3 * kdj_k - 2 * kdj_d"},
]
_COLUMNS = "macd macd_signal macd_hist rsi boll_mid boll_upper boll_lower kdj_k kdj_d kdj_j ma5 ma10 ma60 atr wr cci mom1m mom3m mom6m mom12m".split()
_add("analysis_factors", lambda s, d: rounded(factor_analysis.with_factors(bars_hour(s, d)), *_COLUMNS), staged(_STAGES, _COLUMNS))

_TESTED = ["rsi", "atr", "kdj_k", "mom1m", "factor_combination"]


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_analysis.combine(factor_analysis.with_factors(bars_hour(spark, sf_dir), ["rsi", "atr", "kdj", "mom1m"]), _TESTED[:-1])


_TABLE = staged(_STAGES, ["close"]).split("\nSELECT symbol")[0] + ", c AS (SELECT *, " + " + ".join(f"coalesce({c}, 0)" for c in _TESTED[:-1]) + " AS factor_combination FROM s5)"
_CORR = "covar_pop({0}, {1}) / nullif(stddev_pop(CASE WHEN {1} IS NOT NULL THEN {0} END) * stddev_pop(CASE WHEN {0} IS NOT NULL THEN {1} END), 0)"
_add("analysis_validity", lambda s, d: rounded(factor_analysis.validity(_combined(s, d), _TESTED), "ic", "long_return", "short_return", "long_short_return", keys=("symbol", "factor", "n")), f"""{_TABLE},
l AS ({' UNION ALL '.join(f"SELECT symbol, '{c}' AS factor, {c} AS x, ret AS y FROM c WHERE {c} IS NOT NULL AND ret IS NOT NULL" for c in _TESTED)}),
e AS (SELECT symbol, factor, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e, count(*) AS n, {_CORR.format('x', 'y')} AS ic FROM l GROUP BY symbol, factor),
b AS (SELECT symbol, factor, n, ic, (e[1] < x)::INT + (e[2] < x)::INT + (e[3] < x)::INT + (e[4] < x)::INT AS b, y FROM l JOIN e USING (symbol, factor)),
m AS (SELECT symbol, factor, n, ic, b, avg(y) AS m FROM b GROUP BY ALL),
q AS (SELECT symbol, factor, n, ic, arg_max(m, b) AS long_return, arg_min(m, b) AS short_return FROM m GROUP BY ALL)
SELECT symbol, factor, n, {_r('ic', 'long_return', 'short_return')}, round(long_return - short_return + {NUDGE}, 6) AS long_short_return FROM q""")
_add("analysis_correlation", lambda s, d: rounded(factor_analysis.factor_correlations(_combined(s, d), _TESTED), "r", keys=("symbol", "a", "b")), _TABLE + " " + " UNION ALL ".join(f"SELECT symbol, '{a}' AS a, '{b}' AS b, round({_CORR.format(a, b)} + {NUDGE}, 6) AS r FROM c GROUP BY symbol" for i, a in enumerate(_TESTED) for b in _TESTED[i:]))

# ---- the bar reader


def _kline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors are known on every fifth hour only and filled forward."""
    daily = bars_hour(spark, sf_dir)
    known = daily.filter(F.hour("date") % 5 == 2).select("symbol", "date", (1 / F.col("high")).alias("qfq_factor"), F.col("low").alias("hfq_factor"))
    return rounded(kline(daily, known, start=F.lit("2024-01-02").cast("timestamp_ntz"), adjust="qfq"), *_OHLC, "hfq_close", "qfq_factor", "hfq_factor")


_add("kline_range", _kline, f"""WITH b AS (SELECT * FROM ({BARS_HOUR}) WHERE date >= TIMESTAMP '2024-01-02'),
k AS (SELECT *, CASE WHEN hour(date) % 5 = 2 THEN 1 / high END AS q, CASE WHEN hour(date) % 5 = 2 THEN low END AS h FROM b),
f AS (SELECT *, coalesce({so_far('last_value(q IGNORE NULLS)')}, 1) AS qfq_factor, coalesce({so_far('last_value(h IGNORE NULLS)')}, 1) AS hfq_factor FROM k)
SELECT symbol, date, {', '.join(f'round({c} * qfq_factor + {NUDGE}, 6) AS {c}' for c in _OHLC)}, round(close * hfq_factor + {NUDGE}, 6) AS hfq_close, {_r('qfq_factor', 'hfq_factor')} FROM f""")
_add("apply_known_factors", lambda s, d: rounded(adjust.apply_factors(bars_hour(s, d), bars_hour(s, d).filter("volume > 5").select("symbol", "date", F.col("volume").alias("qfq_factor"), F.col("open").alias("hfq_factor"))), "qfq_close", "hfq_close"), f"SELECT symbol, date, round(close * CASE WHEN volume > 5 THEN volume ELSE 1 END + {NUDGE}, 6) AS qfq_close, round(close * CASE WHEN volume > 5 THEN open ELSE 1 END + {NUDGE}, 6) AS hfq_close FROM ({BARS_HOUR})")
_add("adj_live_factor", lambda s, d: rounded(adjust.with_event_factors(bars_hour(s, d), dividends_of(bars_hour(s, d)), live=True), "factor", keys=("symbol", "ex_date")), f"WITH {_EVENTS} SELECT symbol, ex_date, round(CASE WHEN p0 > 0 AND cash_div < p0 THEN (p0 - cash_div) / (p0 * (1 + share_div)) END + {NUDGE}, 6) AS factor FROM factors")

_CODES = "SELECT o_orderkey, lpad(CAST((o_orderkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS code FROM orders"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(((F.col("o_orderkey").cast("long") * 7919) % 1000000).cast("string"), 6, "0").alias("code"))


_add("code_validity", lambda s, d: _codes(s, d).select("o_orderkey", "code", valid_code(F.col("code")).alias("valid"), market.board(F.col("code")).alias("board")), f"""SELECT o_orderkey, code,
CASE WHEN code[1:3] IN ('900', '200') THEN false WHEN code[1:3] IN ('000', '399') THEN true WHEN code[1] = '6' THEN code[1:3] IN ('600', '601', '602', '603', '688') WHEN code[1] IN ('0', '3') THEN code[1:3] IN ('001', '002', '300') WHEN code[1] = '8' THEN true WHEN code[1:2] = '92' THEN code[3] = '0' ELSE code[1:2] IN ('51', '58', '15', '16') END AS valid,
CASE WHEN code[1:3] IN ('688', '689') THEN 'STAR' WHEN code[1:2] = '60' THEN 'Shanghai main' WHEN code[1:2] = '30' THEN 'ChiNext' WHEN code[1:2] = '00' THEN 'Shenzhen main' WHEN code[1] IN ('4', '8') OR code[1:2] = '92' THEN 'Beijing' WHEN code[1] = '5' OR code[1:2] IN ('15', '16', '18') THEN 'fund' ELSE 'other' END AS board FROM ({_CODES})""")

# ---- orders, sensitivity, drawdown


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's close against orders around the symbol's first close; a stop-limit order stays triggered."""
    first = F.first("close").over(frame())
    df = bars_hour(spark, sf_dir).withColumns({"limit": first * 0.99, "stop": first * 1.02})
    df = df.withColumn("_t", F.max(costs.stop_reached("buy", F.col("close"), F.col("stop"))).over(frame()))
    close, limit, stop = F.col("close"), F.col("limit"), F.col("stop")
    fills = {"buy_limit": costs.order_fills("limit", "buy", close, limit), "sell_limit": costs.order_fills("limit", "sell", close, limit), "buy_stop": costs.order_fills("stop", "buy", close, stop=stop), "sell_stop": costs.order_fills("stop", "sell", close, stop=stop), "buy_stop_limit": costs.order_fills("stop_limit", "buy", close, limit, stop, F.col("_t"))}
    return df.select("symbol", "date", *[c.alias(n) for n, c in fills.items()])


_add("order_fills", _orders, f"""WITH f AS (SELECT *, {so_far('first_value(close)')} AS p FROM ({BARS_HOUR})), t AS (SELECT *, {so_far('max(close)')} >= p * 1.02 AS reached FROM f)
SELECT symbol, date, close <= p * 0.99 AS buy_limit, close >= p * 0.99 AS sell_limit, close >= p * 1.02 AS buy_stop, close <= p * 1.02 AS sell_stop, reached AND close <= p * 0.99 AS buy_stop_limit FROM t""")


def _sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's equity of one strategy, its symbol's length standing for the parameter."""
    metrics = performance.performance(backtest.equity(*_trades(spark, sf_dir))).withColumn("width", F.length("symbol").cast("double"))
    return rounded(backtest.sensitivity(metrics, ["width"]), "r", "deviation", keys=("param", "metric"))


_METRICS = ("total_return", "sharpe_ratio", "max_drawdown")
_add("sensitivity", _sensitivity, f"""{_EQUITY},
x AS (SELECT *, lag(equity) OVER (PARTITION BY symbol ORDER BY date) AS p, max(equity) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM equity),
m AS (SELECT CAST(length(symbol) AS DOUBLE) AS width, (arg_max(equity, date) / arg_min(equity, date) - 1) * 100 AS total_return, CASE WHEN stddev_pop(equity / nullif(p, 0) - 1) > 0 THEN avg(equity / nullif(p, 0) - 1) / stddev_pop(equity / nullif(p, 0) - 1) * sqrt(252) ELSE 0 END AS sharpe_ratio, max((peak - equity) / peak * 100) AS max_drawdown FROM x GROUP BY symbol)
{' UNION ALL '.join(f"SELECT 'width' AS param, '{m}' AS metric, round({_CORR.format('width', m)} + {NUDGE}, 6) AS r, round(stddev_pop({m}) + {NUDGE}, 6) AS deviation FROM m" for m in _METRICS)}""")
_add("drawdown_curve", lambda s, d: rounded(performance.drawdown_curve(backtest.equity(*_trades(s, d))), "equity", "drawdown", digits=4), f"{_EQUITY} SELECT symbol, date, round(equity + {NUDGE}, 4) AS equity, round((max(equity) OVER w - equity) * 100 / max(equity) OVER w + {NUDGE}, 4) AS drawdown FROM equity WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)")


def _against_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alpha, beta and information ratio against the mean close-to-close return of all symbols at the hour."""
    equity = backtest.equity(*_trades(spark, sf_dir))
    moved = bars_hour(spark, sf_dir).withColumn("_m", ratio(F.col("close") - lagged("close"), lagged("close")))
    mean = moved.groupBy("date").agg(F.avg("_m").alias("m"))
    return rounded(performance.advanced(equity, market=mean), "beta", "alpha", "information_ratio", keys=("symbol",))


_add("performance_against_market", _against_market, f"""{_EQUITY},
x AS (SELECT symbol, date, (equity - {lag('equity')}) / nullif({lag('equity')}, 0) AS r FROM equity),
mk AS (SELECT date, avg(v) AS m FROM (SELECT date, (close - {lag('close')}) / nullif({lag('close')}, 0) AS v FROM bars) GROUP BY date),
j AS (SELECT symbol, covar_samp(r, m) / nullif(var_pop(m), 0) AS beta, avg(r) AS ar, avg(m) AS am, avg(r - m) AS d, stddev_pop(r - m) AS sd FROM x LEFT JOIN mk USING (date) GROUP BY symbol)
SELECT symbol, round(beta + {NUDGE}, 6) AS beta, round((ar - 0.02 / 252 - beta * (am - 0.02 / 252)) * 252 + {NUDGE}, 6) AS alpha, round(coalesce(d * sqrt(252) / nullif(sd, 0), 0) + {NUDGE}, 6) AS information_ratio FROM j""")

# ---- universes, text and dates


def _blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = stock_basic(spark, sf_dir).select("symbol", "name", "industry")
    old = new.select((F.col("symbol") + 3).alias("symbol"), F.when(F.length("name") % 2 == F.col("symbol") % 2, " ").otherwise(F.upper("name")).alias("name"), F.lit(None).cast("string").alias("industry"))
    return market.fill_blanks(old, new)


_add("fill_blanks", _blanks, f"""WITH n AS (SELECT symbol, name, industry FROM ({_BASIC})), o AS (SELECT symbol + 3 AS symbol, CASE WHEN length(name) % 2 = symbol % 2 THEN ' ' ELSE upper(name) END AS name FROM n)
SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(nullif(trim(o.name), ''), n.name) AS name, n.industry FROM n FULL JOIN o USING (symbol)""")
_add("list_date_backfill", lambda s, d: market.backfill_list_date(stock_basic(s, d).select("symbol", F.when(F.length("industry") > 6, F.lit("2001-02-03").cast("date")).alias("list_date")), bars_week(s, d)), f"WITH f AS (SELECT symbol, min(date) AS first FROM ({BARS_WEEK}) GROUP BY symbol) SELECT b.symbol, CASE WHEN length(industry) > 6 THEN DATE '2001-02-03' ELSE first END AS list_date FROM ({_BASIC}) b LEFT JOIN f USING (symbol)")


def _helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order comments and dates written in turn in four ways."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    text = F.when(k == 0, F.lit(" -- ")).when(k == 1, F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).when(k == 2, F.lit("NaN")).otherwise(F.col("o_orderpriority"))
    date = F.when(k == 0, F.date_format(day, "yyyyMMdd")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.lit("soon"))
    rights = F.when(k == 0, F.lit("10:3")).when(k == 1, F.lit("0.5")).when(k == 2, F.lit("10：2.5")).otherwise(F.lit("none"))
    return table(spark, sf_dir, "orders").select("o_orderkey", market.normalise_text(text, 8).alias("text"), market.normalise_date(date).alias("day"), adjust.rights_ratio(rights).alias("rights_ratio"))


_add("text_and_dates", _helpers, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 3) THEN o_orderpriority[1:8] END AS text, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day, CASE o_orderkey % 4 WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.25::DOUBLE END AS rights_ratio FROM orders")

# ---- preparation


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.fill(_gaps(spark, sf_dir), "mean"), "close")


_add("fill_mean", _filled, f"SELECT symbol, date, round(coalesce(close, avg(close) OVER (PARTITION BY symbol)) + {NUDGE}, 6) AS close FROM ({_GAPS})")


def _not_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = bars_hour(spark, sf_dir).withColumn("close", F.when(F.hour("date") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("close")))
    cast = prep.convert_types(prep.nan_to_zero(odd), "long", ("volume",))
    return rounded(cast, "close", keys=("symbol", "date", "volume"))


_add("types_and_nans", _not_numbers, f"SELECT symbol, date, CAST(volume AS BIGINT) AS volume, round(CASE WHEN hour(date) % 3 = 0 THEN 0 ELSE close END + {NUDGE}, 6) AS close FROM ({BARS_HOUR})")
