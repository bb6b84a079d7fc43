"""Queries of preparation, adjustment, market lists, signals, costs, backtests and ranking, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import with_indicators
from ..operators import adjust, backtest, costs, market, performance, prep, ranking, search_index, signals, summaries
from ..scratch import folder, written
from ..sources.bars import bars_hour, bars_week, dividends_of, stock_basic, table
from . import pipeline
from .indicator_queries import rounded
from .sqltext import BARS_HOUR, BARS_WEEK, NUDGE, ewm, lag, last, prior, so_far, staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c} + {NUDGE}, {digits}) AS {c.split('.')[-1]}" for c in columns)


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


_OHLCV = ("open", "high", "low", "close", "volume", "amount")
_OHLC = _OHLCV[:4]

# ---- preparation


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_hour(spark, sf_dir)
    return bars.unionAll(bars.withColumn("close", F.col("close") + 1))


_add("preprocess", lambda s, d: rounded(prep.preprocess(_doubled(s, d)), *_OHLCV), f"SELECT symbol, date, {_r(*_OHLCV)} FROM ({BARS_HOUR})")
_add("clean", lambda s, d: rounded(prep.clean(bars_hour(s, d)), *_OHLCV), f"SELECT symbol, date, {_r(*_OHLCV)} FROM ({BARS_HOUR}) WHERE volume > 0")


def _trimmed(low: str, high: str) -> str:
    ctes = [f"t0 AS ({BARS_HOUR})"]
    for n, c in enumerate(_OHLC, 1):
        ctes.append(f"t{n} AS (SELECT t.* FROM t{n - 1} t JOIN (SELECT symbol, {low.format(c=c)} AS lo, {high.format(c=c)} AS hi FROM t{n - 1} GROUP BY symbol) b USING (symbol) WHERE {c} BETWEEN lo AND hi OR lo IS NULL)")
    return "WITH " + ", ".join(ctes) + f" SELECT symbol, date, {_r(*_OHLCV)} FROM t4"


_Q1, _Q3 = "quantile_cont({c}, 0.25)", "quantile_cont({c}, 0.75)"
_add("clean_iqr", lambda s, d: rounded(prep.clean_iqr(bars_hour(s, d), t=1.0), *_OHLCV), _trimmed(f"{_Q1} - ({_Q3} - {_Q1})", f"{_Q3} + ({_Q3} - {_Q1})"))
_add("clean_zscore", lambda s, d: rounded(prep.clean_zscore(bars_hour(s, d), t=2.0), *_OHLCV), _trimmed("avg({c}) - 2 * nullif(stddev_samp({c}), 0)", "avg({c}) + 2 * nullif(stddev_samp({c}), 0)"))


def _late_half(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The bars of the later half of the days, and the merged summaries of these days out of those kept for all days."""
    bars, day = bars_hour(spark, sf_dir), F.col("date").cast("date")
    kept = written(summaries.summarise(bars, day, _OHLC))
    half = F.broadcast(kept.agg(F.date_add(F.min("period"), F.floor(F.date_diff(F.max("period"), F.min("period")) / 2).cast("int")).alias("_half")))
    late = bars.join(half, day >= F.col("_half")).drop("_half")
    return late, summaries.merged(kept.join(half, F.col("period") >= F.col("_half")).drop("_half"))


def _range_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, whole = _late_half(spark, sf_dir)
    return rounded(summaries.clean_iqr(bars, summaries.quantiles(whole.filter("column = 'close'"), bars, [0.25, 0.75]), "close", 0.5), *_OHLC)


def _range_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, whole = _late_half(spark, sf_dir)
    exact = summaries.quantiles(whole, bars, [0.25, 0.5, 0.75]).select("symbol", "column", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "q2", "q3"))])
    return rounded(whole.join(exact, ["symbol", "column"]), "mean", "sd", "q1", "q2", "q3", keys=("symbol", "column", "n", "nulls"))


_LATE = f"b AS ({BARS_HOUR}), d AS (SELECT min(CAST(date AS DATE)) AS lo, max(CAST(date AS DATE)) AS hi FROM b), r AS (SELECT b.* FROM b, d WHERE CAST(date AS DATE) >= lo + CAST(floor((hi - lo) / 2) AS INTEGER))"
_add("clean_iqr_range", _range_clean, f"WITH {_LATE}, q AS (SELECT symbol, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3 FROM r GROUP BY symbol) SELECT symbol, date, {_r(*_OHLC)} FROM r JOIN q USING (symbol) WHERE close BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)")
_add("range_report", _range_report, f"WITH {_LATE}, v AS (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS \"column\", {c} AS v FROM r" for c in _OHLC) + f"), s AS (SELECT symbol, \"column\", count(v) AS n, count(*) - count(v) AS nulls, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY ALL) SELECT symbol, \"column\", n, nulls, {_r('mean', 'sd', 'q1', 'q2', 'q3')} FROM s")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_hour(spark, sf_dir).withColumn("close", F.when(F.hour("date") % 3 != 0, F.col("close")))


_GAPS = BARS_HOUR.replace("SELECT event_type", "SELECT * REPLACE (CASE WHEN hour(date) % 3 <> 0 THEN close END AS close) FROM (SELECT event_type", 1) + ")"
_add("fill_forward", lambda s, d: rounded(prep.fill(_gaps(s, d)), "close"), staged([{"f": so_far("last_value(close IGNORE NULLS)")}, {"g": "f"}], [], _GAPS).split("\nSELECT symbol")[0] + f" SELECT symbol, date, round(g + {NUDGE}, 6) AS close FROM s2")
_add("fill_backward", lambda s, d: rounded(prep.fill(_gaps(s, d), "backward"), "close"), staged([{"g": "first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"}], [], _GAPS).split("\nSELECT symbol")[0] + f" SELECT symbol, date, round(g + {NUDGE}, 6) AS close FROM s1")
_add("quality_report", lambda s, d: prep.quality_report(_gaps(s, d)), f"SELECT count(*) AS n_rows, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS null_{c}' for c in _OHLCV)}, count(*) FILTER (WHERE volume = 0) AS zero_volume FROM ({_GAPS})")


for _name, _to, _part in (("resample_week", "1w", "weekofyear"), ("resample_month", "1m", "month")):
    _sql = f"SELECT symbol, CAST(y AS INTEGER) AS year, CAST(p AS INTEGER) AS part, date, {_r(*_OHLCV)} FROM (SELECT symbol, year(date) AS y, {_part}(date) AS p, min(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, sum(amount) AS amount FROM ({BARS_HOUR}) b GROUP BY symbol, year(b.date), {_part}(b.date))"
    _add(_name, lambda s, d, to=_to: rounded(prep.resample(bars_hour(s, d), to), *_OHLCV, keys=("symbol", "year", "part", "date")), _sql)
_add("sample_uniform", lambda s, d: rounded(prep.sample_uniform(bars_hour(s, d), 100), "close"), f"SELECT symbol, date, round(close + {NUDGE}, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS n, greatest(count(*) OVER (PARTITION BY symbol) // 100, 1) AS step FROM ({BARS_HOUR})) WHERE n % step = 0")
QUERIES["sample_adaptive"] = lambda s, d: rounded(prep.sample_adaptive(bars_hour(s, d), 100), "close")
_add("tail_n", lambda s, d: rounded(prep.tail(with_indicators(bars_hour(s, d), ["ma"]), 30), "ma20"), staged([{"ma20": last("avg(close)", 20), "n": "count(*) OVER (PARTITION BY symbol) - i"}], ["ma20"], where="WHERE n < 30"))
_add("extremes", lambda s, d: rounded(prep.extremes(bars_hour(s, d)), "max_high", "min_low", keys=("symbol", "max_at", "min_at")), f"WITH b AS ({BARS_HOUR}) SELECT symbol, (SELECT min(date) FROM b q WHERE q.symbol = b.symbol AND q.high = max(b.high)) AS max_at, (SELECT min(date) FROM b q WHERE q.symbol = b.symbol AND q.low = min(b.low)) AS min_at, round(max(high) + {NUDGE}, 6) AS max_high, round(min(low) + {NUDGE}, 6) AS min_low FROM b GROUP BY symbol")

# ---- pipelines


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [
        {"op": "filter", "condition": "volume > 10"},
        {"op": "with_columns", "columns": {"spread": "high - low"}},
        {"op": "join", "right": stock_basic(spark, sf_dir), "on": "symbol", "how": "inner"},
        {"op": "group_by", "by": ["area"], "aggs": {"n": "count(*)", "mean_spread": "avg(spread)", "amount": "sum(amount)"}},
        {"op": "sort", "by": ["area"]},
    ]
    return rounded(pipeline.run_steps(bars_week(spark, sf_dir), steps), "mean_spread", "amount", keys=("area", "n"), digits=4)


_BASIC = "SELECT s_suppkey AS symbol, s_name AS name, n_name AS industry, r_name AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_add("pipeline_join_agg", _pipeline, f"SELECT area, count(*) AS n, round(avg(high - low) + {NUDGE}, 4) AS mean_spread, round(sum(amount) + {NUDGE}, 4) AS amount FROM ({BARS_WEEK}) JOIN ({_BASIC}) USING (symbol) WHERE volume > 10 GROUP BY area")
_add("shared_rolling", lambda s, d: rounded(pipeline.shared_rolling(bars_hour(s, d), (10, 20)), "high_10", "low_10", "mean_10", "high_20", "low_20", "mean_20"), staged([{f"{a}_{n}": last(e, n) for n in (10, 20) for a, e in (("high", "max(high)"), ("low", "min(low)"), ("mean", "avg(close)"))}], ["high_10", "low_10", "mean_10", "high_20", "low_20", "mean_20"]))
_add("symbol_filter", lambda s, d: table(s, d, "supplier").filter(F.col("s_name").endswith("7")).select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name")), "SELECT s_suppkey AS symbol, s_name AS name FROM supplier WHERE s_name LIKE '%7'")

# ---- adjustment

_EVENTS = f"""bars AS ({BARS_HOUR}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars),
events AS (SELECT symbol, date AS ex_date, close * 0.01 AS cash_div, 0.1::DOUBLE AS share_div FROM numbered WHERE i % 100 = 0),
factors AS (
  SELECT e.*, (SELECT arg_max(b.close, b.date) FROM bars b WHERE b.symbol = e.symbol AND b.date < e.ex_date) AS p0 FROM events e),
f AS (SELECT *, (p0 - cash_div) / (p0 * (1 + share_div)) AS factor FROM factors)"""


def _factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = bars_hour(spark, sf_dir)
    return bars, adjust.with_event_factors(bars, dividends_of(bars))


_add("adj_event_factor", lambda s, d: rounded(_factors(s, d)[1], "cash_div", "p0", "factor", keys=("symbol", "ex_date")), f"WITH {_EVENTS} SELECT symbol, ex_date, {_r('cash_div', 'p0', 'factor')} FROM f")


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, factors = _factors(spark, sf_dir)
    df = adjust.with_adjusted_prices(adjust.adjustment_factors(bars, factors))
    return rounded(df, "qfq_factor", "hfq_factor", "qfq_close", "hfq_close", "qfq_open", "hfq_open")


_add("adj_prices", _adjusted, f"""WITH {_EVENTS},
a AS (SELECT b.*, coalesce((SELECT product(factor) FROM f WHERE f.symbol = b.symbol AND f.ex_date > b.date AND factor > 0), 1) AS qfq_factor,
             coalesce((SELECT product(1 / factor) FROM f WHERE f.symbol = b.symbol AND f.ex_date <= b.date AND factor > 0), 1) AS hfq_factor FROM bars b)
SELECT symbol, date, {_r('qfq_factor', 'hfq_factor')}, {', '.join(f'round({p} * {k}_factor + {NUDGE}, 6) AS {k}_{p}' for k in ('qfq', 'hfq') for p in ('close', 'open'))} FROM a""")


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = dividends_of(bars_hour(spark, sf_dir), 50)
    rows = ev.select("symbol", "ex_date", "cash_div", "share_div", "rights_issue_price", F.lit(-1.0).alias("rights_issue_ratio"), F.lit(None).cast("int").alias("dividend_year"), F.lit(1).alias("updated_at"), F.lit(1).alias("id"))
    return rows.unionByName(rows.withColumns({"cash_div": -F.col("cash_div"), "updated_at": F.lit(2)}))


_add("dividend_dedupe", lambda s, d: rounded(adjust.clean_dividends(_messy(s, d)), "cash_div", "share_div", "rights_issue_ratio", keys=("symbol", "ex_date", "dividend_year", "id")), f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM ({BARS_HOUR})) SELECT symbol, date AS ex_date, CAST(year(date) AS INTEGER) AS dividend_year, 1 AS id, round({NUDGE}, 6) AS cash_div, round(0.1 + {NUDGE}, 6) AS share_div, CAST(NULL AS DOUBLE) AS rights_issue_ratio FROM n WHERE i % 50 = 0")
_add("ex_date_index", lambda s, d: adjust.bar_index(bars_hour(s, d), dividends_of(bars_hour(s, d))).select("symbol", "ex_date", "bar_index"), f"WITH {_EVENTS} SELECT symbol, date AS ex_date, CAST(i - 1 AS INTEGER) AS bar_index FROM numbered WHERE i % 100 = 0")

# ---- market

_add("market_list", lambda s, d: rounded(market.market_list(bars_week(s, d)), "close", "change", "pct_chg", "amplitude"), f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM ({BARS_WEEK}))
SELECT symbol, date, round(close + {NUDGE}, 6) AS close, round(close - p + {NUDGE}, 6) AS change, round((close - p) * 100 / p + {NUDGE}, 6) AS pct_chg, round((high - low) * 100 / p + {NUDGE}, 6) AS amplitude FROM b WHERE n = 1""")


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stock_basic(spark, sf_dir).select("symbol", "name", "industry")
    other = base.select((F.col("symbol") + 3).alias("symbol"), F.when(F.length("name") % 2 == F.col("symbol") % 2, "  ").otherwise(F.upper("name")).alias("name"), "industry")
    return market.merge_universe(base, other)


_add("universe_merge", _universe, f"""WITH a AS (SELECT * FROM ({_BASIC})), b AS (SELECT symbol + 3 AS symbol, CASE WHEN length(name) % 2 = symbol % 2 THEN '  ' ELSE upper(name) END AS name, industry FROM a)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(nullif(trim(b.name), ''), a.name) AS name, coalesce(nullif(trim(b.industry), ''), a.industry) AS industry FROM a FULL JOIN b USING (symbol)""")
_add("symbol_search", lambda s, d: market.search(stock_basic(s, d), "01").select("symbol", "name"), f"SELECT symbol, name FROM ({_BASIC}) WHERE contains(lower(CAST(symbol AS VARCHAR)), '01') OR contains(lower(name), '01') ORDER BY symbol LIMIT 50")

def _indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code's last two digits, every nation's initials and the first letters of every region, over code, name and initials."""
    basic = stock_basic(spark, sf_dir)
    name = F.concat_ws(" ", "name", "industry")
    fields = {"code": F.lpad(F.col("symbol").cast("string"), 6, "0"), "name": name, "initials": search_index.initials(name)}
    path = f"{folder(spark)}/search-{uuid.uuid4().hex}"
    search_index.write(search_index.postings(basic, "symbol", fields), path)
    texts = F.array(F.right(fields["code"], F.lit(2)), search_index.initials(F.col("industry")), F.substring("area", 1, 3))
    found = search_index.find(search_index.read(spark, path), basic.select(F.explode(texts).alias("text")))
    return found.select("text", F.col("key").alias("symbol"), "fields")


_INITIALS = "upper(regexp_replace(regexp_replace({}, '^[^A-Za-z0-9]+', ''), '([A-Za-z0-9])[A-Za-z0-9]*[^A-Za-z0-9]*', '\\1', 'g'))"
_add("symbol_search_index", _indexed_search, f"""WITH b AS (SELECT symbol, lpad(CAST(symbol AS VARCHAR), 6, '0') AS code, name || ' ' || industry AS name, industry, area FROM ({_BASIC})),
t AS (SELECT upper(right(code, 2)) AS text FROM b UNION SELECT {_INITIALS.format("industry")} FROM b UNION SELECT upper(area[:3]) FROM b),
f AS (SELECT symbol, 'code' AS field, code AS v FROM b UNION ALL SELECT symbol, 'name', upper(name) FROM b UNION ALL SELECT symbol, 'initials', {_INITIALS.format("name")} FROM b)
SELECT text, symbol, string_agg(field, ',' ORDER BY field) AS fields FROM t JOIN f ON contains(v, text) GROUP BY text, symbol QUALIFY row_number() OVER (PARTITION BY text ORDER BY symbol) <= 50""")
_add("frame_compare", lambda s, d: rounded(market.compare(bars_hour(s, d), bars_hour(s, d).withColumn("close", F.col("close") + F.when(F.hour("date") == 0, 0.5).otherwise(0.0)), ["close", "open"]), "max_diff", "mean_diff", keys=("column", "n", "n_over")), f"WITH b AS ({BARS_HOUR}), d AS (SELECT 'close' AS \"column\", CASE WHEN hour(date) = 0 THEN abs(close - (close + 0.5)) ELSE 0 END AS v FROM b UNION ALL SELECT 'open', 0.0 FROM b) SELECT \"column\", count(*) AS n, count(*) FILTER (WHERE v > 0.000001) AS n_over, round(max(v) + {NUDGE}, 6) AS max_diff, round(avg(v) + {NUDGE}, 6) AS mean_diff FROM d GROUP BY 1")
_add("trade_span", lambda s, d: market.trade_span(bars_week(s, d)), f"SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM ({BARS_WEEK}) GROUP BY symbol")
_add("duplicate_keys", lambda s, d: market.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stock_basic(spark, sf_dir)
    return market.upsert(base, base.withColumns({"symbol": F.col("symbol") + 3, "name": F.lower("name")}), ("symbol",))


_add("upsert", _upserted, f"WITH n AS (SELECT symbol + 3 AS symbol, lower(name) AS name, industry, area FROM ({_BASIC})) SELECT * FROM n UNION ALL SELECT * FROM ({_BASIC}) o WHERE symbol NOT IN (SELECT symbol FROM n)")

# ---- signals


def _emit(buy: str, sell: str) -> list[dict[str, str]]:
    return [{"signal": f"CASE WHEN {buy} THEN 'buy' WHEN {sell} THEN 'sell' ELSE 'hold' END"}, {"held": "CASE signal WHEN 'buy' THEN 1 WHEN 'sell' THEN 0 END"}, {"position": f"coalesce({so_far('last_value(held IGNORE NULLS)')}, 0)"}]


def _signal(name: str, run, stages: list[dict[str, str]], buy: str, sell: str) -> None:
    QUERIES[name] = lambda s, d: run(bars_hour(s, d)).select("symbol", "date", "signal", "position")
    SQL[name] = staged(stages + _emit(buy, sell), ["signal!", "position!"])


def _crossing(a: str, b: str) -> dict[str, str]:
    return {"up": f"{a} > {b} AND {lag(a)} <= {lag(b)}", "down": f"{a} < {b} AND {lag(a)} >= {lag(b)}"}


_signal("signal_trend", signals.trend_following, [{"s": last("avg(close)", 10), "l": last("avg(close)", 20)}, _crossing("s", "l")], "i > 20 AND up", "i > 20 AND down")
_signal("signal_meanrev", lambda df: signals.mean_reversion(with_indicators(df, ["rsi"])), [{"ch": f"coalesce(close - {lag('close')}, 0)"}, {"g": "greatest(ch, 0)", "l": "greatest(-ch, 0)"}, {"eg": ewm("g", 14), "el": ewm("l", 14)}, {"rsi": "CASE WHEN el = 0 THEN 100 ELSE 100 - 100 / (1 + eg / nullif(el, 0)) END"}], "rsi < 30", "rsi > 70")
_signal("signal_momentum", signals.momentum, [{"m": f"CASE WHEN i > 12 THEN (close - {lag('close', 12)}) / nullif({lag('close', 12)}, 0) ELSE 0 END"}, {"p": lag("m")}], "i > 12 AND m > 0 AND m > p", "i > 12 AND m < 0 AND m < p")
_signal("signal_breakout", signals.breakout, [{"p": lag("close")}, {"tr": "CASE WHEN p IS NULL THEN 0 ELSE greatest(high - low, abs(high - p), abs(low - p)) END"}, {"a": prior("avg(tr)", 20)}], "i > 20 AND close > p + 2 * a", "i > 20 AND close < p - 2 * a")
_MA = [{"s": last("avg(close)", 5), "l": last("avg(close)", 20)}]
_signal("signal_ma", signals.ma_state, _MA, "i >= 20 AND s > l", "i >= 20 AND s < l")


def _refit(c: str, n: int) -> str:
    a = 2.0 / (n + 1)
    terms = " + ".join(f"{lag(c, n - 1 - k) if k < n - 1 else c} * {((1 - a) ** (n - 1) if k == 0 else a * (1 - a) ** (n - 1 - k))!r}" for k in range(n))
    return f"CASE WHEN i >= {n} THEN {terms} END"


_MACD = [{"fast": _refit("close", 12), "slow": _refit("close", 26)}, {"dd": "fast - slow"}, {"gg": f"CASE WHEN {last('count(dd)', 9)} = 9 THEN {_refit('dd', 9)} END"}, {"up": f"dd > gg AND {lag('dd')} < {lag('gg')}", "down": f"dd < gg AND {lag('dd')} > {lag('gg')}"}]
_signal("signal_macd", signals.macd_state, _MACD, "up", "down")
_GL = [{"ch": f"coalesce(close - {lag('close')}, 0)"}, {"gn": "greatest(ch, 0)", "ls": "greatest(-ch, 0)"}, {"rsi": f"CASE WHEN i > 14 THEN CASE WHEN {last('avg(ls)', 14)} = 0 THEN 100 ELSE 100 - 100 / (1 + {last('avg(gn)', 14)} / nullif({last('avg(ls)', 14)}, 0)) END ELSE 0 END"}]
_signal("signal_multi", signals.multi_factor, _MA + _MACD + _GL + [{"sc": "round(0.3 * CASE WHEN i >= 20 AND s > l THEN 1 WHEN i >= 20 AND s < l THEN -1 ELSE 0 END + 0.4 * CASE WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END + 0.3 * CASE WHEN i > 14 AND rsi < 30 THEN 1 WHEN i > 14 AND rsi > 70 THEN -1 ELSE 0 END, 6)"}], "sc > 0.3", "sc < -0.3")

_STATE = [{"e": f"{ewm('close', 12)} - {ewm('close', 26)}", "ch": f"coalesce(close - {lag('close')}, 0)", "h10": last("max(high)", 10), "l10": last("min(low)", 10), "h14": last("max(high)", 14), "l14": last("min(low)", 14)}, {"g": "greatest(ch, 0)", "l": "greatest(-ch, 0)", "wr": "(h10 - close) * 100 / nullif(h10 - l10, 0)", "rsv": "(close - l14) * 100 / nullif(h14 - l14, 0)"}, {"eg": ewm("g", 14), "el": ewm("l", 14), "k": last("avg(rsv)", 3)}, {"rsi": "CASE WHEN el = 0 THEN 100 ELSE 100 - 100 / (1 + eg / nullif(el, 0)) END", "d": last("avg(k)", 3)}]
_add("signal_score", lambda s, d: rounded(signals.multi_indicator(with_indicators(bars_hour(s, d), ["rsi", "wr", "macd", "kdj"])), "score", keys=("symbol", "signal")), staged(_STATE, ["close"]).split("\nSELECT symbol")[0] + f""",
ends AS (SELECT symbol, arg_max(rsi, date) AS rsi, arg_max(wr, date) AS wr, arg_max(e, date) AS e, max(abs(e)) AS most, arg_max(k, date) AS k, arg_max(d, date) AS d FROM s4 GROUP BY symbol),
scored AS (SELECT symbol, ((rsi - 50) / 50 + (wr - 50) / 50 + e / nullif(most, 0) + (k - d) / 100) * 0.25 AS score FROM ends)
SELECT symbol, CASE WHEN score > 0.3 THEN 'buy' WHEN score < -0.3 THEN 'sell' ELSE 'hold' END AS signal, round(score + {NUDGE}, 6) AS score FROM scored""")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols up to d have factor rows, those up to m adjusted columns in the daily table, the others raw prices."""
    daily = bars_hour(spark, sf_dir)
    made = {"qfq_factor": F.lit(0.5)} | {f"qfq_{p}": F.col(p) * 0.5 for p in _OHLC}
    factors = daily.filter("symbol < 'd'").select("symbol", "date", *[(c / 2).alias(n) for n, c in made.items()])
    daily = daily.withColumns({n: F.when(F.col("symbol") < "m", c) for n, c in made.items()})
    return adjust.adjusted_price(daily, factors)


_FORK = "CASE WHEN symbol < 'd' THEN {0} * 0.25 WHEN symbol < 'm' THEN {0} * 0.5 ELSE {0} END"
_FORKED = f"SELECT symbol, date, {', '.join(f'{_FORK.format(c)} AS {c}' for c in _OHLC)}, CASE WHEN symbol < 'd' THEN 0.25::DOUBLE WHEN symbol < 'm' THEN 0.5::DOUBLE END AS factor, CASE WHEN symbol < 'd' THEN 'factor' WHEN symbol < 'm' THEN 'daily' ELSE 'raw' END AS source FROM ({BARS_HOUR})"
_add("adj_price_query", lambda s, d: rounded(_priced(s, d), *_OHLC, "factor", keys=("symbol", "date", "source")), f"SELECT symbol, date, source, {_r(*_OHLC, 'factor')} FROM ({_FORKED})")
_add("adj_latest_price", lambda s, d: rounded(adjust.latest_price(_priced(s, d)), "close", keys=("symbol", "date", "source")), f"SELECT symbol, max(date) AS date, arg_max(source, date) AS source, round(arg_max(close, date) + {NUDGE}, 6) AS close FROM ({_FORKED}) GROUP BY symbol")
_add("adj_price_change", lambda s, d: rounded(adjust.price_change(_priced(s, d)), "latest_close", "past_close", "change", "pct_change", keys=("symbol",)), f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM ({_FORKED})), two AS (SELECT symbol, max(CASE WHEN k = 1 THEN close END) AS latest_close, max(CASE WHEN k = 20 THEN close END) AS past_close FROM p GROUP BY symbol HAVING count(*) >= 20)
SELECT symbol, {_r('latest_close', 'past_close')}, round(latest_close - past_close + {NUDGE}, 6) AS change, round(coalesce((latest_close - past_close) * 100 / nullif(past_close, 0), 0) + {NUDGE}, 6) AS pct_change FROM two""")
_add("dividend_per_ten", lambda s, d: rounded(adjust.parse_per_ten(bars_hour(s, d).select("symbol", "date", F.col("close").alias("每10股派息"), F.when(F.hour("date") > 5, F.col("volume")).alias("每10股送转"), F.lit(3.0).alias("每10股送股"), F.col("open").cast("string").alias("配股价"))), "cash_div", "share_div", "rights_issue_ratio", "rights_issue_price", "total_div"), f"SELECT symbol, date, round(close / 10 + {NUDGE}, 6) AS cash_div, round(CASE WHEN hour(date) > 5 THEN volume ELSE 3 END / 10 + {NUDGE}, 6) AS share_div, round({NUDGE}, 6) AS rights_issue_ratio, round(open + {NUDGE}, 6) AS rights_issue_price, round({NUDGE}, 6) AS total_div FROM ({BARS_HOUR})")

# ---- costs, backtests, performance


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars_week(spark, sf_dir)
    cn = costs.breakdown(F.lit(1000.0), F.col("open"), F.col("close"), "cn")
    df = df.withColumns({"plain": costs.round_trip_cost(F.lit(1000.0), F.col("open"), F.col("close")), "_cn": cn})
    return rounded(df.select("symbol", "date", "plain", F.col("_cn.total").alias("cn"), F.col("_cn.rate").alias("rate")), "plain", "cn", "rate")


_base = "greatest(1000 * open * 0.0003, 5) + greatest(1000 * close * 0.0003, 5) + 1000 * close * 0.001 + 1000 * (close - open) * 0.0001"
_add("cost_model", _costs, f"SELECT symbol, date, round({_base} + {NUDGE}, 6) AS plain, round({_base} + 1000 * (open + close) * 0.0000887 + {NUDGE}, 6) AS cn, round(({_base} + 1000 * (open + close) * 0.0000887) / (1000 * (open + close)) + {NUDGE}, 6) AS rate FROM ({BARS_WEEK})")

_TRADES = staged(_MA + [{"signal": "CASE WHEN i >= 20 AND s > l THEN 'buy' WHEN i >= 20 AND s < l THEN 'sell' ELSE 'hold' END"}], []).split("\nSELECT symbol")[0].replace("WITH ", "WITH RECURSIVE ", 1) + """,
turns AS (SELECT symbol, date, signal, close AS price, lag(signal) OVER (PARTITION BY symbol ORDER BY date) AS p FROM s2 WHERE signal <> 'hold'),
picked AS (SELECT symbol, date, signal, price FROM turns WHERE (p IS NULL AND signal = 'buy') OR p <> signal),
started AS (SELECT t.* FROM picked t WHERE EXISTS (SELECT 1 FROM picked b WHERE b.symbol = t.symbol AND b.signal = 'buy' AND b.date <= t.date)),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS trade FROM started),
fold AS (
  SELECT symbol, trade, 100000.0::DOUBLE / price AS shares, 0.0::DOUBLE AS capital, price AS bought, 0.0::DOUBLE AS cost FROM n WHERE trade = 1
  UNION ALL
  SELECT n.symbol, n.trade, CASE n.signal WHEN 'buy' THEN f.capital / n.price ELSE f.shares END,
         CASE n.signal WHEN 'buy' THEN 0 ELSE f.shares * n.price - (greatest(f.shares * f.bought * 0.0003, 5) + greatest(f.shares * n.price * 0.0003, 5) + f.shares * n.price * 0.001 + f.shares * (n.price - f.bought) * 0.0001) END,
         CASE n.signal WHEN 'buy' THEN n.price ELSE f.bought END,
         CASE n.signal WHEN 'buy' THEN 0 ELSE greatest(f.shares * f.bought * 0.0003, 5) + greatest(f.shares * n.price * 0.0003, 5) + f.shares * n.price * 0.001 + f.shares * (n.price - f.bought) * 0.0001 END
  FROM fold f JOIN n ON n.symbol = f.symbol AND n.trade = f.trade + 1),
done AS (SELECT n.symbol, n.date, n.signal, n.price, f.shares, f.capital, f.cost, CAST(n.trade AS INTEGER) AS trade FROM n JOIN fold f USING (symbol, trade))"""
_EQUITY = _TRADES + """,
held AS (SELECT s2.symbol, s2.date, s2.close, last_value(CASE d.signal WHEN 'buy' THEN d.shares WHEN 'sell' THEN 0 END IGNORE NULLS) OVER w AS shares, last_value(d.capital IGNORE NULLS) OVER w AS capital
         FROM s2 LEFT JOIN done d ON d.symbol = s2.symbol AND d.date = s2.date WINDOW w AS (PARTITION BY s2.symbol ORDER BY s2.date ROWS UNBOUNDED PRECEDING)),
equity AS (SELECT symbol, date, CASE WHEN shares > 0 THEN shares * close ELSE coalesce(capital, 100000) END AS equity FROM held)"""


def _trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = bars_hour(spark, sf_dir)
    return bars, backtest.trades(signals.ma_state(bars))


_add("backtest_trades", lambda s, d: rounded(_trades(s, d)[1], "price", "shares", "capital", "cost", keys=("symbol", "date", "signal", "trade"), digits=4), f"{_TRADES} SELECT symbol, date, signal, trade, {_r('price', 'shares', 'capital', 'cost', digits=4)} FROM done")


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.equity(*_trades(spark, sf_dir))


_add("backtest_equity", lambda s, d: rounded(_equity(s, d), "equity", digits=4), f"{_EQUITY} SELECT symbol, date, round(equity + {NUDGE}, 4) AS equity FROM equity")


def _performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, done = _trades(spark, sf_dir)
    df = performance.performance(backtest.equity(bars, done), done)
    return rounded(df, "total_return", "annual_return", "sharpe_ratio", "max_drawdown", "volatility", "winning_rate", "average_profit_loss", keys=("symbol", "trades_count"))


_add("performance", _performance, f"""{_EQUITY},
x AS (SELECT *, lag(equity) OVER (PARTITION BY symbol ORDER BY date) AS p, max(equity) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM equity),
m AS (SELECT symbol, (arg_max(equity, date) / arg_min(equity, date) - 1) * 100 AS total_return, (pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(*)) - 1) * 100 AS annual_return,
             CASE WHEN stddev_pop(equity / nullif(p, 0) - 1) > 0 THEN avg(equity / nullif(p, 0) - 1) / stddev_pop(equity / nullif(p, 0) - 1) * sqrt(252) ELSE 0 END AS sharpe_ratio, max((peak - equity) / peak * 100) AS max_drawdown, stddev_pop(equity / nullif(p, 0) - 1) * sqrt(252) * 100 AS volatility FROM x GROUP BY symbol),
trips AS (SELECT b.symbol, b.price AS buy, s.price AS sell, (s.price - b.price) * b.shares AS profit FROM done b JOIN done s ON s.symbol = b.symbol AND s.trade = b.trade + 1 WHERE b.signal = 'buy'),
w AS (SELECT symbol, count(*) FILTER (WHERE sell > buy) / count(*) * 100 AS winning_rate, coalesce(avg(profit) FILTER (WHERE profit > 0), 0) / coalesce(avg(-profit) FILTER (WHERE profit <= 0), 1) AS average_profit_loss, count(*) AS trades_count FROM trips GROUP BY symbol)
SELECT symbol, trades_count, {_r('total_return', 'annual_return', 'sharpe_ratio', 'max_drawdown', 'volatility', 'winning_rate', 'average_profit_loss')} FROM m JOIN w USING (symbol)""")


def _advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _equity(spark, sf_dir)
    return rounded(performance.advanced(e), "sortino", "calmar", "downside_risk", "recovery", "sharpe_126", keys=("symbol", "longest_drawdown"))


QUERIES["performance_advanced"] = _advanced
QUERIES["trade_statistics"] = lambda s, d: rounded(performance.trade_statistics(_trades(s, d)[1]), "profit_factor", "expectancy", "average_return", "average_holding_days", "turnover", keys=("symbol",), digits=4)
_add("portfolio_equity", lambda s, d: rounded(backtest.portfolio_equity(bars_hour(s, d), backtest.trades(signals.ma_state(bars_hour(s, d)), 20_000.0), 5), "equity", keys=("date",), digits=3), _EQUITY.replace("100000", "20000") + f""",
delta AS (SELECT date, equity - lag(equity, 1, 20000.0::DOUBLE) OVER (PARTITION BY symbol ORDER BY date) AS d FROM equity), daily AS (SELECT date, sum(d) AS d FROM delta GROUP BY date)
SELECT date, round(100000 + sum(d) OVER (ORDER BY date) + {NUDGE}, 3) AS equity FROM daily""")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = backtest.grid(bars_hour(spark, sf_dir), signals.ma_state, {"short": [5, 10], "long": [20, 30]})
    done = backtest.trades(long)
    metrics = performance.performance(backtest.equity(long, done), done)
    return rounded(backtest.best(metrics), "total_return", "sharpe_ratio", "max_drawdown", keys=("symbol", "param_id"))


QUERIES["backtest_grid"] = _grid

# ---- ranking

_RANKED = f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS r FROM ({BARS_WEEK})),
f AS (SELECT symbol, {', '.join(f'max(close) FILTER (WHERE k = {k}) AS p{k}' for k in (1, 10, 20, 60))}, max(volume) FILTER (WHERE k = 1) AS v1, max(volume) FILTER (WHERE k = 10) AS v10,
             stddev_pop(close) FILTER (WHERE k <= 20) / avg(close) FILTER (WHERE k <= 20) AS cv, avg(r) AS mr, stddev_pop(r) AS sr, avg(volume) FILTER (WHERE k <= 5) AS vn, avg(volume) FILTER (WHERE k BETWEEN 6 AND 10) AS vo FROM b GROUP BY symbol HAVING count(*) >= 20)"""
_SCORES = {
    "multi_factor": "0.2 * ((p1 - p10) / p10 + coalesce((p1 - p20) / p20, 0)) + 0.2 * (1 - cv) + 0.2 * ((v1 - v10) / v10) + 0.2 * mr / (sr + 0.0000000001) + 0.2 * mr",
    "momentum": "(p1 - p20) / p20 * 2",
    "industry": "0.4 * (p1 - p20) / p20 + 0.3 * coalesce((p1 - p60) / p60, 0) + 0.3 * (vn - vo) / (vo + 0.0000000001) + 0.5",
}


def _scored(method: str) -> str:
    return f"""{_RANKED}, s AS (SELECT symbol, greatest(0, least(1, {_SCORES[method]})) AS score, least(100, cv * 200) AS risk_score FROM f), t AS (SELECT *, score * (1 - risk_score / 100) AS adjusted_score FROM s),
u AS (SELECT *, CASE WHEN adjusted_score > 0.7 THEN 'buy' WHEN adjusted_score > 0.3 THEN 'hold' ELSE 'sell' END AS signal, CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 60 THEN 'medium' ELSE 'high' END AS risk_level FROM t)"""


for _method in _SCORES:
    _add(f"rank_{_method}", lambda s, d, m=_method: rounded(ranking.score(bars_week(s, d), m), "score", "risk_score", "adjusted_score", keys=("symbol", "signal", "risk_level")), f"{_scored(_method)} SELECT symbol, signal, risk_level, {_r('score', 'risk_score', 'adjusted_score')} FROM u")
_add("rank_top", lambda s, d: rounded(ranking.top(ranking.score(bars_week(s, d)), 10), "adjusted_score", keys=("symbol", "signal")), f"{_scored('multi_factor')} SELECT symbol, signal, round(adjusted_score + {NUDGE}, 6) AS adjusted_score FROM u ORDER BY u.adjusted_score DESC, symbol LIMIT 10")
_add("rank_report", lambda s, d: rounded(ranking.report(ranking.score(bars_week(s, d)), stock_basic(s, d)), "mean_score", "mean_risk", "mean_adjusted", keys=("industry", "n", "n_buy", "n_hold", "n_sell")), f"{_scored('multi_factor')} SELECT industry, count(*) AS n, count(*) FILTER (WHERE signal = 'buy') AS n_buy, count(*) FILTER (WHERE signal = 'hold') AS n_hold, count(*) FILTER (WHERE signal = 'sell') AS n_sell, round(avg(score) + {NUDGE}, 6) AS mean_score, round(avg(risk_score) + {NUDGE}, 6) AS mean_risk, round(avg(adjusted_score) + {NUDGE}, 6) AS mean_adjusted FROM u JOIN ({_BASIC}) USING (symbol) GROUP BY industry")
