"""Queries of the alpha factors and their evaluation, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alpha
from ..sources.bars import bars_hour
from .indicator_queries import rounded
from .sqltext import NUDGE, lag, last, prior, so_far, staged

QUERIES: dict = {}
SQL: dict[str, str] = {}

RET = f"coalesce(close / nullif({lag('close')}, 0) - 1, 0)"
LOG_RET = f"coalesce(ln(close / nullif({lag('close')}, 0)), 0)"
YEAR = "sqrt(252)"


def _add(name: str, run: Callable[[DataFrame], DataFrame], columns: str, stages: list[dict[str, str]]) -> None:
    cols = columns.split()
    QUERIES[name] = lambda spark, sf_dir: rounded(run(bars_hour(spark, sf_dir)), *cols)
    SQL[name] = staged(stages, cols)


def _from(n: int, e: str) -> str:
    return f"coalesce(CASE WHEN i > {n} THEN {e} END, 0)"


def _change(c: str, n: int) -> str:
    return _from(n, f"({c} - {lag(c, n)}) / nullif({lag(c, n)}, 0)")


def _cross(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} AND {lag(a)} <= {lag(b)} THEN 1 WHEN {a} < {b} AND {lag(a)} >= {lag(b)} THEN -1 ELSE 0 END"


_add("alpha_momentum", alpha.momentum, "momentum_1m momentum_3m momentum_6m momentum_12m", [{"momentum_1m": _change("close", 20), "momentum_3m": _change("close", 60), "momentum_6m": _change("close", 120), "momentum_12m": _change("close", 240)}])
_GL = {"ch": f"coalesce(close - {lag('close')}, 0)"}, {"g": "greatest(ch, 0)", "l": "greatest(-ch, 0)"}
_rsi = lambda n: _from(n, f"CASE WHEN {last('avg(l)', n)} = 0 THEN 100 ELSE 100 - 100 / (1 + {last('avg(g)', n)} / nullif({last('avg(l)', n)}, 0)) END")
_add("alpha_rsi", alpha.rsi, "rsi_14 rsi_21", [*_GL, {"rsi_14": _rsi(14), "rsi_21": _rsi(21)}])
_add("alpha_rsi_momentum", alpha.rsi_momentum, "rsi_14 rsi_momentum", [*_GL, {"rsi_14": _rsi(14)}, {"rsi_momentum": _from(28, f"rsi_14 - {lag('rsi_14', 14)}")}])
_add("alpha_atr", alpha.atr, "atr_14 atr_21", [{"p": lag("close")}, {"tr": "CASE WHEN p IS NULL THEN 0 ELSE greatest(high - low, abs(high - p), abs(low - p)) END"}, {f"atr_{n}": _from(n, prior("avg(tr)", n)) for n in (14, 21)}])
_add("alpha_volatility", alpha.volatility, "volatility_20 volatility_60", [{"r": LOG_RET}, {f"volatility_{n}": _from(n, f"{prior('stddev_pop(r)', n)} * {YEAR}") for n in (20, 60)}])
_add("alpha_gk", alpha.garman_klass, "gk_volatility_20 gk_volatility_60", [{"t": "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"}, {"gk": "CASE WHEN i = 1 THEN 0 WHEN t >= 0 THEN sqrt(t) END"}, {f"gk_volatility_{n}": f"CASE WHEN i <= {n} THEN 0 WHEN {prior('count(gk)', n)} = {n} THEN {prior('avg(gk)', n)} * {YEAR} END" for n in (20, 60)}])
_add("alpha_vol_trend", alpha.volatility_trend, "volatility_trend", [{"r": LOG_RET}, {"a": prior("stddev_pop(r)", 20), "b": prior("stddev_pop(r)", 60, 21)}, {"volatility_trend": _from(60, "CASE WHEN b > 0 THEN (a - b) / b END")}])
_add("alpha_volume", lambda df: alpha.volume_momentum(alpha.volume_change(df)), "volume_change volume_change_5 volume_change_20 volume_momentum_10 volume_momentum_20", [{"volume_change": f"CASE WHEN {lag('volume')} > 0 THEN (volume - {lag('volume')}) / {lag('volume')} ELSE 0 END"}, {f"volume_change_{n}": _from(n, prior("avg(volume_change)", n)) for n in (5, 20)} | {f"volume_momentum_{n}": _change("volume", n) for n in (10, 20)}])
_add("alpha_obv", alpha.obv, "obv obv_ma10 obv_ma20", [{"s": f"coalesce(sign(close - {lag('close')}) * volume, 0)"}, {"obv": so_far("sum(s)")}, {f"obv_ma{n}": _from(n, prior("avg(obv)", n)) for n in (10, 20)}])
_add("alpha_vp_corr", alpha.volume_price, "volume_price_correlation volume_weighted_price", [{"r": RET}, {"volume_price_correlation": f"CASE WHEN i <= 20 THEN 0 ELSE {prior('covar_pop(volume, r)', 20)} / nullif({prior('stddev_pop(volume)', 20)} * {prior('stddev_pop(r)', 20)}, 0) END", "volume_weighted_price": f"coalesce({prior('sum(close * volume)', 20)} / nullif({prior('sum(volume)', 20)}, 0), 0)"}])
_add("alpha_boll", alpha.bollinger, "bollinger_ma20 bollinger_upper bollinger_lower bollinger_width bollinger_position", [{"m": prior("avg(close)", 20), "s": prior("stddev_pop(close)", 20)}, {"bollinger_ma20": _from(20, "m"), "bollinger_upper": _from(20, "m + 2 * s"), "bollinger_lower": _from(20, "m - 2 * s"), "bollinger_width": _from(20, "4 * s / nullif(m, 0)"), "bollinger_position": _from(20, "(close - m) / nullif(4 * s, 0)")}])
_add("alpha_ma_cross", alpha.ma_crossover, "ma5 ma60 ma_crossover_5_20 ma_crossover_10_60", [{f"ma{n}": _from(60, prior("avg(close)", n)) for n in (5, 10, 20, 60)}, {"ma_crossover_5_20": f"CASE WHEN i > 60 THEN {_cross('ma5', 'ma20')} ELSE 0 END", "ma_crossover_10_60": f"CASE WHEN i > 60 THEN {_cross('ma10', 'ma60')} ELSE 0 END"}])
_add("alpha_risk", alpha.risk, "beta max_drawdown_20 sharpe_ratio_20 downside_risk_20", [{"r": RET}, {"v": prior("var_pop(r)", 20), "sd": prior("stddev_pop(r)", 20), "hi": prior("max(close)", 20), "lo": prior("min(close)", 20)}, {"beta": _from(20, f"CASE WHEN v > 0 THEN {prior('covar_samp(r, r)', 20)} / v END"), "max_drawdown_20": _from(20, "CASE WHEN hi > 0 THEN (lo - hi) / hi END"), "sharpe_ratio_20": _from(20, f"CASE WHEN sd > 0 THEN {prior('avg(r)', 20)} / sd * {YEAR} END"), "downside_risk_20": _from(20, f"{prior('stddev_pop(CASE WHEN r < 0 THEN r END)', 20)} * {YEAR}")}])

# ---- recursions, by recursive SQL


def _ema(source: str, target: str, n: int, rows: str) -> str:
    """A CTE that walks the seeded exponential mean of source."""
    return f"""{target}_walk AS (
  SELECT symbol, i, (SELECT avg({source}) FROM {rows} q WHERE q.symbol = p.symbol AND q.i <= {n}) AS {target} FROM {rows} p WHERE i = {n}
  UNION ALL
  SELECT p.symbol, p.i, (p.{source} - w.{target}) * (2.0::DOUBLE / {n + 1}) + w.{target} FROM {target}_walk w JOIN {rows} p ON p.symbol = w.symbol AND p.i = w.i + 1)"""


_BASE = staged([], ["close"]).split("\nSELECT symbol")[0].replace("WITH ", "WITH RECURSIVE ", 1)
QUERIES["alpha_macd_seeded"] = lambda spark, sf_dir: rounded(alpha.macd_seeded(bars_hour(spark, sf_dir)), "macd", "macd_signal", "macd_hist")
SQL["alpha_macd_seeded"] = f"""{_BASE},
{_ema('close', 'e12', 12, 's0')}, {_ema('close', 'e26', 26, 's0')},
lines AS (SELECT s0.symbol, s0.date, s0.i, coalesce(e12, 0) - coalesce(e26, 0) AS line FROM s0 LEFT JOIN e12_walk USING (symbol, i) LEFT JOIN e26_walk USING (symbol, i)),
{_ema('line', 'sig', 9, 'lines')}
SELECT symbol, date, round(line + {NUDGE}, 6) AS macd, round(coalesce(sig, 0) + {NUDGE}, 6) AS macd_signal, round(line - coalesce(sig, 0) + {NUDGE}, 6) AS macd_hist
FROM lines LEFT JOIN sig_walk USING (symbol, i)"""

QUERIES["alpha_kdj"] = lambda spark, sf_dir: rounded(alpha.kdj_crossover(bars_hour(spark, sf_dir)), "kdj_k", "kdj_d", "kdj_j", "kdj_crossover")
_RSV = staged([{"hi": prior("max(high)", 14), "lo": prior("min(low)", 14)}, {"rsv": "coalesce(CASE WHEN hi = lo THEN 0 ELSE (close - lo) * 100 / nullif(hi - lo, 0) END, 0)"}], ["close"]).split("\nSELECT symbol")[0].replace("WITH ", "WITH RECURSIVE ", 1)
SQL["alpha_kdj"] = f"""{_RSV},
walk AS (
  SELECT symbol, i, 50.0::DOUBLE AS k, 50.0::DOUBLE AS d FROM s2 WHERE i = 15
  UNION ALL
  SELECT s.symbol, s.i, w.k * 2 / 3 + s.rsv / 3, w.d * 2 / 3 + (w.k * 2 / 3 + s.rsv / 3) / 3 FROM walk w JOIN s2 s ON s.symbol = w.symbol AND s.i = w.i + 1),
kd AS (SELECT s2.symbol, s2.date, s2.i, coalesce(k, 0) AS kdj_k, coalesce(d, 0) AS kdj_d FROM s2 LEFT JOIN walk USING (symbol, i))
SELECT symbol, date, round(kdj_k + {NUDGE}, 6) AS kdj_k, round(kdj_d + {NUDGE}, 6) AS kdj_d, round(3 * kdj_k - 2 * kdj_d + {NUDGE}, 6) AS kdj_j,
       round(CASE WHEN i > 15 THEN {_cross('kdj_k', 'kdj_d')} ELSE 0 END + {NUDGE}, 6) AS kdj_crossover FROM kd"""

# ---- evaluation


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


FACTORS = ["momentum_1m", "atr_14", "obv"]


def _panel(spark, sf_dir):
    return alpha.next_return(alpha.obv(alpha.atr(alpha.momentum(bars_hour(spark, sf_dir)))))


_PANEL = staged([{"momentum_1m": _change("close", 20), "p": lag("close"), "s": f"coalesce(sign(close - {lag('close')}) * volume, 0)", "target": "(lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) - close) / nullif(close, 0)"}, {"tr": "CASE WHEN p IS NULL THEN 0 ELSE greatest(high - low, abs(high - p), abs(low - p)) END", "obv": so_far("sum(s)")}, {"atr_14": _from(14, prior("avg(tr)", 14))}], ["close"]).split("\nSELECT symbol")[0]
_LONG = _PANEL + ",\nlong AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS x, target AS y FROM s3 WHERE target IS NOT NULL" for f in FACTORS) + ")"
QUERIES["ic_rank_ic"] = lambda spark, sf_dir: rounded(alpha.information_coefficients(_panel(spark, sf_dir), FACTORS), "ic", "rank_ic", keys=("factor", "n"))
SQL["ic_rank_ic"] = f"""{_LONG},
ranked AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY x) + (count(*) OVER (PARTITION BY factor, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY factor ORDER BY y) + (count(*) OVER (PARTITION BY factor, y) - 1) / 2.0 AS ry FROM long)
SELECT factor, count(*) AS n, round({_corr('x', 'y')} + {NUDGE}, 6) AS ic, round({_corr('rx', 'ry')} + {NUDGE}, 6) AS rank_ic FROM ranked GROUP BY factor"""
QUERIES["factor_weights"] = lambda spark, sf_dir: rounded(alpha.factor_weights(_panel(spark, sf_dir), FACTORS), "weight", keys=("factor",))
SQL["factor_weights"] = f"{_LONG}, c AS (SELECT factor, abs({_corr('x', 'y')}) AS a FROM long GROUP BY factor) SELECT factor, round(a / sum(a) OVER () + {NUDGE}, 6) AS weight FROM c"
QUERIES["factor_corr"] = lambda spark, sf_dir: rounded(alpha.correlations(_panel(spark, sf_dir), FACTORS), "r", keys=("a", "b"))
SQL["factor_corr"] = _PANEL + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_corr(a, b)} + {NUDGE}, 6) AS r FROM s3" for i, a in enumerate(FACTORS) for b in FACTORS[i:])
QUERIES["quantile_test"] = lambda spark, sf_dir: rounded(alpha.quantile_test(_panel(spark, sf_dir), "atr_14"), "mean_return", "long_short", keys=("bucket", "n"))
SQL["quantile_test"] = f"""{_PANEL}, e AS (SELECT quantile_cont(atr_14, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM s3 WHERE target IS NOT NULL)
, q AS (SELECT b AS bucket, count(target) AS n, coalesce(avg(target), 0) AS m
  FROM (SELECT unnest(generate_series(1, 5)) AS b) CROSS JOIN e LEFT JOIN s3 ON target IS NOT NULL AND atr_14 >= e[b] AND atr_14 < e[b + 1] GROUP BY b)
SELECT CAST(bucket AS INTEGER) AS bucket, n, round(m + {NUDGE}, 6) AS mean_return, round((SELECT m FROM q WHERE bucket = 5) - (SELECT m FROM q WHERE bucket = 1) + {NUDGE}, 6) AS long_short FROM q"""
