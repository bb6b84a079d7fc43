"""Queries of the indicators on hourly bars, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.breadth import build_breadth, with_breadth
from ..functions.registry import with_indicators
from ..sources.bars import bars_hour, bars_week
from .sqltext import BARS_WEEK, NUDGE, ewm, lag, last, prior, so_far, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol", "date"), digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(c) + NUDGE, digits).alias(c) for c in columns])


def _add(name: str, columns: str, stages: list[dict[str, str]], digits: int = 6) -> None:
    cols = columns.split()
    QUERIES[name] = lambda spark, sf_dir: rounded(with_indicators(bars_hour(spark, sf_dir), [name]), *cols, digits=digits)
    SQL[name] = staged(stages, cols, digits=digits)


def _vwap(over) -> str:
    v = over("sum(volume)")
    return f"CASE WHEN {v} = 0 THEN close ELSE {over('sum((high + low + close) / 3 * volume)')} / nullif({v}, 0) END"


_add("ma", "ma5 ma10 ma20 ma60 ma", [{f"ma{n}": last("avg(close)", n) for n in (5, 10, 20, 60)} | {"ma": last("avg(close)", 5)}])
_add("macd", "macd macd_signal macd_hist", [{"macd": f"{ewm('close', 12)} - {ewm('close', 26)}"}, {"macd_signal": ewm("macd", 9)}, {"macd_hist": "macd - macd_signal"}])
_add("dmi", "pdi_14 ndi_14 adx_14 adxr_14 pdi", [
    {"up": f"high - {lag('high')}", "down": f"{lag('low')} - low", "tr": f"greatest(high, {lag('close')}) - least(low, {lag('close')})"},
    {"dp": "CASE WHEN up > down AND up > 0 THEN up ELSE 0 END", "dm": "CASE WHEN down > up AND down > 0 THEN down ELSE 0 END"},
    {"pdi_14": f"{last('sum(dp)', 14)} * 100 / nullif({last('sum(tr)', 14)}, 0)", "ndi_14": f"{last('sum(dm)', 14)} * 100 / nullif({last('sum(tr)', 14)}, 0)"},
    {"dx": "CASE WHEN pdi_14 + ndi_14 = 0 THEN 0 ELSE abs(pdi_14 - ndi_14) * 100 / (pdi_14 + ndi_14) END", "pdi": "pdi_14"},
    {"adx_14": last("avg(dx)", 14)}, {"adxr_14": f"(adx_14 + {lag('adx_14', 14)}) / 2"}])
_add("trix", "trix12 trma12 trix trma", [{"e1": ewm("close", 12)}, {"e2": ewm("e1", 12)}, {"e3": ewm("e2", 12)}, {"trix12": f"(e3 - {lag('e3')}) / nullif({lag('e3')}, 0) * 100"}, {"trma12": ewm("trix12", 9)}, {"trix": "trix12", "trma": "trma12"}])
_add("dma", "dma ama", [{"dma": f"{last('avg(close)', 10)} - {last('avg(close)', 50)}"}, {"ama": last("avg(dma)", 10)}])
_add("fsl", "swl sws", [{"swl": "(high + low + close) / 3", "sws": "(high + low + close + open) / 4"}])
_add("expma", "expma12 expma50 expma", [{"expma12": ewm("close", 12), "expma50": ewm("close", 50)}, {"expma": "expma12"}])
_add("bbi", "bbi", [{"bbi": "(" + " + ".join(last("avg(close)", n) for n in (3, 6, 12, 24)) + ") / 4"}])
_add("rsi", "rsi14 rsi", [{"ch": f"coalesce(close - {lag('close')}, 0)"}, {"g": "greatest(ch, 0)", "l": "greatest(-ch, 0)"}, {"eg": ewm("g", 14), "el": ewm("l", 14)}, {"rsi14": "CASE WHEN el = 0 THEN 100 ELSE 100 - 100 / (1 + eg / nullif(el, 0)) END"}, {"rsi": "rsi14"}])
_add("kdj", "k14 d14 j14 k d j", [{"lo": last("min(low)", 14), "hi": last("max(high)", 14)}, {"rsv": "(close - lo) * 100 / nullif(hi - lo, 0)"}, {"k14": last("avg(rsv)", 3)}, {"d14": last("avg(k14)", 3)}, {"j14": "3 * k14 - 2 * d14", "k": "k14", "d": "d14"}, {"j": "j14"}])
_add("cci", "cci14 cci", [{"tp": "(high + low + close) / 3"}, {"m": last("avg(tp)", 14)}, {"dev": last("avg(abs(tp - m))", 14)}, {"cci14": "(tp - m) / nullif(dev * 0.015, 0)"}, {"cci": "cci14"}])
_add("roc", "roc12 roc", [{"roc12": f"(close - {lag('close', 12)}) * 100 / nullif({lag('close', 12)}, 0)"}, {"roc": "roc12"}])
_add("mtm", "mtm12 mtm", [{"mtm12": f"close - {lag('close', 12)}"}, {"mtm": "mtm12"}])
_add("vol_ma", "vol_ma5 vol_ma10 vol_ma", [{"vol_ma5": last("avg(volume)", 5), "vol_ma10": last("avg(volume)", 10)}, {"vol_ma": "vol_ma5"}])
_add("vol_tdx", "vol_tdx", [{"vol_tdx": last("avg(volume)", 5)}])
_add("obv", "obv", [{"s": f"CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END"}, {"obv": so_far("sum(s)")}])
_side = {"p": lag("close")}, {"u": "CASE WHEN close > p THEN volume ELSE 0 END", "d": "CASE WHEN close < p THEN volume ELSE 0 END", "f": "CASE WHEN close = p THEN volume ELSE 0 END"}
_add("vr", "vr26 vr", [*_side, {"vr26": f"({last('sum(u)', 26)} + {last('sum(f)', 26)} / 2) / ({last('sum(d)', 26)} + {last('sum(f)', 26)} / 2 + 0.0001) * 100"}, {"vr": "vr26"}])
_add("psy", "psy12 psy", [{"p": lag("close")}, {"psy12": f"{last('sum(CASE WHEN close > p THEN 1.0::DOUBLE ELSE 0 END)', 12)} / 12 * 100"}, {"psy": "psy12"}])
_add("cr", "cr26 cr", [*_side, {"cr26": f"({last('sum(u)', 26)} - {last('sum(d)', 26)}) / ({last('sum(u)', 26)} + {last('sum(d)', 26)} + 0.0001) * 100"}, {"cr": "cr26"}])
_add("hsl", "hsl hsl_ma5 hsl_ma10", [{"m": last("avg(volume)", 60)}, {"hsl": "CASE WHEN m = 0 THEN 0 ELSE volume / nullif(m, 0) END * 5"}, {"hsl_ma5": last("avg(hsl)", 5), "hsl_ma10": last("avg(hsl)", 10)}])
_add("lb", "lb", [{"m": prior("avg(volume)", 5)}, {"lb": "coalesce(volume / nullif(m, 0), 1)"}])
_add("boll", "mb20 up20 dn20 mb up dn", [{"mb20": last("avg(close)", 20), "s": last("stddev_samp(close)", 20)}, {"up20": "mb20 + 2 * s", "dn20": "mb20 - 2 * s"}, {"mb": "mb20", "up": "up20", "dn": "dn20"}])
_add("wr", "wr10 wr6 wr wr1 wr2", [{f"wr{n}": f"({last('max(high)', n)} - close) * 100 / nullif({last('max(high)', n)} - {last('min(low)', n)}, 0)" for n in (10, 6)}, {"wr": "wr10", "wr1": "wr10", "wr2": "wr6"}])
_add("brar", "ar26 br26 ar br", [{"p": lag("close")}, {"a": "greatest(high - open, 0)", "b": "greatest(open - low, 0)", "c": "greatest(high - p, 0)", "e": "greatest(p - low, 0)"}, {"ar26": f"{last('sum(a)', 26)} / ({last('sum(b)', 26)} + 0.0001) * 100", "br26": f"{last('sum(c)', 26)} / ({last('sum(e)', 26)} + 0.0001) * 100"}, {"ar": "ar26", "br": "br26"}])
_add("asi", "asi asi_sig", [{"o1": lag("open"), "h1": lag("high"), "l1": lag("low"), "c1": lag("close")}, {"tr": "greatest(abs(h1 - close), abs(l1 - close), abs(h1 - l1))"}, {"asi": "CASE WHEN tr <> 0 THEN (open - c1 + 0.5 * (open - close) + 0.25 * (c1 - o1)) / tr * 16 ELSE 0 END"}, {"asi_sig": last("avg(asi)", 20)}])
_add("emv", "emv14 emv", [{"mid": "(high + low) / 2"}, {"one": f"CASE WHEN high = low THEN 0 ELSE (mid - {lag('mid')}) * 100000000 / nullif(volume / nullif(high - low, 0), 0) END"}, {"emv14": last("avg(one)", 14)}, {"emv": "emv14"}], digits=1)
_add("mcst", "mcst mcst_ma12", [{"mcst": f"CASE WHEN {so_far('sum(volume)')} = 0 THEN 0 ELSE {so_far('sum(amount)')} / nullif({so_far('sum(volume)')}, 0) END"}, {"mcst_ma12": last("avg(mcst)", 12)}])
_add("cyc", "cyc5 cyc13 cyc34 cyc_inf cyc", [{f"cyc{n}": _vwap(lambda e, n=n: last(e, n)) for n in (5, 13, 34)} | {"cyc_inf": _vwap(so_far)}, {"cyc": "cyc5"}])
_add("cys", "cys cys_ma5", [{"c": _vwap(lambda e: last(e, 13))}, {"cys": "CASE WHEN c > 0 THEN (close - c) / nullif(c, 0) * 100 ELSE 0 END"}, {"cys_ma5": last("avg(cys)", 5)}])

# SAR is a recursion; SQL walks it row by row, mirrored prices for a fall (side = -1)
QUERIES["sar"] = lambda spark, sf_dir: rounded(with_indicators(bars_hour(spark, sf_dir), ["sar"]), "sar")
SQL["sar"] = staged([{"c1": "lead(close, 1) OVER (PARTITION BY symbol ORDER BY date)"}, {"l1": lag("low"), "l2": lag("low", 2), "h1": lag("high"), "h2": lag("high", 2)}], []).split("\nSELECT symbol")[0].replace("WITH ", "WITH RECURSIVE ", 1) + """,
walk AS (
  SELECT symbol, date, i, CASE WHEN c1 > close THEN 1 ELSE -1 END AS side, CASE WHEN c1 > close THEN low ELSE -high END AS stop,
         CASE WHEN c1 > close THEN high ELSE -low END AS extreme, CAST(0.02 AS DOUBLE) AS pace
  FROM s2 WHERE i = 1 AND c1 IS NOT NULL
  UNION ALL
  SELECT symbol, date, i, CASE WHEN turned THEN -side ELSE side END, CASE WHEN turned THEN -extreme ELSE lifted END,
         CASE WHEN turned THEN (CASE WHEN side = 1 THEN -low ELSE high END) WHEN far > extreme THEN far ELSE extreme END,
         CASE WHEN turned THEN 0.02 WHEN far > extreme THEN least(pace + 0.02, 0.2) ELSE pace END
  FROM (SELECT *, near < lifted AS turned FROM (
    SELECT s.symbol, s.date, s.i, w.side, w.extreme, w.pace, s.low, s.high,
           CASE WHEN w.side = 1 THEN s.low ELSE -s.high END AS near, CASE WHEN w.side = 1 THEN s.high ELSE -s.low END AS far,
           greatest(w.stop + w.pace * (w.extreme - w.stop), CASE WHEN w.side = 1 THEN s.l1 ELSE -s.h1 END, CASE WHEN w.side = 1 THEN s.l2 ELSE -s.h2 END) AS lifted
    FROM walk w JOIN s2 s ON s.symbol = w.symbol AND s.i = w.i + 1)))
SELECT s2.symbol, s2.date, round(walk.side * walk.stop + 1.37e-8, 6) AS sar FROM s2 LEFT JOIN walk USING (symbol, i)"""

# ---- breadth, on weekly bars of many symbols

_BREADTH = f"""changes AS (SELECT symbol, date, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM ({BARS_WEEK})),
breadth AS (
  SELECT date, CAST(count(*) FILTER (WHERE close > p) AS BIGINT) AS up_count, count(*) FILTER (WHERE close < p) AS down_count,
         count(*) FILTER (WHERE close = p) AS flat_count, count(*) AS total_count FROM changes WHERE p IS NOT NULL GROUP BY date)"""
SQL["breadth"] = f"WITH {_BREADTH} SELECT date, up_count, down_count, flat_count, total_count, round(up_count / total_count + 1.37e-8, 6) AS up_rate, round(down_count / total_count + 1.37e-8, 6) AS down_rate FROM breadth"


def _breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = build_breadth(bars_week(spark, sf_dir))
    return rounded(df.select("*"), "up_rate", "down_rate", keys=("date", "up_count", "down_count", "flat_count", "total_count"))


QUERIES["breadth"] = _breadth


def _add_breadth(name: str, column: str, stages: list[dict[str, str]]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = bars_week(spark, sf_dir)
        return rounded(with_indicators(with_breadth(bars, build_breadth(bars)), [name]), column)

    QUERIES[name] = query
    bars = f"WITH {_BREADTH} SELECT b.*, coalesce(up_count, 0) AS up_count, coalesce(down_count, 0) AS down_count FROM ({BARS_WEEK}) b LEFT JOIN breadth USING (date)"
    SQL[name] = staged(stages, [column], bars)


_add_breadth("abi", "abi10", [{"abi10": "coalesce(abs(up_count - down_count) * 100 / nullif(up_count + down_count, 0), 0)"}])
_add_breadth("adl", "adl", [{"adl": so_far("sum(up_count - down_count)")}])
_add_breadth("adr", "adr10", [{"adr10": f"CASE WHEN i >= 10 THEN {last('avg(up_count)', 10)} * 100 / nullif({last('avg(down_count)', 10)}, 0) END"}])
_add_breadth("obos", "obos10", [{"obos10": f"CASE WHEN i >= 10 THEN {last('avg(up_count)', 10)} - {last('avg(down_count)', 10)} END"}])


def _all_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window indicator at once: one shuffle and sort by symbol and date for all of them."""
    names = ["ma", "macd", "dmi", "trix", "dma", "fsl", "expma", "bbi", "rsi", "kdj", "cci", "roc", "mtm", "vol_ma", "obv", "vr", "psy", "cr", "hsl", "lb", "boll", "wr", "brar", "asi", "emv", "mcst", "cyc", "cys"]
    df = with_indicators(bars_hour(spark, sf_dir), names)
    return rounded(df, "ma", "macd_hist", "adx", "trix", "dma", "rsi", "k", "cci", "obv", "vr", "mb", "wr", "ar", "asi", "emv", "mcst", "cyc", "cys")


QUERIES["all_indicators"] = _all_indicators
