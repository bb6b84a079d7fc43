"""Small hand-made series, properties and the operators without a query."""

import datetime as dt
import math
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.functions.registry import indicators, register_indicator, with_indicators
from quantloom.operators import adjust, alpha, backtest, costs, factor_analysis, market, performance, prep, signals
from quantloom.plans.pipeline import compose, run_steps
from quantloom.sources.bars import bars_hour
from quantloom.sources.day_file import pack_day, read_day_binary, read_day_files
from quantloom.sources.kline import kline, universe

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, amount double"


def series(spark, closes, symbol="a", start=dt.date(2024, 1, 1)):
    rows = [(symbol, start + dt.timedelta(i), c, c + 1.0, c - 1.0, c, 10.0, c * 10) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").select(name).collect()]


def test_rising_flat_and_single_series(spark):
    up = with_indicators(series(spark, [float(i) for i in range(1, 31)]), ["rsi", "psy", "obv", "ma"])
    assert set(column(up, "rsi")) == {100.0} and column(up, "obv")[-1] == 290.0 and column(up, "ma5")[:3] == [1.0, 1.5, 2.0]
    flat = with_indicators(series(spark, [5.0] * 30), ["kdj", "roc", "emv", "vr"])
    assert column(flat, "roc")[12:] == [0.0] * 18 and len(column(flat, "k")) == 30
    one = with_indicators(series(spark, [5.0]), ["sar", "boll", "macd", "dmi"])
    r = one.first()
    assert r.sar is None and r.up is None and r.macd == 0.0


def test_sar_by_hand_and_textbook(spark):
    df = series(spark, [10.0, 11.0, 12.0, 9.0, 8.0])
    got = column(with_indicators(df, ["sar"]), "sar")
    assert got[0] == 9.0 and got[1] == pytest.approx(max(9 + 0.02 * (11 - 9), 9))
    text = column(with_indicators(df, ["sar"], sar={"textbook": True}), "sar")
    assert text[2] <= 10.0


def test_symbols_do_not_mix_and_partitions_do_not_matter(spark, sf_dir):
    bars = bars_hour(spark, sf_dir)
    names = ["macd", "rsi", "kdj", "boll", "adr"]
    from quantloom.functions.breadth import with_breadth

    all_ = {(r.symbol, r.date): (r.macd, r.rsi, r.k, r.mb) for r in with_indicators(with_breadth(bars), names).collect()}
    one = bars.filter("symbol = 'click'")
    for r in with_indicators(with_breadth(one.repartition(7)), names).collect():
        assert all_[r.symbol, r.date] == pytest.approx((r.macd, r.rsi, r.k, r.mb), nan_ok=True) or r.k is None


def test_properties(spark, sf_dir):
    df = with_indicators(bars_hour(spark, sf_dir), ["rsi", "psy", "boll", "macd", "wr"])
    bad = df.filter("rsi < -1e-9 or rsi > 100 + 1e-9 or psy < 0 or psy > 100 or up < mb - 1e-9 or dn > mb + 1e-9 or abs(macd_hist - (macd - macd_signal)) > 1e-9 or wr < -1e-9 or wr > 100 + 1e-9")
    assert bad.count() == 0


def test_registry(spark):
    register_indicator("twice", lambda df, by=2: df.withColumn("twice", F.col("ma") * by), needs=("ma",))
    assert column(with_indicators(series(spark, [1.0, 3.0]), ["twice"], twice={"by": 3}), "twice") == [3.0, 6.0]
    assert {"ma", "sar", "abi", "twice"} <= set(indicators()) and len(indicators()) >= 34
    with pytest.raises(KeyError):
        with_indicators(series(spark, [1.0]), ["nothing"])


def test_one_shuffle_for_many_indicators(spark, sf_dir):
    df = with_indicators(bars_hour(spark, sf_dir), ["ma", "macd", "rsi", "kdj", "boll", "obv", "cci"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 2 and "BatchEvalPython" not in plan and "ArrowEval" not in plan


def test_week_of_the_year_end(spark):
    days = series(spark, [float(i) for i in range(1, 10)], start=dt.date(2024, 12, 28))
    plain = {(r.year, r.part): r.close for r in prep.resample(days).collect()}
    iso = {(r.year, r.part): r.close for r in prep.resample(days, iso_year=True).collect()}
    assert plain == {(2024, 52): 2.0, (2024, 1): 4.0, (2025, 1): 9.0} and iso == {(2024, 52): 2.0, (2025, 1): 9.0}


def test_fill_and_samples(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, i), v) for i, v in ((1, None), (2, 2.0), (3, None), (4, 4.0))], "symbol string, date date, close double")
    assert column(prep.fill(df, "forward", ("close",)), "close") == [None, 2.0, 2.0, 4.0]
    assert column(prep.fill(df, "mean", ("close",)), "close") == [3.0, 2.0, 3.0, 4.0]
    long = series(spark, [float(i % 7) for i in range(200)])
    kept = column(prep.sample_adaptive(long, 50), "date")
    assert len(kept) == 50 and kept[0] == dt.date(2024, 1, 1) and kept[-1] == dt.date(2024, 1, 1) + dt.timedelta(199)
    assert prep.preprocess(df).columns == df.columns and prep.convert_types(long).schema["close"].dataType.simpleString() == "float"
    assert column(prep.nan_to_zero(long.withColumn("close", F.lit(float("nan")))), "close")[:2] == [0.0, 0.0]


def test_split_event(spark):
    bars = series(spark, [10.0] * 5 + [5.0] * 5)
    events = spark.createDataFrame([("a", dt.date(2024, 1, 6), 0.0, 10.0, None, None)], "symbol string, ex_date date, cash_div double, share_div double, rights_issue_price double, rights_issue_ratio double")
    factors = adjust.with_event_factors(bars, events)
    assert factors.first().factor == 0.5 and factors.first().p0 == 10.0  # ten for ten, given per ten shares
    out = adjust.with_adjusted_prices(adjust.adjustment_factors(bars, factors))
    assert column(out, "qfq_close") == [5.0] * 10 and column(out, "hfq_close") == [10.0] * 10
    assert adjust.with_event_factors(bars, events.withColumn("cash_div", F.lit(50.0)), live=True).first().factor is None
    assert column(adjust.swap_prices(out, "qfq"), "close") == [5.0] * 10
    table = adjust.adjustment_factors(bars, factors).select("symbol", "date", "qfq_factor", "hfq_factor")
    assert column(adjust.apply_factors(bars, table.filter("date < '2024-01-04'")), "qfq_factor")[-1] == 1.0
    assert column(adjust.apply_factors(bars, table.filter("date < '2024-01-04'"), fill=True), "qfq_factor")[-1] == 0.5
    texts = spark.createDataFrame([("10:3",), ("0.5",), ("x",), (None,), ("10：5",)], "t string")
    assert [r.r for r in texts.select(adjust.rights_ratio(F.col("t")).alias("r")).collect()] == [0.3, 0.5, None, None, 0.5]


def test_market_helpers(spark):
    df = spark.createDataFrame([("600000", " 2024-01-31 "), ("sh688001", "20240131"), ("300750", "2024/01/31"), ("430047", "nan"), ("510300", None)], "code string, d string")
    r = df.select(market.board(F.col("code")).alias("b"), market.normalise_date(F.col("d")).alias("d"), market.normalise_text(F.col("d")).alias("t")).collect()
    assert [x.b for x in r] == ["Shanghai main", "STAR", "ChiNext", "Beijing", "fund"]
    assert [str(x.d) for x in r] == ["2024-01-31"] * 3 + ["None", "None"] and r[3].t is None
    old = spark.createDataFrame([(1, "a"), (2, "")], "symbol int, name string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "symbol int, name string")
    assert sorted((x.symbol, x.name) for x in market.fill_blanks(old, new).collect()) == [(1, "a"), (2, "y"), (3, "z")]


def test_backtest_by_hand(spark):
    df = series(spark, [10.0, 20.0, 40.0, 20.0]).withColumn("signal", F.element_at(F.array(*map(F.lit, ("sell", "buy", "sell", "sell"))), F.dayofmonth("date")))
    done = backtest.trades(df, 1000.0)
    rows = done.orderBy("trade").collect()
    assert [(r.signal, r.shares) for r in rows] == [("buy", 50.0), ("sell", 50.0)]
    cost = 5 + 5 + 2000 * 0.001 + 50 * 20 * 0.0001
    assert rows[1].capital == pytest.approx(2000 - cost) and rows[1].cost == pytest.approx(cost)
    assert column(backtest.equity(df, done, 1000.0), "equity") == pytest.approx([1000, 1000, 2000 - cost, 2000 - cost])
    p = performance.performance(backtest.equity(df, done, 1000.0), done).first()
    assert p.winning_rate == 100 and p.trades_count == 1 and p.max_drawdown == 0
    total = backtest.portfolio_equity(df, backtest.trades(df, 500.0), 2, 1000.0).orderBy("date").collect()
    assert total[0].equity == 1000.0
    twice = backtest.portfolio_equity(df, backtest.trades(df, 500.0), 2, 1000.0, compat=True).orderBy("date").first()
    assert twice.equity == 2000.0


def test_grid_and_sensitivity(spark, sf_dir):
    long = backtest.grid(bars_hour(spark, sf_dir), signals.ma_state, {"short": [3, 5], "long": [10, 20]})
    metrics = performance.performance(backtest.equity(long, backtest.trades(long))).join(long.select("param_id", "short", "long").distinct(), "param_id")
    assert metrics.count() == 4 * bars_hour(spark, sf_dir).select("symbol").distinct().count()
    assert backtest.sensitivity(metrics, ["short", "long"]).count() == 6
    assert backtest.best(metrics, "max_drawdown").groupBy("symbol").count().filter("count > 1").count() == 0


def test_orders_and_costs(spark):
    one = spark.range(1)
    price = F.lit(10.0)
    fills = [costs.order_fills(*a) for a in (("market", "buy", price), ("limit", "buy", price, F.lit(9.0)), ("limit", "sell", price, F.lit(9.0)), ("stop", "sell", price, None, F.lit(10.0)), ("stop_limit", "buy", price, F.lit(11.0), F.lit(9.0), F.lit(True)))]
    assert list(one.select(*fills).first()) == [True, False, True, True, True]
    us = one.select(costs.breakdown(F.lit(100.0), price, price, "us").alias("c")).first().c
    assert us.commission == 0 and us.total == pytest.approx(2000 * 0.0001411)


def test_day_files(spark, tmp_path):
    rows = [(20240102, 1.5, 2.0, 1.25, 1.75, 100, 5000), (20240103, 1.75, 2.5, 1.5, 2.25, 200, 9000)]
    (tmp_path / "sh600000.day").write_bytes(pack_day(rows) + b"cut off")
    (tmp_path / "sz000001.day").write_bytes(pack_day(rows + [(20249999, 1, 1, 1, 1, 1, 1)]))
    for df in (read_day_files(spark, str(tmp_path)), read_day_binary(spark, str(tmp_path))):
        got = df.orderBy("symbol", "date").collect()
        assert [(r.symbol, str(r.date), r.open, r.high, r.low, r.close, r.volume, r.amount) for r in got[:2]] == [("sh600000", "2024-01-02", 1.5, 2.0, 1.25, 1.75, 100.0, 5000.0), ("sh600000", "2024-01-03", 1.75, 2.5, 1.5, 2.25, 200.0, 9000.0)]
        assert len(got) == 4
    assert read_day_files(spark, str(tmp_path), max_days=1).filter("symbol = 'sh600000'").first().close == 2.25


def test_pipeline_steps(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    out = run_steps(df, [{"op": "with_columns", "columns": {"x": "close * 2"}}, {"op": "filter", "condition": "x > 2"}, {"op": "sort", "by": ["x"], "descending": True}, {"op": "select", "columns": ["x"]}, {"op": "limit", "n": 1}])
    assert out.collect()[0].x == 6.0
    assert compose(prep.clean, lambda d: d.limit(1))(df).count() == 1
    with pytest.raises(ValueError):
        run_steps(df, [{"op": "explode"}])


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_stands_without_the_training_data_part(tmp_path, with_pipeline):
    """A copy of the repository without that subpackage and its tests still imports, with corpus_pipeline.py or without."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path, dirs_exist_ok=True, ignore=shutil.ignore_patterns("llm", "__pycache__", ".git"))
    if not with_pipeline:
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) > 90


def test_signals_by_hand(spark):
    """Closes chosen so that each rule fires at a known bar; a sale leaves no position."""
    from quantloom.operators import signals

    def run(rule, closes, **options):
        rows = rule(series(spark, closes), **options).orderBy("date").collect()
        return [(r.signal, r.position) for r in rows]

    held = ("hold", 0)
    # means of 1 and 2 bars: above at the third bar, below at the fifth
    assert run(signals.trend_following, [2.0, 2.0, 3.0, 3.0, 1.0], short=1, long=2) == [held, held, ("buy", 1), ("hold", 1), ("sell", 0)]
    assert run(signals.momentum, [4.0, 5.0, 6.5, 6.0, 3.0], n=1) == [held, ("buy", 1), ("buy", 1), ("sell", 0), ("sell", 0)]
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate([50.0, 20.0, 50.0, 80.0, 50.0])], "symbol string, date int, rsi double")
    got = [(r.signal, r.position) for r in signals.mean_reversion(frame).orderBy("date").collect()]
    assert got == [held, ("buy", 1), ("hold", 1), ("sell", 0), ("hold", 0)]


def test_lines_that_touched_do_not_cross(spark):
    from quantloom.operators import signals

    flat = [5.0] * 40
    assert {r.signal for r in signals.macd_state(series(spark, flat + [9.0])).collect()} == {"hold"}  # equal at the bar before
    crossed = signals.macd_state(series(spark, [float(40 - i) for i in range(45)] + [20.0, 40.0])).collect()
    assert "buy" in {r.signal for r in crossed}


def test_constant_columns_have_no_correlation(spark):
    from quantloom.operators import alpha
    from quantloom.operators.backtest import sensitivity

    df = spark.createDataFrame([("a", i, 1.0, float(i), float(i % 3)) for i in range(6)], "symbol string, date int, f double, g double, target double")
    got = {r.factor: (r.ic, r.rank_ic, r.n) for r in alpha.information_coefficients(df, ["f", "g"]).collect()}
    assert got["f"] == (None, None, 6) and got["g"][0] is not None
    assert {(r.a, r.b): r.r is None for r in alpha.correlations(df, ["f", "g"]).collect()} == {("f", "f"): True, ("f", "g"): True, ("g", "g"): False}
    assert {r.factor: r.weight for r in alpha.factor_weights(df, ["f", "g"]).collect()}["g"] == 1.0
    flat = alpha.volume_price(series(spark, [5.0] * 25)).orderBy("date").collect()
    assert flat[-1].volume_price_correlation is None and flat[0].volume_price_correlation == 0.0
    metrics = spark.createDataFrame([(1, 0.5, 1.0, 0.1), (2, 0.5, 2.0, 0.2)], "p int, total_return double, sharpe_ratio double, max_drawdown double")
    assert {r.metric: r.r for r in sensitivity(metrics, ["p"]).collect()} == {"total_return": None, "sharpe_ratio": pytest.approx(1.0), "max_drawdown": pytest.approx(1.0)}


def test_quantiles_and_ranks_by_hand(spark):
    import numpy as np
    from quantloom.operators import alpha

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=400), np.zeros(300)])
    df = spark.createDataFrame([(float(v), float(i % 7)) for i, v in enumerate(x)], "x double, target double")
    at = [0.0, 0.2, 0.4, 0.5, 1.0]
    one = alpha.exact_percentiles(df, "x", at, pieces=8, at_once=0).first()
    assert one.n == 700 and one.e == pytest.approx(np.percentile(x, [100 * p for p in at]).tolist())
    ranked = alpha.average_ranks(df.withColumn("g", F.lit("a")), "g", "x", "rank", pieces=8, at_once=0).collect()
    order = np.sort(x)
    assert all(r["rank"] == (np.searchsorted(order, r.x) + np.searchsorted(order, r.x, "right") + 1) / 2 for r in ranked)
    # more than 40 % zeros: an edge repeats, so a bucket is empty and counts as 0
    rows = {r.bucket: r for r in alpha.quantile_test(df, "x").collect()}
    edges = np.percentile(x, [0, 20, 40, 60, 80, 100])
    y = np.arange(700) % 7
    for b in range(1, 6):
        inside = (x >= edges[b - 1]) & (x < edges[b])
        assert rows[b].n == inside.sum() and rows[b].mean_return == pytest.approx(y[inside].mean() if inside.any() else 0.0)
        assert rows[b].long_short == pytest.approx(rows[5].mean_return - rows[1].mean_return)
    assert any(r.n == 0 for r in rows.values())
    assert alpha.quantile_test(df.limit(3), "x").count() == 0


def test_index_and_fund_kinds(spark):
    rows = [("000300.SH", "沪深300"), ("399006.SZ", "创业板指"), ("899050.BJ", "北证50"), ("000001", None), ("000015.sh", "红利指数"), ("x.XX", "全行业主题")]
    df = spark.createDataFrame(rows, "code string, name string")
    got = {r.code: tuple(r.m) for r in df.select("code", market.index_meta(F.col("code"), F.col("name")).alias("m")).collect()}
    assert got["000300.SH"] == ("上交所", "综合指数", "宽基", "市值加权") and got["399006.SZ"][1:3] == ("板块指数", "创业板")
    assert got["899050.BJ"][:3] == ("北交所", "板块指数", "北交所") and got["000001"][:3] == ("交易所", "综合指数", "通用")
    assert got["000015.sh"][:3] == ("上交所", "策略指数", "红利") and got["x.XX"][1:3] == ("行业指数", "行业")
    funds = [("510300.SH", "300ETF", "ETF"), ("161005.SZ", "x", "LOF"), ("600000.SH", "bank", None), ("159915", "ETF", None), ("000001.OF", "某基金", "基金"), ("500001.sh", None, "基金")]
    df = spark.createDataFrame(funds, "code string, name string, want string")
    assert all(r.want == r.got for r in df.select("want", market.fund_type(F.col("code"), F.col("name")).alias("got")).collect())


def test_undated_dividends_and_momentum_period(spark):
    from quantloom.operators import ranking

    rows = [("a", None, 2020, 1.0, 0.0, None, None, 1, 1), ("a", None, 2020, 1.0, 0.0, None, None, 2, 2), ("a", None, 2020, 2.0, 0.0, None, None, 1, 3), ("b", None, 2020, 1.0, 0.0, None, None, 1, 4)]
    df = spark.createDataFrame(rows, "symbol string, ex_date date, dividend_year int, cash_div double, share_div double, rights_issue_price double, rights_issue_ratio double, updated_at int, id int")
    assert sorted(r.id for r in adjust.clean_dividends(df).collect()) == [2, 3, 4]
    bars = series(spark, [float(i) for i in range(1, 31)])
    for period, past in ((5, 26.0), (20, 11.0), (99, 1.0)):
        r = ranking.score(bars, "momentum", period=period).first()
        assert r.score == pytest.approx(min(1.0, (30.0 - past) / past * 2))


def test_indicator_csv(spark, tmp_path):
    from quantloom.sources.indicator_csv import read_indicator_csv, write_csv

    (tmp_path / "a.csv").write_text("日期,MA5,DIF,MACD,other\n2024/1/2,1.5,0.1,x,9\n2024-01-03,,0.2,0.4,9\nnever,1,1,1,1\n", encoding="utf-8")
    df = read_indicator_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["date", "ma5", "macd", "macd_hist"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(dt.date(2024, 1, 2), 1.5, 0.1, None), (dt.date(2024, 1, 3), None, 0.2, 0.4), (None, 1.0, 1.0, 1.0)], key=str)
    (tmp_path / "b.csv").write_text("x,MA5\n1,2\n")
    with pytest.raises(ValueError):
        read_indicator_csv(spark, str(tmp_path / "b.csv"))
    write_csv(df, str(tmp_path / "out"))
    assert read_indicator_csv(spark, str(tmp_path / "out")).filter("ma5 = 1.5").count() == 1


def test_plain_factors_wait_for_full_windows(spark):
    bars = spark.createDataFrame([("a", i, 9.0 + i, 11.0 + i, 8.0 + i, 10.0 + i, 1.0, 1.0) for i in range(30)], "symbol string, date long, open double, high double, low double, close double, volume double, amount double")
    rows = factor_analysis.with_factors(bars).orderBy("date").collect()
    first = {c: next((r["date"] for r in rows if r[c] is not None), None) for c in ("macd", "rsi", "boll_mid", "kdj_k", "ma5", "atr", "wr", "cci", "mom1m", "mom3m")}
    assert first == {"macd": 0, "rsi": 14, "boll_mid": 19, "kdj_k": 8, "ma5": 4, "atr": 13, "wr": 13, "cci": 26, "mom1m": 20, "mom3m": None}
    end = rows[-1]
    assert end["ma5"] == pytest.approx(37.0) and end["rsi"] == pytest.approx(100.0) and end["atr"] == pytest.approx(3.0)
    assert end["wr"] == pytest.approx(100 / 16) and end["kdj_k"] == pytest.approx(10 / 11 * 100) and end["cci"] == pytest.approx(6.5 / (0.015 * 6.5))
    assert end["mom1m"] == pytest.approx(20 / 19)


def test_factor_validity_by_hand(spark):
    """Closes 100, 110, 99, 108.9, 98.01, ...: returns of 0.1 and -0.1 in turn; x follows them."""
    closes, rows = [100.0], []
    for i in range(10):
        closes.append(closes[-1] * (1.1 if i % 2 == 0 else 0.9))
    for i, c in enumerate(closes):
        rows.append(("a", i, c, None if i == 0 else float(i) if i % 2 else -float(i), 5.0))
    df = spark.createDataFrame(rows, "symbol string, date int, close double, x double, flat double")
    got = {r["factor"]: r for r in factor_analysis.validity(df, ["x", "flat"]).collect()}
    x, flat = got["x"], got["flat"]
    assert x["n"] == 10 and x["ic"] > 0.8 and x["long_return"] == pytest.approx(0.1) and x["short_return"] == pytest.approx(-0.1) and x["long_short_return"] == pytest.approx(0.2)
    assert flat["n"] == 10 and flat["ic"] is None and flat["long_short_return"] == 0
    both = factor_analysis.combine(df, ["x", "flat"]).orderBy("date").collect()
    assert both[0]["factor_combination"] == 5.0 and both[3]["factor_combination"] == 8.0
    assert factor_analysis.validity(df.filter("date < 0"), ["x"]).count() == 0


def test_kline_reader(spark):
    daily = spark.createDataFrame([("a", d, 10.0, 10.0, 10.0, 10.0) for d in range(1, 6)] + [("b", 3, 4.0, 4.0, 4.0, 4.0)], "symbol string, date int, open double, high double, low double, close double")
    factors = spark.createDataFrame([("a", 1, 0.5, 2.0), ("a", 3, 0.25, 4.0)], "symbol string, date int, qfq_factor double, hfq_factor double")
    got = kline(daily, factors, start=2, end=4, adjust="qfq").orderBy("symbol", "date").select("symbol", "date", "close", "hfq_close").collect()
    assert [tuple(r) for r in got] == [("a", 2, 10.0, 10.0), ("a", 3, 2.5, 40.0), ("a", 4, 2.5, 40.0), ("b", 3, 4.0, 4.0)]
    assert kline(daily, None, ["b"]).collect()[0]["qfq_close"] == 4.0
    assert kline(daily, factors, []).count() == 0
    with pytest.raises(ValueError):
        kline(daily, factors, adjust="both")


def test_valid_codes(spark):
    codes = ["600000", "603999", "604000", "688999", "689000", "900001", "200001", "000999", "399001", "002999", "003000", "300999", "301000", "830000", "920999", "921000", "510300", "588000", "159915", "160000", "180000", "60000", "60000a", "", None]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    valid = {r["code"] for r in universe(df.unionAll(df)).collect()}
    assert valid == {"600000", "603999", "688999", "000999", "399001", "002999", "300999", "830000", "920999", "510300", "588000", "159915", "160000"}


def test_bar_with_a_low_of_zero_has_infinite_range(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(i), 5.0, 6.0, 0.0 if i == 3 else 4.0, 5.0, 1.0, 5.0) for i in range(30)]
    rows += [("b", d, 0.0 if i == 3 else o, h, lo, c, v, a) for i, (_, d, o, h, lo, c, v, a) in enumerate(rows[:30])]
    out = alpha.garman_klass(spark.createDataFrame(rows, SCHEMA), (20,))
    got = column(out.filter("symbol = 'a'"), "gk_volatility_20")
    assert got[:20] == [0.0] * 20 and got[20:24] == [math.inf] * 4 and all(0 < x < math.inf for x in got[24:])
    both = column(out.filter("symbol = 'b'"), "gk_volatility_20")  # infinite less infinite is no number
    assert all(math.isnan(x) for x in both[20:24]) and both[24:] == got[24:]


def test_cleaning_only_scans_the_bars(spark, sf_dir):
    import re

    plan = prep.clean_zscore(bars_hour(spark, sf_dir), t=2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and not re.search(r"(?<!Broadcast)Exchange", plan)
