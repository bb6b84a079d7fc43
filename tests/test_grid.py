"""Parameter grids as data: equal to one plan a combination, of constant size."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest, signals
from quantloom.operators.grid import signal_grid

SCHEMA = "symbol string, date timestamp_ntz, close double, _rows int, own string"


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(4), []
    for symbol, n in (("long", 900), ("short", 12), ("one", 1), (None, 60), ("flat", 80)):
        price = 50
        for i in range(n):
            price = price if symbol == "flat" else max(1, price + rng.randint(-2, 2))
            rows.append((symbol, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i * 7), float(price) if rng.random() > 0.03 else None, 1, "x"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name, params", [("ma_state", {"short": [1, 5, 9], "long": [7, 40]}), ("trend_following", {"short": [3, 10], "long": [8, 20]}), ("momentum", {"n": [1, 4, 30]})])
def test_equal_to_a_plan_for_each_combination(bars, name, params):
    want = rows(backtest.grid(bars, getattr(signals, name), params))
    for size in (None, 50):
        assert rows(signal_grid(bars, name, params, size=size)) == want


def test_turns_give_the_same_trades(bars):
    some = bars.filter("symbol is not null and close is not null")
    params = {"short": [2, 3, 5], "long": [6, 11]}
    whole, few = (signal_grid(some, "ma_state", params, size=50, turns=t) for t in (False, True))
    assert rows(backtest.trades(few)) == rows(backtest.trades(whole)) and few.count() < whole.count() / 2
    assert few.filter("signal = 'hold'").count() == 0


def test_the_plan_does_not_grow_with_the_grid(bars):
    plan = lambda n: signal_grid(bars, "ma_state", {"short": list(range(1, n + 1)), "long": [60]})._jdf.queryExecution().sparkPlan()
    nodes = lambda p: 1 + sum(nodes(p.children().apply(i)) for i in range(p.children().size()))
    assert nodes(plan(2)) == nodes(plan(50))


def test_no_bars_no_combinations_and_wrong_names(bars):
    params = {"short": [2], "long": [6]}
    assert signal_grid(bars.limit(0), "ma_state", params).collect() == []
    assert signal_grid(bars, "ma_state", {"short": [], "long": [6]}).collect() == []
    for bad in ({"short": [2]}, {"short": [0], "long": [5]}):
        with pytest.raises(ValueError):
            signal_grid(bars, "ma_state", bad)
    assert signal_grid(bars.withColumn("close", F.col("close").cast("decimal(10,2)")), "ma_state", params).schema["close"].dataType.simpleString() == "double"
