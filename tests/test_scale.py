"""Long symbols in slices, wide windows in blocks: equal to the plain windows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from quantloom.functions.registry import with_indicators
from quantloom.operators import long_symbols
from quantloom.operators.long_symbols import REACH, RUNNING, fades, long_indicators, long_rolling, numbered, over_slices, reach
from quantloom.operators.rolling import rolled, shared_rolling
from quantloom.sources.day_file import DayFileReader, PushingDayFileReader, read_day_files, write_day_files
from quantloom.windows import last

SCHEMA = "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double, amount double"


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(9), []
    for symbol, n in (("long", 3000), ("short", 40), ("one", 1)):
        price = 50.0
        for i in range(n):
            price = max(1.0, price + rng.gauss(0, 1))
            o, c = price + rng.gauss(0, 0.3), price
            rows.append((symbol, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i * 7 + (i > 500) * 9000), o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, float(rng.randint(0, 5)), 10.0 * rng.random()))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def close(a, b):
    if a is None or b is None or math.isnan(a) or math.isnan(b):
        return (a is None or math.isnan(a)) == (b is None or math.isnan(b))
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def equal(got, want):
    made = [c for c in want.columns if c not in ("symbol", "date", "open", "high", "low", "close", "volume", "amount")]
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ({(r.symbol, r.date): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        for c in made:
            assert close(a[k][c], b[k][c]), (k, c, a[k][c], b[k][c])


def test_every_indicator_in_slices(bars):
    names = [*REACH, *RUNNING]
    equal(long_indicators(bars, names, size=700), with_indicators(bars, names))


def test_other_windows_and_slices_shorter_than_the_reach(bars):
    params = {"ma": {"windows": (7, 130)}, "macd": {"slow": 40}, "wr": {"windows": (300, 6)}, "mcst": {"windows": (30,)}}
    names = ["ma", "macd", "wr", "rsi", "mcst", "obv"]
    assert reach("ma", windows=(7, 130)) == 130 and reach("macd", slow=40) == fades(40) + fades(9)
    equal(long_indicators(bars, names, size=100, **params), with_indicators(bars, names, **params))


def test_slices_bound_the_rows_of_a_task(bars):
    table = numbered(bars, size=200)
    assert sorted(r[0] for r in table.filter("symbol = 'long'").orderBy("date").select("_at").collect()) == list(range(3000))
    held = over_slices(table, lambda df: df.withColumn("_held", F.count("*").over(long_symbols.Window.partitionBy("symbol"))), 50, 200)
    assert held.agg(F.max("_held")).first()[0] <= 250 and held.count() == bars.count()


def test_one_slice_and_rows_without_a_symbol(bars):
    some = bars.filter("symbol <> 'long'").unionAll(bars.filter("symbol = 'short'").withColumn("symbol", F.lit(None).cast("string")))
    names = ["ma", "rsi", "obv", "mcst", "cyc"]
    for size in (100_000, 15):
        equal(long_indicators(some, names, size=size), with_indicators(some, names))


def test_no_rows_and_unknown_names(bars):
    assert long_indicators(bars.limit(0), ["ma", "obv"], size=10).collect() == []
    with pytest.raises(KeyError):
        long_indicators(bars, ["sar"])


@pytest.mark.parametrize("n", [1, 2, 39, 40, 250, 5000])
def test_rolled_equals_sliding(bars, n):
    holes = bars.withColumn("close", F.when(F.col("volume") > 0, F.col("close")))
    made = {"lo": ("min", "low"), "hi": ("max", "close"), "total": ("sum", "close"), "many": ("count", "close"), "avg": ("mean", F.col("close") * 2)}
    plain = {"lo": F.min("low"), "hi": F.max("close"), "total": F.sum("close"), "many": F.count("close"), "avg": F.avg(F.col("close") * 2)}
    equal(rolled(holes, n, made, wide=1), holes.withColumns({k: c.over(last(n)) for k, c in plain.items()}))


def test_a_wide_window_sorts_but_does_not_slide(bars):
    plan = rolled(bars, 2000, {"hi": ("max", "high")})._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, -1999, currentrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# ---- .day files


def walk(n, start=dt.date(2001, 1, 1)):
    return [(start + dt.timedelta(i), 1.0 + i % 90, 2.0 + i % 90, 0.5 + i % 90, 1.25 + i % 90, float(i), 2.0 * i) for i in range(n)]


@pytest.fixture(scope="module")
def days(spark):
    rows = [(s, *r) for s, n in (("sh600000", 5000), ("sz000001", 300), ("bj1", 1)) for r in walk(n)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double").repartition(6)


def test_day_files_round_trip_in_splits(spark, days, tmp_path):
    write_day_files(days, str(tmp_path / "d"))
    back = read_day_files(spark, str(tmp_path / "d"), records_per_split="700")
    assert back.rdd.getNumPartitions() == 8 + 1 + 1
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, days.collect()))
    low, high = dt.date(2003, 3, 1), dt.date(2003, 4, 1)
    some = read_day_files(spark, str(tmp_path / "d"), low=low, high=high, records_per_split="700")
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in days.collect() if low <= r.date <= high)
    assert sorted(r.close for r in read_day_files(spark, str(tmp_path / "d"), max_days=2).filter("symbol = 'sz000001'").collect()) == [29.25, 30.25]


def test_a_range_reads_few_bytes(spark, days, tmp_path):
    write_day_files(days, str(tmp_path / "d"))
    whole, some = (PushingDayFileReader({"path": str(tmp_path / "d")}) for _ in range(2))
    pushed = [GreaterThanOrEqual(("date",), dt.date(2003, 3, 1)), LessThan(("date",), dt.date(2003, 4, 1)), EqualTo(("symbol",), "x")]
    assert list(some.pushFilters(pushed)) == pushed
    n = [sum(b.num_rows for p in r.partitions() for b in r.read(p)) for r in (whole, some)]
    assert n[0] == 5301 and 31 <= n[1] <= 32
    assert whole.bytes_read == 5301 * 32 and some.bytes_read < 100 * 32
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_day_files(spark, str(tmp_path / "d")).filter(F.col("date").between(dt.date(2003, 3, 1), dt.date(2003, 3, 31)))
        assert df.count() == 31 and df.filter("symbol = 'bj1'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_failed_writes_leave_the_folder_alone(days, tmp_path):
    path = tmp_path / "d"
    write_day_files(days, str(path))
    kept = {p.name: p.read_bytes() for p in path.glob("*.day")}
    assert sorted(kept) == ["bj1.day", "sh600000.day", "sz000001.day"]
    for bad in (days.withColumn("volume", F.when(F.col("volume") == 77, -1.0).otherwise(F.col("volume"))), days.withColumn("symbol", F.when(F.col("symbol") == "bj1", "a/b").otherwise(F.col("symbol")))):
        with pytest.raises(Exception):  # noqa: B017
            write_day_files(bad, str(path))
        assert {p.name: p.read_bytes() for p in path.glob("*.day")} == kept
    with pytest.raises(Exception):  # noqa: B017  one symbol from many tasks
        days.write.format("dayfile").option("path", str(path)).mode("append").save()
    assert {p.name: p.read_bytes() for p in path.glob("*.day")} == kept
    write_day_files(days.filter("symbol = 'bj1'"), str(path), mode="overwrite")
    assert [p.name for p in path.glob("*.day")] == ["bj1.day"]


def test_many_short_files_share_splits(spark, tmp_path):
    rows = [(f"s{i}", dt.date(2024, 1, 1 + j), 1.0 + i, 1.0 + i, 1.0 + i, 1.0 + i, 5.0, 5.0) for i in range(600) for j in range(3)]
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double")
    write_day_files(bars, str(tmp_path / "d"))
    reader = DayFileReader({"path": str(tmp_path / "d"), "records_per_split": "300000"})
    splits = reader.partitions()
    assert [sum(b.num_rows for b in reader.read(p)) for p in splits] == [900, 900]  # a task a file before
    assert all(len(list(reader.read(p))) == 1 for p in splits)
    assert read_day_files(spark, str(tmp_path / "d")).exceptAll(bars).count() == 0 and read_day_files(spark, str(tmp_path / "d")).count() == 1800


def test_wide_windows_of_long_symbols_go_by_slices(spark, sf_dir):
    from quantloom.plans.catalog import QUERIES

    rows = [("a" if i % 3 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 1.0, 2.0 + i * 37 % 101, 0.5 - i * 53 % 89, 1.25 + i * 29 % 97, 1.0, 1.0) for i in range(4000)]
    bars = spark.createDataFrame(rows, "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double, amount double")
    want, got = (sorted(map(tuple, df.select("symbol", "date", *[f"{c}_{n}" for n in (20, 300, 700) for c in ("high", "low", "mean")]).collect())) for df in (shared_rolling(bars, (20, 300, 700)), long_rolling(bars, (20, 300, 700), size=250)))
    assert len(got) == 4000 and all(a == pytest.approx(b) for a, b in zip((r[2:] for r in got), (r[2:] for r in want))) and [r[:2] for r in got] == [r[:2] for r in want]
    plan = QUERIES["rolling_wide"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan  # a symbol was one task's before
