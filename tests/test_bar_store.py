"""The store of bars: upserts against plain ones, rewritten files, plans without a shuffle."""

import datetime as dt
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.operators.market import upsert
from quantloom.sources.bar_store import BarStore
from quantloom.windows import lag, mean

SCHEMA = "symbol string, date date, close double, volume double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def bars(spark, years=(2019, 2020, 2021), symbols=8):
    return frame(spark, [(f"s{s}", dt.date(y, 1, 1) + dt.timedelta(days=7 * i), float(s * 100 + i), 1.0) for y in years for s in range(symbols) for i in range(30)])


@pytest.fixture
def store(spark, tmp_path):
    name = f"store_{uuid.uuid4().hex}"
    made = BarStore.create(spark, name, SCHEMA, str(tmp_path / "store"), buckets=4)
    yield made
    spark.sql(f"DROP TABLE {name}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(store):
    return {p: p.stat().st_mtime_ns for p in Path(store.path).rglob("*.parquet")}


def test_upserts_equal_plain_ones_and_touch_their_periods(spark, store):
    first = bars(spark)
    assert store.upsert(first, "a") == [2019, 2020, 2021]
    before = files(store)
    change = frame(spark, [("s1", dt.date(2020, 1, 8), -1.0, 5.0), ("new", dt.date(2020, 3, 1), 7.0, 1.0), ("new", dt.date(2020, 12, 31), None, None)])
    assert store.upsert(change, "b") == [2020]
    after = files(store)
    old = {p for p in before if "_period=2020" not in str(p)}
    assert old and all(after[p] == before[p] for p in old) and not {p for p in before if "_period=2020" in str(p)} & set(after)
    assert rows(store.read()) == rows(upsert(first, change, ("symbol", "date")))


def test_a_batch_counts_once(spark, store):
    store.upsert(bars(spark), "a")
    want, seen = rows(store.read()), files(store)
    assert store.upsert(frame(spark, [("s1", dt.date(2020, 1, 8), -1.0, 5.0)]), "a") == []
    assert rows(store.read()) == want and files(store) == seen
    again = BarStore(spark, store.name)
    assert again.has("a") and not again.has("b") and (again.by, again.buckets, again.columns) == ("year", 4, ["symbol", "date", "close", "volume"])


def test_a_batch_that_died_is_given_again(spark, store, monkeypatch):
    store.upsert(bars(spark), "a")
    change = frame(spark, [("s1", dt.date(2020, 1, 8), -1.0, 5.0), ("s1", dt.date(2021, 1, 8), -2.0, 5.0)])
    whole = BarStore._rewrite

    def dies(self, new, periods):
        whole(self, new.filter("_period = 2020"), [2020])
        raise RuntimeError("lost")

    monkeypatch.setattr(BarStore, "_rewrite", dies)
    with pytest.raises(RuntimeError):
        store.upsert(change, "b")
    monkeypatch.undo()
    assert not store.has("b") and store.upsert(change, "b") == [2020, 2021]
    assert rows(store.read()) == rows(upsert(bars(spark), change, ("symbol", "date")))


def test_nulls_repeats_empty_batches_and_other_columns(spark, store):
    odd = [(None, dt.date(2020, 1, 1), 1.0, 1.0), ("a", None, 2.0, 1.0), (None, None, None, None), ("a", dt.date(2020, 1, 1), 3.0, 1.0), ("a", dt.date(2020, 1, 1), 4.0, None), ("a", dt.date(2020, 1, 1), None, 9.0)]
    assert store.upsert(frame(spark, odd), "a/1 ü") == [None, 2020]
    want = [(None, dt.date(2020, 1, 1), 1.0, 1.0), ("a", None, 2.0, 1.0), (None, None, None, None), ("a", dt.date(2020, 1, 1), 4.0, None)]
    assert rows(store.read()) == sorted(want, key=str)
    wider = frame(spark, [("a", None, 8.0, 8.0), (None, dt.date(2020, 1, 1), 9.0, 9.0)]).withColumns({"_key": F.lit(1), "_r": F.lit(2), "extra": F.lit(3)})
    store.upsert(wider, "b")
    assert rows(store.read()) == sorted([(None, dt.date(2020, 1, 1), 9.0, 9.0), ("a", None, 8.0, 8.0), want[2], want[3]], key=str)
    assert store.upsert(frame(spark, odd).limit(0), "c") == [] and store.has("c")
    assert len(rows(store.read(dt.date(2019, 1, 1), dt.date(2020, 1, 1)))) == 2
    with pytest.raises(ValueError):
        BarStore.create(spark, "refused", SCHEMA + ", _period int", store.path)
    with pytest.raises(ValueError):
        BarStore.create(spark, "refused", SCHEMA, store.path, by="week")


def test_windows_and_joins_do_not_shuffle_and_ranges_prune(spark, store, tmp_path):
    store.upsert(bars(spark), "a")
    other = BarStore.create(spark, f"store_{uuid.uuid4().hex}", "symbol string, date date, factor double", str(tmp_path / "other"), buckets=4)
    other.upsert(bars(spark).select("symbol", "date", (F.col("close") * 0 + 2).alias("factor")), "a")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    windowed = store.read().withColumns({"m": mean("close", 5), "p": lag("close")})
    assert "Exchange" not in plan(windowed)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = store.read().join(other.read(), ["symbol", "date"]).withColumn("m", mean(F.col("close") * F.col("factor"), 5))
        assert "Exchange" not in plan(joined) and joined.count() == 720
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    some = store.read(dt.date(2020, 1, 10), dt.date(2020, 2, 10))
    assert {p.split("_period=")[1][:4] for (p,) in some.select("_metadata.file_path").distinct().collect()} == {"2020"}
    assert "PartitionFilters: [isnotnull(_period" in plan(some) and rows(some) == rows(bars(spark).filter("date between '2020-01-10' and '2020-02-10'"))
    spark.sql(f"DROP TABLE {other.name}")


def test_a_stream_upserts_its_batches(spark, store, tmp_path):
    for i in range(2):
        frame(spark, [("s1", dt.date(2020, 1, 1 + j), float(i * 10 + j), 1.0) for j in range(i, 3)]).write.mode("append").parquet(str(tmp_path / "in"))
        query = store.sink(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "bars").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert [r[2] for r in rows(store.read())] == [0.0, 11.0, 12.0] and store.has("bars-0") and store.has("bars-1")
