"""The streaming indicators as queries: bars written in slices, streamed until drained, read back."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder
from ..sources.bars import bars_hour
from ..streaming.indicators import stream_indicators
from ..streaming.reconfigure import reconfigured
from .indicator_queries import rounded
from .sqltext import BARS_HOUR, ewm, lag, last, so_far, staged

COLUMNS = ["ma5", "macd", "macd_signal", "rsi14", "mb20", "up20", "wr10", "obv", "dma", "bbi"]


@contextmanager
def _rocksdb(spark: SparkSession):
    """The state store that the streams need; the session's own setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_hour(spark, sf_dir).select("symbol", F.col("date").cast("timestamp").alias("date"), "open", "high", "low", "close", "volume")


def _drain(source: DataFrame, root: str, run: str, **options) -> None:
    """Everything in the source through one query, whose checkpoint and output are called by its run."""
    with _rocksdb(source.sparkSession):
        query = stream_indicators(source, **options).writeStream.format("parquet").option("path", f"{root}/out-{run}").option("checkpointLocation", f"{root}/checkpoint-{run}").trigger(availableNow=True).start()
        query.awaitTermination()


def _result(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    out = spark.read.parquet(path).withColumn("date", F.col("date").cast("timestamp_ntz"))
    return rounded(out.withColumns({c: F.nanvl(c, F.lit(None)) for c in columns}), *columns)


def stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    bars = _bars(spark, sf_dir)
    edges = bars.agg(F.percentile_approx(F.unix_micros("date"), F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e")).first()["e"]
    slices = F.when(F.unix_micros("date") <= edges[0], 0).when(F.unix_micros("date") <= edges[1], 1).otherwise(2)
    for i in range(3):  # three slices in time order, each drained before the next one comes; one checkpoint for all
        bars.filter(slices == i).repartition("symbol").write.mode("append").parquet(f"{root}/bars")
        _drain(spark.readStream.schema(bars.schema).parquet(f"{root}/bars"), root, "all")
    return _result(spark, f"{root}/out-all", COLUMNS)


def _tick(bars: DataFrame) -> DataFrame:
    """A row without a symbol far behind the last bar: the watermark passes all bars."""
    return bars.agg((F.max("date") + F.expr("INTERVAL 30 DAYS")).alias("date")).select(*[F.col("date") if c == "date" else F.lit(None).cast(t).alias(c) for c, t in bars.dtypes])


def out_of_order_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar comes up to 23 hours late, by its hash; four slices of arrival, drained one after the other under a day's watermark."""
    root = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    bars = _bars(spark, sf_dir)
    arrival = F.unix_micros("date") + F.pmod(F.xxhash64("symbol", "date"), F.lit(24)) * 3_600_000_000
    edges = bars.agg(F.percentile_approx(arrival, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e")).first()["e"]
    if edges is None:
        edges = [0, 0, 0]
    slices = F.when(arrival <= edges[0], 0).when(arrival <= edges[1], 1).when(arrival <= edges[2], 2).otherwise(3)
    for i in range(4):
        part = bars.filter(slices == i)
        (part if i < 3 else part.unionByName(_tick(bars))).repartition("symbol").write.mode("append").parquet(f"{root}/bars")
        _drain(spark.readStream.schema(bars.schema).parquet(f"{root}/bars"), root, "all", watermark="1 day", outputs=tuple(COLUMNS))
    return _result(spark, f"{root}/out-all", COLUMNS)


def reconfigured_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs over the first half of the span; then a wider window and eight more, from the old query's state and its bars. Rows
    of the second half."""
    root = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    bars = _bars(spark, sf_dir)
    micros = F.unix_micros("date")
    cut = bars.agg(F.floor((F.min(micros) + F.max(micros)) / 2).alias("c")).first()["c"]
    early = F.lit(True) if cut is None else micros <= cut
    for run, rows in (("before", bars.filter(early)), ("after", bars.filter(~early))):
        rows.repartition("symbol").write.parquet(f"{root}/bars-{run}")
    _drain(spark.readStream.schema(bars.schema).parquet(f"{root}/bars-before"), root, "before", outputs={"mb20": ("ma", 5), "macd": ("macd", 12, 26)})
    with _rocksdb(spark):
        initial = reconfigured(spark, f"{root}/checkpoint-before", tuple(COLUMNS), spark.read.parquet(f"{root}/bars-before"))
    _drain(spark.readStream.schema(bars.schema).parquet(f"{root}/bars-after"), root, "after", outputs=tuple(COLUMNS), initial=initial)
    return _result(spark, f"{root}/out-after", COLUMNS)


QUERIES = {"stream_indicators": stream_query, "stream_out_of_order": out_of_order_query, "stream_reconfigured": reconfigured_query}
_STAGES = [
    {"ma5": last("avg(close)", 5), "macd": f"{ewm('close', 12)} - {ewm('close', 26)}", "ch": f"coalesce(close - {lag('close')}, 0)", "mb20": last("avg(close)", 20), "sd": last("stddev_samp(close)", 20), "wr10": f"({last('max(high)', 10)} - close) * 100 / nullif({last('max(high)', 10)} - {last('min(low)', 10)}, 0)", "sg": f"CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END", "dma": f"{last('avg(close)', 10)} - {last('avg(close)', 50)}", "bbi": "(" + " + ".join(last("avg(close)", n) for n in (3, 6, 12, 24)) + ") / 4"},
    {"macd_signal": ewm("macd", 9), "up20": "mb20 + 2 * sd", "obv": so_far("sum(sg)"), "g": "greatest(ch, 0)", "l": "greatest(-ch, 0)"},
    {"eg": ewm("g", 14), "el": ewm("l", 14)}, {"rsi14": "CASE WHEN el = 0 THEN 100 ELSE 100 - 100 / (1 + eg / nullif(el, 0)) END"},
]
_ALL = staged(_STAGES, COLUMNS)
_CUT = f"(SELECT make_timestamp(CAST(floor((min(epoch_us(date)) + max(epoch_us(date))) / 2) AS BIGINT)) FROM ({BARS_HOUR}))"
SQL = {"stream_indicators": _ALL, "stream_out_of_order": _ALL, "stream_reconfigured": staged(_STAGES, COLUMNS, where=f"WHERE date > {_CUT}")}
