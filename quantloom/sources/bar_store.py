"""Bars kept as a table: partitioned by period, bucketed and sorted by symbol, changed by upserts.

Windows by symbol and joins by symbol read the buckets as they lie, without a shuffle; a range of dates reads its periods only. Joins
by symbol and date do so where spark.sql.requireAllClusterKeysForCoPartition is false (Spark's default shuffles them).

An upsert rewrites the periods that its rows fall into and no others. Rows are dealt out by range over period, bucket, symbol and
date, so no task writes more because a symbol is long. A batch is recorded once its periods are in place, under the id the caller gives;
a batch recorded before changes nothing. One that died halfway is simply given again: its rows replace those it had written.

A row's key is (symbol, date); null equals null there. Rows of one batch with equal keys leave the one whose other columns are greatest,
in the order of the columns. Rows without a date are a period of their own and in no range. An empty batch is recorded and
changes nothing. Columns that the store does not have are left out of a batch, missing ones are an error; a table with a
column named _period is refused. Writers must take turns; readers see a batch period by period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..scratch import written
from ..windows import KEY, TIME

PERIOD = "_period"
#: How a date names its period; both sort as dates do.
FORMATS = {"year": "yyyy", "month": "yyyyMM"}


class BarStore:
    """A store that exists; create() makes one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        of = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        self.by, self.buckets, self.path = of["bars.period"], int(of["bars.buckets"]), of["bars.path"]
        self.columns = [c for c in spark.table(name).columns if c != PERIOD]

    @classmethod
    def create(cls, spark: SparkSession, name: str, schema: StructType | str, path: str, by: str = "year", buckets: int = 200) -> BarStore:
        """An empty store in a folder that all machines share. A task of a window reads one bucket of all periods asked for: take as many
        buckets as keep that to some hundred MB. `by` is year or month, as a day's upsert rewrites its whole period."""
        empty = spark.createDataFrame([], schema)
        if by not in FORMATS:
            raise ValueError(f"unknown period {by}")
        if PERIOD in empty.columns or not {KEY, TIME} <= set(empty.columns):
            raise ValueError(f"a store needs {KEY} and {TIME} and has no {PERIOD}")
        writer = empty.withColumn(PERIOD, cls._period(by)).write.format("parquet").option("path", path).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(PERIOD).bucketBy(buckets, KEY).sortBy(KEY, TIME).saveAsTable(name)
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('bars.period' = '{by}', 'bars.buckets' = '{buckets}', 'bars.path' = '{path}')")
        return cls(spark, name)

    @staticmethod
    def _period(by: str, time: Column | None = None) -> Column:
        return F.date_format(F.col(TIME) if time is None else time, FORMATS[by]).cast("int")

    def read(self, low=None, high=None) -> DataFrame:
        """The bars, of the dates low to high (both included) where given; other periods are not opened."""
        df = self.spark.table(self.name)
        kind = df.schema[TIME].dataType
        for end, keep in ((low, lambda c, e: c >= e), (high, lambda c, e: c <= e)):
            if end is not None:
                edge = F.lit(end).cast(kind)
                df = df.filter(keep(F.col(TIME), edge) & keep(F.col(PERIOD), self._period(self.by, edge)))
        return df.select(*self.columns)

    # ---- changes

    def _record(self, batch: str):
        """The file that stands for a batch, and its file system; names beginning with _ are no data to Spark."""
        quoted = "".join(c if c.isalnum() or c in "-." else f"_{ord(c):x}_" for c in batch)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_batches/{quoted}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def has(self, batch: str) -> bool:
        files, path = self._record(batch)
        return files.exists(path)

    def upsert(self, new: DataFrame, batch: str) -> list[int | None]:
        """Put the rows of a batch in place of rows of equal key, and add the others. Gives the periods rewritten, none for a batch
        recorded before. The batch is written to the shared folder first, so it is computed once."""
        if self.has(batch):
            return []
        rest = [c for c in self.columns if c not in (KEY, TIME)]
        rows = new.groupBy(KEY, TIME).agg(F.max(F.struct(*rest, F.lit(0).alias(PERIOD))).alias("_r")).select(KEY, TIME, *[F.col("_r")[c].alias(c) for c in rest]).select(*self.columns)
        rows = written(rows.withColumn(PERIOD, self._period(self.by)))
        periods = [r[0] for r in rows.select(PERIOD).distinct().collect()]  # as many as the calendar has
        if periods:
            self._rewrite(rows, periods)
        files, path = self._record(batch)
        files.createNewFile(path)
        return sorted(periods, key=lambda p: (p is not None, p))

    def _rewrite(self, rows: DataFrame, periods: list) -> None:
        touched = F.col(PERIOD).isin([p for p in periods if p is not None])
        old = self.spark.table(self.name).filter(touched | F.col(PERIOD).isNull() if None in periods else touched)
        keys = rows.select(F.col(KEY).alias("_key"), F.col(TIME).alias("_time"))
        kept = old.join(keys, F.col(KEY).eqNullSafe(F.col("_key")) & F.col(TIME).eqNullSafe(F.col("_time")), "left_anti")
        dealt = kept.unionByName(rows).repartitionByRange(PERIOD, F.pmod(F.hash(KEY), F.lit(self.buckets)), KEY, TIME)
        dealt.select(*self.columns, PERIOD).write.insertInto(self.name, overwrite=True)

    def sink(self, stream: DataFrame, stream_id: str) -> DataStreamWriter:
        """A stream's writer that upserts each micro-batch; one repeated after a failure is recognised by its number."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.upsert(rows, f"{stream_id}-{n}") and None)
