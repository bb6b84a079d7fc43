"""Vendor .day files: 32-byte little-endian records, one file a symbol, as a Spark data source ("dayfile").

Files are read in splits of whole records; a long file makes several, many short files share one, so that neither the
length nor the number of files makes a task too large or tasks too many. max_days reads the tail of each
file only, a range of dates only the records inside it. Written files come into place once all tasks are done.
"""

from __future__ import annotations

import datetime as dt
import os
import shutil
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: date as YYYYMMDD, open, high, low and close in hundredths, volume, amount, four spare bytes.
RECORD = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("volume", "<u4"), ("amount", "<u4"), ("spare", "<u4")])
SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, amount double"


def parse_day(symbol: str, raw: bytes) -> pa.RecordBatch:
    """Bars of one file; a cut-off record at the end is left out, as is a record whose date is no date."""
    rows = np.frombuffer(raw[: len(raw) // RECORD.itemsize * RECORD.itemsize], RECORD)
    d = rows["date"].astype(np.int64)
    month, day = d // 100 % 100, d % 100
    rows = rows[(d > 19000000) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)]
    d = rows["date"].astype(np.int64)
    dates = (((d // 10000 - 1970).astype("M8[Y]").astype("M8[M]") + (d // 100 % 100 - 1)).astype("M8[D]") + (d % 100 - 1)).astype("M8[D]")
    cols = [pa.array([symbol] * len(rows), pa.string()), pa.array(dates)] + [pa.array(rows[c] / 100.0) for c in ("open", "high", "low", "close")] + [pa.array(rows[c].astype(float)) for c in ("volume", "amount")]
    return pa.RecordBatch.from_arrays(cols, ["symbol", "date", "open", "high", "low", "close", "volume", "amount"])


def pack_rows(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Records of bars given by column; dates as days."""
    days = columns["date"].astype("M8[D]")
    months = days.astype("M8[M]")
    out = np.zeros(len(days), RECORD)
    out["date"] = (months.astype("M8[Y]").astype(np.int64) + 1970) * 10_000 + (months.astype(np.int64) % 12 + 1) * 100 + (days - months.astype("M8[D]")).astype(np.int64) + 1
    for c, scale in (*((c, 100) for c in ("open", "high", "low", "close")), ("volume", 1), ("amount", 1)):
        x = np.floor(columns[c].astype(float) * scale + (0.5 if scale > 1 else 0) + 1.37e-8)
        if not ((x >= 0) & (x < 1 << 32)).all():
            raise ValueError(f"{c} leaves the range of the format")
        out[c] = x
    return out


def pack_day(rows: list[tuple]) -> bytes:
    """The bytes of rows (date as YYYYMMDD, open, high, low, close, volume, amount)."""
    return b"".join(struct.pack("<IIIIIIII", d, *(round(p * 100) for p in prices), int(v), int(a), 0) for d, *prices, v, a in rows)


#: Opening a file counts as so many records when files are put together in splits.
OPENING = 1_000
#: Records of one read.
CHUNK = 65_536


class _Split(InputPartition):
    """Records [start, stop) of each of some files."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        super().__init__(spans)


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _number(day: dt.date) -> int:
    return day.year * 10_000 + day.month * 100 + day.day


class DayFileReader(DataSourceReader):
    """Splits of whole records; a range of dates is found in each split by binary search, since vendors append by date."""

    def __init__(self, options: dict):
        self.path, self.days = _local(options["path"]), int(options.get("max_days", 0))
        self.records = int(options.get("records_per_split", 1 << 20))
        self.low, self.high, self.bytes_read = int(options.get("low", 0)), int(options.get("high", 99_999_999)), 0

    def partitions(self) -> list[_Split]:
        names = sorted(f for f in os.listdir(self.path) if f.endswith(".day")) if os.path.isdir(self.path) else [""]
        splits, size = [], self.records
        for path in (os.path.join(self.path, n) if n else self.path for n in names):
            stop = os.path.getsize(path) // RECORD.itemsize
            first = max(0, stop - self.days) if self.days else 0
            for at in range(first, stop, self.records):
                end = min(at + self.records, stop)
                if size + end - at > self.records:
                    splits.append([])
                    size = 0
                splits[-1].append((path, at, end))
                size += end - at + OPENING
        return [_Split(spans) for spans in splits]

    def _take(self, f, start: int, stop: int) -> bytes:
        f.seek(start * RECORD.itemsize)
        raw = f.read((stop - start) * RECORD.itemsize)
        self.bytes_read += len(raw)
        return raw

    def _bound(self, f, start: int, stop: int, day: int) -> int:
        """The first record in [start, stop) of that day or a later one."""
        while start < stop:
            middle = (start + stop) // 2
            if int.from_bytes(self._take(f, middle, middle + 1)[:4], "little") < day:
                start = middle + 1
            else:
                stop = middle
        return start

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # batches of short files go out together
        for path, start, stop in partition.value:
            with open(path, "rb") as f:
                if self.low > 0:
                    start = self._bound(f, start, stop, self.low)
                if self.high < 99_999_999:
                    stop = self._bound(f, start, stop, self.high + 1)
                for at in range(start, stop, CHUNK):
                    held.append(parse_day(os.path.basename(path).removesuffix(".day"), self._take(f, at, min(at + CHUNK, stop))))
                    n += held[-1].num_rows
                    if n >= CHUNK:
                        yield pa.concat_batches(held)
                        held, n = [], 0
        if held:
            yield pa.concat_batches(held)


class PushingDayFileReader(DayFileReader):
    """The reader where the session pushes filters into Python sources; where it does not, Spark takes pushFilters for an error."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds on the date narrow what is read; Spark still applies every filter."""
        for f in filters:
            if getattr(f, "attribute", None) == ("date",) and isinstance(getattr(f, "value", None), dt.date):
                day = _number(f.value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, day)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, day)
            yield f


@dataclass
class _Staged(WriterCommitMessage):
    """The i-th symbol's file is task-i."""

    task: str
    symbols: list[str]


class DayFileWriter(DataSourceArrowWriter):
    """Each task writes the files of its symbols aside; the driver moves all of them into place, or removes them all."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.token = _local(options["path"]), overwrite, uuid.uuid4().hex
        self.aside = os.path.join(self.path, f"_writing-{self.token}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        os.makedirs(self.aside, exist_ok=True)
        task, at, last = uuid.uuid4().hex, {}, {}
        for batch in iterator:
            table = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("date", "open", "high", "low", "close", "volume", "amount")}
            symbols = np.array(batch.column("symbol").cast(pa.string()).to_pylist(), object)
            packed = pack_rows(table)
            edges = [*np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])).tolist(), len(symbols)] if len(symbols) else []
            for start, stop in zip(edges, edges[1:]):
                symbol, mine = symbols[start], packed[start:stop]
                if not symbol or "/" in symbol:
                    raise ValueError(f"no file name for symbol {symbol!r}")
                if (np.diff(mine["date"].astype(np.int64), prepend=last.get(symbol, 0)) < 0).any():
                    raise ValueError(f"bars of {symbol} are not in order of their dates")
                last[symbol] = int(mine["date"][-1])
                with open(os.path.join(self.aside, f"{task}-{at.setdefault(symbol, len(at))}"), "ab") as f:
                    f.write(mine.tobytes())
        return _Staged(task, list(at))

    def commit(self, messages: list[_Staged | None]) -> None:
        done = [m for m in messages if m is not None]
        names = {s for m in done for s in m.symbols}
        if len(names) != sum(len(m.symbols) for m in done):
            self.abort(messages)
            raise ValueError("a symbol's bars come from more than one task; use write_day_files")
        for m in done:
            for i, symbol in enumerate(m.symbols):
                os.replace(os.path.join(self.aside, f"{m.task}-{i}"), os.path.join(self.path, f"{symbol}.day"))
        if self.overwrite:
            for name in os.listdir(self.path):
                if name.endswith(".day") and name.removesuffix(".day") not in names:
                    os.remove(os.path.join(self.path, name))
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[_Staged | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class DayFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dayfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DayFileReader:
        return (PushingDayFileReader if self.options.get("push", "") == "true" else DayFileReader)(self.options)

    def writer(self, schema, overwrite: bool) -> DayFileWriter:
        return DayFileWriter(self.options, overwrite)


def read_day_files(spark: SparkSession, path: str, max_days: int = 0, low: dt.date | None = None, high: dt.date | None = None, **options):
    """Files in a folder that all executors can open, from `low` to `high`; for object stores use read_day_binary. Later filters on
    the date are pushed into the source too where spark.sql.python.filterPushdown.enabled is true."""
    spark.dataSource.register(DayFileSource)
    bounds = {name: str(_number(day)) for name, day in (("low", low), ("high", high)) if day is not None}
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    df = spark.read.format("dayfile").option("path", path).option("max_days", str(max_days)).option("push", push).options(**bounds, **options).load()
    for bound, keep in ((low, lambda c: c >= low), (high, lambda c: c <= high)):
        df = df.filter(keep(F.col("date"))) if bound is not None else df  # also where records are out of order
    return df


def write_day_files(bars: DataFrame, path: str, mode: str = "append") -> None:
    """One file a symbol, replaced whole; overwrite also removes the files of other symbols. Prices are kept to the hundredth,
    volume and amount as whole numbers below 2^32. A write that fails before the driver moves
    the files leaves the bars as they were (a task still running then may leave a folder _writing-..., which no reader looks at)."""
    bars.sparkSession.dataSource.register(DayFileSource)
    columns = ["symbol", "date", "open", "high", "low", "close", "volume", "amount"]
    typed = bars.select(F.col("symbol").cast("string").alias("symbol"), F.col("date").cast("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in columns[2:]])
    typed.repartition("symbol").sortWithinPartitions("symbol", "date").write.format("dayfile").option("path", path).mode(mode).save()


def read_day_binary(spark: SparkSession, path: str):
    """The same bars through Spark's binaryFile source, for any file system that Spark reads."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield parse_day(name.rsplit("/", 1)[-1].removesuffix(".day"), raw)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.day").load(path).select("path", "content").mapInArrow(run, SCHEMA)
