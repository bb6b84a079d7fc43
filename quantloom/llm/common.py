"""What the operators of this subpackage share: text rules, scratch tables, shipping code to executors."""

from __future__ import annotations

import contextlib
import os
import string
import tempfile
import uuid
import zipfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words and are stripped from line keys.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, every other character untouched."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower_key(c: Column) -> Column:
    """Equal for two strings exactly if ascii_lower() is, and much cheaper; the value itself is not text.

    ASCII alone is lowered as it is. Other text is read as one character a byte and then lowered: that also moves the lead
    bytes C0-DE to E0-FE, which loses nothing, since the number of continuation bytes after a lead byte still tells them
    apart."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.lower(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row. Inside a lambda any expression but a lambda variable is computed anew
    for each element, so a split of the whole text would be done again for every line."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the value written as text, modulo n; null ids fall in fold 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes.split() cuts at exactly the characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A local session without it gets a temporary folder; on a cluster, whose
    machines do not share one, its absence is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("QUANTLOOM_SCRATCH")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.environ["QUANTLOOM_SCRATCH"] = tempfile.mkdtemp(prefix="quantloom-")
    return folder.rstrip("/")


@contextlib.contextmanager
def _shuffle_files_go(spark: SparkSession):
    """Queries begun inside drop their shuffle files as they end; the session's setting is put back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    with _shuffle_files_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_parts(df: DataFrame, column: str) -> dict[bool, tuple[DataFrame, str]]:
    """materialise() for two tables from one pass, told apart by a boolean column, which they lose: for each value the table
    and its folder, to be discarded by itself."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    with _shuffle_files_go(spark):
        df.write.partitionBy(column).option("compression", "zstd").parquet(path)
    schema = df.drop(column).schema
    out = {}
    for value in (True, False):
        folder = f"{path}/{column}={str(value).lower()}"
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path)
        out[value] = (spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema), folder)
    return out


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver got it from, and keep Arrow batches of whole
    texts small: Spark's default of 10,000 rows a batch bounds rows, not bytes. A session that sets these itself keeps them."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str((1 << 63) - 1), str((1 << 31) - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = __name__.split(".")[0]
    target = os.path.join(tempfile.mkdtemp(prefix="quantloom-ship-"), f"{package}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, package)):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of the names that df has not got (in any case of its letters): the name itself or with
    underscores before it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_chunks(batches, column: str = "text", max_bytes: int = 2 << 20):
    """Cut Arrow batches into slices of about max_bytes of text, so that memory follows the bound, not the rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def shuffle_free(df: DataFrame, weight: Column, most: int) -> DataFrame:
    """Broadcast a materialised table whose weights add up to at most `most`; beyond that, join it by a hash shuffle."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if total <= most else df.hint("shuffle_hash")


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast a narrow, already materialised table when a count proves it small; otherwise leave the shuffle join."""
    return F.broadcast(df) if df.count() <= max_rows else df
