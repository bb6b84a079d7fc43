"""Token counts: delta-maintained rollups by source, language and tokenizer version, with idempotent batch commits.

A store is a folder with one log of signed rows, a folder for each committed batch: an insert adds its counts, a delete takes
back what the log holds for the document, a revised count does both. Totals are sums of the signed rows, so they never need
the documents again. A batch is written to a folder of its own name in one commit of Spark's file committer: its _SUCCESS
file is the commit record. A batch that is already committed changes nothing; one that failed half-way is written anew.
compact() writes what the log adds up to as a snapshot with the names of the batches in it, so that later commits read the
snapshot and the batches after it and not the whole history; the batches' folders stay as commit records. Commits and
compactions of one store must not run at the same time.

Changes: op (upsert, delete or insert), seq, doc_id, source, lang, tokenizer_version, n_tokens. Defined cases: within a batch the last
change (greatest seq, ties by op, source, lang and count) of a (doc_id, tokenizer_version) counts, so repeated rows count
once; an insert adds its row whatever else the batch or the log holds, and a later change of its doc_id takes back all of
them; deleting what is not there changes nothing; null source, lang or doc_id are values like others; null counts are 0; an
empty batch commits and changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialise, ship, text_chunks
from .tokens import rank_encoder

KEY = ("doc_id", "tokenizer_version")
LOG = "doc_id long, source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k", ranks: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens of whole texts (null: 0) by a rank file's encoder; no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        encoder = rank_encoder(ranks)
        for batch in text_chunks(batches):
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * len(n)), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokenizer_version", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")


def count_words(docs: DataFrame, version: str = "words_1") -> DataFrame:
    """The same columns, counting words instead of tokens."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(version).alias("tokenizer_version"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


class RollupStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self, kind: str) -> list[str]:
        """Committed folders of a kind (batch or snapshot) in order of their names, through Hadoop's file systems."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return []
        folders = [f.getPath() for f in fs.listStatus(path) if f.isDirectory() and f.getPath().getName().startswith(f"{kind}=")]
        return sorted(str(p.toString()) for p in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _batches(self) -> list[str]:
        return self._folders("batch")

    def log(self) -> DataFrame:
        """Signed rows: the last snapshot and those of the committed batches that it does not hold."""
        found, held = self._batches(), []
        snapshots = self._folders("snapshot")
        if snapshots:
            inside = {r.batch for r in self.spark.read.parquet(f"{snapshots[-1]}/batches").collect()}  # names of batches
            found, held = [f for f in found if f.rsplit("/", 1)[1] not in inside], [f"{snapshots[-1]}/rows"]
        folders = [*held, *found]
        return self.spark.read.schema(LOG).parquet(*folders) if folders else self.spark.createDataFrame([], LOG)

    def _sums(self) -> DataFrame:
        sums = self.log().groupBy("doc_id", "source", "lang", "tokenizer_version").agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        return sums.filter("d_docs <> 0 or d_tokens <> 0")

    def compact(self) -> None:
        """One row a (doc_id, source, lang, tokenizer_version) in place of its history."""
        names = [(f.rsplit("/", 1)[1],) for f in self._batches()]
        if not names:
            return
        target = f"{self.root}/snapshot={len(self._folders('snapshot')):08d}"
        self._sums().write.mode("overwrite").parquet(f"{target}/rows")
        self.spark.createDataFrame(names, "batch string").coalesce(1).write.mode("overwrite").parquet(f"{target}/batches")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")  # the commit record comes last
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(path, True).close()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        target = f"{self.root}/batch={batch_id}"
        if any(f.rstrip("/").endswith(f"/batch={batch_id}") for f in self._batches()):
            return False
        insert = F.col("op").eqNullSafe("insert")  # each insert is a group of its own
        changes = changes.withColumn("_own", F.when(insert, F.monotonically_increasing_id()))
        last = Window.partitionBy(*KEY, "_own").orderBy(F.desc("seq"), F.desc("op"), F.desc("source"), F.desc("lang"), F.desc("n_tokens"))
        final = changes.withColumn("_turn", F.row_number().over(last)).filter("_turn = 1")
        fresh = final.filter("op <> 'delete'").select("doc_id", "source", "lang", "tokenizer_version", F.lit(1).cast("long").alias("d_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("d_tokens"))
        rows = fresh
        if self._batches():  # what the log holds for these documents is taken back
            now = self._sums()
            keys = final.filter(~insert).select(*[F.col(c).alias(f"_{c}") for c in KEY])
            on = [now[c].eqNullSafe(keys[f"_{c}"]) for c in KEY]
            gone = now.join(keys, on, "left_semi").select("doc_id", "source", "lang", "tokenizer_version", (-F.col("d_docs")).alias("d_docs"), (-F.col("d_tokens")).alias("d_tokens"))
            rows = rows.unionByName(gone)
        rows.write.mode("overwrite").parquet(target)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens of what the log adds up to; groups without documents go."""
        sums = self.log().groupBy("source", "lang", "tokenizer_version").agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0")


def upserts(counted: DataFrame, seq: int = 0) -> DataFrame:
    return counted.withColumns({"op": F.lit("upsert"), "seq": F.lit(seq)})


def entries(counted: DataFrame, docs: DataFrame, seq: int = 0) -> DataFrame:
    """Changes that count every row of docs: upserts, but inserts for rows whose doc_id is null or not theirs alone."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_many")).filter("_many is not null")
    many = broadcast_if_small(materialise(ids.groupBy("_many").count().filter("count > 1").select("_many")))
    found = counted.join(many, counted["doc_id"] == F.col("_many"), "left")
    op = F.when(F.col("doc_id").isNull() | F.col("_many").isNotNull(), "insert").otherwise("upsert")
    return found.withColumns({"op": op, "seq": F.lit(seq)}).drop("_many")


def revisions(counted: DataFrame, docs: DataFrame) -> DataFrame:
    """Changes that take back what the log holds for the doc_ids of counted (null as well) and count every row anew."""
    keys = counted.select("doc_id", "tokenizer_version").distinct()
    return deletes(keys, 0).unionByName(entries(counted, docs, 1), allowMissingColumns=True)


def deletes(keys: DataFrame, seq: int = 0) -> DataFrame:
    """Changes that delete the (doc_id, tokenizer_version) given."""
    return keys.select(F.lit("delete").alias("op"), F.lit(seq).alias("seq"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), "tokenizer_version", F.lit(0).cast("long").alias("n_tokens"))
