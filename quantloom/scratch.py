"""Tables that a plan writes for itself, in the shared folder that the cluster names in spark.checkpoint.dir.

Such a table cuts the lineage: it survives lost executors and is read as often as a plan needs it. Where the setting is missing,
a local session gets a temporary folder; on a cluster, whose machines do not share one, that is an error."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = _local.setdefault(app, tempfile.mkdtemp(prefix="quantloom-"))
    return f"{shared.rstrip('/')}/{app}"


def written(df: DataFrame) -> DataFrame:
    """df as a table that has been written and is read again."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables written by this application; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
