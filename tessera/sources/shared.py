"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}  # by application, where all of it is one process


def use_shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, set for checkpoints too; a new folder of the machine only where that is unset and Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        if context.applicationId not in _local:
            _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        base = _local[context.applicationId]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written in the shared folder once and read from there; lineage ends here."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """Rows written as Parquet in the shared folder once and read from there, with their columns and sizes; the files go when the application ends."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder at which nothing is yet; what comes there goes when the application ends."""
    path = f"{use_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{path}/data"
