"""The folder that the driver and all executors share, and files in it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}  # by application, where all of it is one process


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a new folder of the machine only where that is unset and Spark runs in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        if context.applicationId not in _local:
            _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        path = _local[context.applicationId]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the application ends."""
    path = fresh_path(spark, name)
    files, where = _hadoop(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: lineage ends here. The files go when the application ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        files, where = _hadoop(df.sparkSession, path)
        files.delete(where, True)


def file_system(path: str):
    """(pyarrow file system, path in it) for a URI or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{os.path.abspath(path)}")


def publish(path: str, write: Callable) -> str:
    """Calls write(stream) on a file of this attempt, ``path`` with its number before the ending, and returns its name: retried and
    speculative attempts never meet, and what the driver hears of is complete."""
    ctx = TaskContext.get()
    stem, ending = os.path.splitext(path)
    path = f"{stem}-{ctx.taskAttemptId() if ctx else 0}{ending}"
    files, where = file_system(path)
    files.create_dir(os.path.dirname(where), recursive=True)
    with files.open_output_stream(where) as out:
        write(out)
    return path
