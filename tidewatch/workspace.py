"""Folders for checkpoints and written tables, in the storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(root)
        return root.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A folder path under the shared root that nobody has used before."""
    return f"{_own_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/tidewatch/{spark.sparkContext.applicationId}"


def remove_folders(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    Call it once no result that was built from them is needed any more; whoever starts the
    session owns them.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own_root(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Was a table written to ``folder`` to its end?"""
    context = spark.sparkContext
    mark = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(context._jsc.hadoopConfiguration()).exists(mark)


def written(df: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, however often it is read.

    Later reads take only the columns they need, know the size on disk, and survive the
    loss of any executor.
    """
    folder = folder or new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
