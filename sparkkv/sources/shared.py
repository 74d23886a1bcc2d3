"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(master: str) -> bool:
    """Whether driver and executors are one process: ``local`` and ``local[..]``."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``), with a part of this application's own.

    A local folder is set only for a local master, as in tests. On a cluster each machine would write to its own disk, so there it is an error
    if none is named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkkv-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sparkkv/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The table survives the loss of any executor, is columnar (later reads prune columns) and is written
    once, so every reader sees the same rows. Files stay until ``clear`` or until the folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's part of the shared folder. Call it when no DataFrame that reads from it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
