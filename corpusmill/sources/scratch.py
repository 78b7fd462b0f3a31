"""Tables between steps, kept where any executor can read them again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only local sessions without that setting get a temporary one of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file://" + tempfile.mkdtemp(prefix="corpusmill-")).rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """The path of a folder that does not exist yet, where the driver and all executors can write and read; it goes when the
    driver ends."""
    path = f"{_shared(spark)}/files-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder in ``spark.checkpoint.dir``.

    What depends on a layout drawn by sampling stays the same if an executor is lost. The files go with the table's last
    reference, if Spark is told to clean checkpoints.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read back, for loops: a checkpoint keeps the constraints that Spark
    knows of the plan before it, and in a loop of joins these grow from round to round. The table goes when the driver ends."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before; the folder is then the cluster's to clean
        pass
