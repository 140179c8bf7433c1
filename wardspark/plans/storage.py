"""Where intermediate tables go."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    In local mode, where all executors are the driver, a temporary folder stands in for a missing setting. A cluster
    without the setting is refused: executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="wardspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_location(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back: later steps read it instead of computing it again."""
    location = new_location(df.sparkSession, name)
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)
