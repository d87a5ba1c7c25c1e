"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a session on one machine may leave it unset and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="docloom-")).rstrip("/")


def stored(df: DataFrame, *partitions: str) -> DataFrame:
    """df, evaluated once into a Parquet table with a folder for each value of the partition columns.

    What reads it later reads files: nothing is computed again, also where an executor is lost. It goes with the session.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)
