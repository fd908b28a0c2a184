"""Tables that operators write once, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing (tests, a local session) a temporary folder of this
    machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = "file://" + os.path.join(tempfile.gettempdir(), "panelforge-checkpoints")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> int:
    """Deletes the folders that this application's operators have made, and returns how many. For
    when their results are written: a result that is still read needs its tables."""
    hadoop, made = spark.sparkContext._jsc.hadoopConfiguration(), _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(hadoop).delete(folder, True)
    return len(made)
