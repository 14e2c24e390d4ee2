"""Tables in the folder that driver and executors share; plans that read them start there, and losing executors costs no earlier work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it names none, one in /tmp if all tasks run in the driver's own process,
    as in tests; else an error, since executors wouldn't see one another's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return "/tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
