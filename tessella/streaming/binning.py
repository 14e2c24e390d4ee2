"""Counts a tile and gene of a stream of molecules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import shared_folder


def tile_counts(points: DataFrame, length: float, x0: float, y0: float, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """(gx, gy, gene, count) of a stream (or table) of points, tiles counted from a stated origin, as bounds aren't known in advance.
    With a watermark, counts are kept a window of one hour and final when the watermark has passed."""
    at = lambda c, o: (F.floor((F.col(c) - o) / length) + 1).cast("int")
    tagged = points.withColumns({"gx": at("x_location", x0), "gy": at("y_location", y0)})
    if watermark is None:
        return tagged.groupBy("gx", "gy", F.col("feature_name").alias("gene")).agg(F.count("*").alias("count"))
    return tagged.withWatermark(time, watermark).groupBy(F.window(time, "1 hour").alias("hour"), "gx", "gy", F.col("feature_name").alias("gene")).agg(F.count("*").alias("count"))


def start(points: DataFrame, length: float, x0: float, y0: float, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what there is and ends. Every batch writes all counts so far to a folder of its own, `path`/batch=n, from the executors;
    latest() reads the last one that is whole."""

    def write(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return tile_counts(points, length, x0, y0).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    every = spark.read.parquet(path)
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


def counted(points: DataFrame, length: float, x0: float, y0: float) -> DataFrame:
    """The counts of a stream once it has read all there is, kept in the shared folder."""
    spark = points.sparkSession
    path = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    start(points, length, x0, y0, f"{path}/counts", f"{path}/progress").awaitTermination()
    return latest(spark, f"{path}/counts")
