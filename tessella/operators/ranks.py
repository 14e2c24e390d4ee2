"""Positions and running sums over all rows of a table, without a window over all of them: rows are range-partitioned, each partition
is worked on by itself, and what lies before it is added as a number a partition, which the driver gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a partition at least, so that small tables are one.
ROWS = 4096


def partitioned(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted by `order` (a total order up to equal rows) in range partitions, with __part and __at, the place within; stored."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = stored(placed)
    return placed.withColumn("__part", F.shiftrightunsigned("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> tuple[DataFrame, int]:
    """df with its gapless place by `order` from 0, and the number of rows."""
    placed = partitioned(df, order)
    offsets, total = [], 0
    for part, n in sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        offsets.append((part, total))
        total += n
    base = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part long, __base long")
    return placed.join(F.broadcast(base), "__part").withColumn(rank, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base"), total


def running(df: DataFrame, order: str, count: str, rank: str) -> tuple[DataFrame, int]:
    """df (one row a value of `order`), with rank, the sum of `count` up to each row, and the sum of all. __part stays for suffix_least()."""
    placed = partitioned(df, [F.col(order)])
    offsets, total = [], 0
    for part, n in sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.sum(count).alias("n")).collect()):
        offsets.append((part, total))
        total += n
    base = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part long, __base long")
    within = F.sum(count).over(Window.partitionBy("__part").orderBy("__at"))
    return placed.withColumn(rank, within).join(F.broadcast(base), "__part").withColumn(rank, F.col(rank) + F.col("__base")).drop("__base"), total


def suffix_least(df: DataFrame, value: str, out: str) -> DataFrame:
    """df of running() with the least `value` from each row on."""
    later, least = [], None
    for part, v in sorted(((r["__part"], r["v"]) for r in df.groupBy("__part").agg(F.min(value).alias("v")).collect()), reverse=True):
        later.append((part, least))
        least = v if least is None else min(least, v)
    base = df.sparkSession.createDataFrame(later or [(0, None)], "__part long, __later double")
    within = F.min(value).over(Window.partitionBy("__part").orderBy(F.desc("__at")))
    return df.withColumn(out, within).join(F.broadcast(base), "__part").withColumn(out, F.least(out, "__later")).drop("__part", "__at", "__later")
