"""Shards along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rows, global_rank

SIZE_OVERHEAD = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (n x dimensions, values below 2**bits), as int64.

    Works on all rows at once. Each coordinate's bit planes are brought from axes to the curve's transposed form: from the top
    plane down, a set bit flips the lower bits of the first axis, a clear one swaps them with that axis; Gray decoding follows.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("dimensions times bits must not exceed 62")
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for d in range(dims):
            on = (x[d] >> plane) & 1 == 1
            differ = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, differ)
            x[d] ^= differ
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flips = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= flips
    out = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> plane) & 1)
    return out


def ordinals(rows: DataFrame, dims: list[str]) -> DataFrame:
    """rows with the columns `dims` replaced by longs that order as they do: of whole numbers, dates and times the value, of floating ones
    and strings the place among the distinct values, so that the whole value counts; null lowest. Distinct values are ranked by range
    partitions and joined back, so their number may be any."""
    kinds = {d: rows.schema[d].dataType for d in dims}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.TimestampType)
    for d in dims:
        if isinstance(kinds[d], (*whole, T.DateType)):
            value = F.unix_date(d) if isinstance(kinds[d], T.DateType) else F.col(d)
            rows = rows.withColumn(d, F.coalesce(value.cast("long"), F.lit(-(1 << 62))))
    for kind in {repr(k): k for d, k in kinds.items() if not isinstance(k, (*whole, T.DateType))}.values():
        mine = [d for d in dims if kinds[d] == kind]
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("value")) for i, d in enumerate(mine)]))
        values, _ = global_rank(rows.select(each.alias("v")).select("v.*").where("value is not null").distinct(), [F.col("dim"), F.col("value")], "place")
        for i, d in enumerate(mine):
            at = values.where(F.col("dim") == i).select(F.col("value").alias("__value"), F.col("place").alias("__place"))
            rows = rows.join(at, F.col(d) == F.col("__value"), "left").withColumn(d, F.coalesce("__place", F.lit(-1).cast("long"))).drop("__value", "__place")
    return rows


def curve_shards(docs: DataFrame, dims: list[str], shards: int = 40, law: str = "rows", bits: int = 6, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """Puts every row into one of `shards` shards, each a run of the Hilbert order over `dims`, so that each shard spans a small box
    of metadata and readers can skip shards by the extrema of any dimension.

    Each dimension is cut into 2**bits cells at its quantiles (of which the driver gets 2**bits - 1 a dimension), so that the cells
    hold alike many rows whatever the distribution; strings are ordered whole. law: "rows" (counts of shards at most one apart) or
    "bytes" (runs cut where the running size passes multiples of total / shards; a shard's size differs from it by a row's at most).
    Within a cell, rows lie in the order of text checksum, key and size, so equal texts of like metadata stay together until a cut.
    Nulls: a null text has no bytes, a null dimension counts as lowest, null keys come first. A text's length doesn't matter. Equal rows
    get slots of their own. An empty table gives no rows. Returns doc_id, size, text_crc32, curve, shard, slot (from 0, gapless) and,
    with carry, a struct `row` of all columns of docs under plain names (Rows); else other columns are ignored, whatever their names.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law {law!r}")
    given = Rows(docs)
    names = [f"__d{i}" for i in range(len(dims))]
    body = F.coalesce(given.column(text), F.lit(""))
    slim = given.df.select(F.col(given.column(key)).alias("doc_id"), (F.octet_length(body) + SIZE_OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *[F.col(given.column(c)).alias(n) for c, n in zip(dims, names, strict=True)], *([F.struct(*given.plain).alias("row")] if carry else []))
    slim = ordinals(slim, names)
    cells = 1 << bits
    steps = [i / cells for i in range(1, cells)]
    cuts = slim.agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in names]).first()
    bounds = [np.unique(np.array(cuts[n] or [0], np.int64)) for n in names]

    def place(*columns: pd.Series) -> pd.Series:
        cell = np.stack([np.searchsorted(b, c.to_numpy(), "left") for b, c in zip(bounds, columns, strict=True)], axis=1)
        return pd.Series(hilbert_index(cell, bits))

    slim = slim.withColumn("curve", F.pandas_udf(place, "long")(*names)).drop(*names)
    ranked, total = global_rank(slim, [F.col("curve"), F.col("text_crc32"), F.col("doc_id"), F.col("size")])
    if law == "rows":
        shard = F.expr(f"rank * {shards}L div {max(total, 1)}L")
        out = ranked.withColumn("shard", shard.cast("int"))
        first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
        return out.withColumn("slot", F.col("rank") - first).drop("rank")
    return by_bytes(ranked, shards)


def write_shards(docs: DataFrame, dims: list[str], path: str, shards: int = 40, law: str = "bytes", file_bytes: int = 256 << 20, **options) -> DataFrame:
    """Writes the rows as Parquet, a folder `_shard=n` a shard, and returns the manifest: shard, rows, bytes and the extrema of each
    dimension (lo_, hi_), by which a reader tells the shards it can skip. Shards are written in runs of slots of about `file_bytes` of
    text, a task and a file each, in order, so a shard may have any size."""
    out = curve_shards(docs, dims, shards, law, carry=True, **options)
    given = Rows(docs)
    size = out.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = out.repartitionByRange(max(shards, -(-size // file_bytes)), "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(F.col("shard").alias("_shard"), *[F.col("row")[c].alias(n) for c, n in zip(given.plain, given.names, strict=True)]).write.mode("overwrite").partitionBy("_shard").parquet(path)
    extrema = [f(F.col("row")[given.column(d)]).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    return out.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *extrema)


def by_bytes(ranked: DataFrame, shards: int) -> DataFrame:
    """Runs of near equal size. The running size is that of all earlier blocks of ranks plus that within the block."""
    block = 4096
    blocks = ranked.groupBy(F.expr(f"rank div {block}").alias("b")).agg(F.sum("size").alias("bytes"))
    outer, _ = global_rank(blocks, [F.col("b")], "nth")
    sup = outer.groupBy(F.expr(f"nth div {block}").alias("s")).agg(F.sum("bytes").alias("bytes")).collect()  # a row per block**2 rows
    base, run = [], 0
    for r in sorted(sup, key=lambda r: r.s):
        base.append((r.s, run))
        run += r.bytes
    spark = ranked.sparkSession
    starts = outer.withColumn("s", F.expr(f"nth div {block}")).join(F.broadcast(spark.createDataFrame(base or [(0, 0)], "s long, base long")), "s")
    before = F.col("base") + F.coalesce(F.sum("bytes").over(Window.partitionBy("s").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("b", before.alias("__before"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("b").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = ranked.withColumn("b", F.expr(f"rank div {block}")).join(starts, "b").withColumn("__at", F.col("__before") + within + F.expr("size div 2"))
    laid = laid.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("__at") / F.lit(max(run, 1) / shards))).cast("int"))
    firsts = laid.groupBy("shard").agg(F.min("rank").alias("__first"))
    return laid.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rank") - F.col("__first")).drop("b", "__before", "__at", "__first", "rank")
