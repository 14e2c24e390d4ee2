"""Quartile bucket digests of texts, and their bounded difference score."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, chunks

#: Buckets of a digest (a power of two), and length steps an octave.
BUCKETS, STEPS = 2048, 4


def triplet_counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed byte triplets: of every window of four bytes, the three triplets that hold its first byte and two others, and
    the triplet of the last three bytes. A text of one or two bytes counts as three, zeros behind."""
    out = np.zeros(buckets, np.int64)
    if not data:
        return out
    b = np.frombuffer(data + bytes(max(0, 3 - len(data))), np.uint8)
    shift = np.uint32(32 - buckets.bit_length() + 1)

    def add(x: np.ndarray, i: np.ndarray, j: np.ndarray, salt: int) -> None:
        h = ((x << np.uint32(16) | i << np.uint32(8) | j) + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        out[:] += np.bincount(h >> shift, minlength=buckets)

    step = 1 << 18
    for lo in range(0, len(b) - 3, step):
        w = b[lo : lo + step + 3].astype(np.uint32)
        x, y, z, q = w[:-3], w[1:-2], w[2:-1], w[3:]
        for salt, (i, j) in enumerate(((y, z), (y, q), (z, q))):
            add(x, i, j, salt)
    add(*b[-3:].astype(np.uint32).reshape(3, 1), 0)
    return out


def quartile_codes(counts: np.ndarray) -> np.ndarray:
    """0 to 3 for each bucket: how many of the quartiles of all buckets' counts it exceeds."""
    n = len(counts)
    q = np.partition(counts, (n // 4 - 1, n // 2 - 1, 3 * n // 4 - 1))
    return sum((counts > q[i]).astype(np.uint8) for i in (n // 4 - 1, n // 2 - 1, 3 * n // 4 - 1))


def digest(text: bytes) -> bytes:
    """The length code (a byte: STEPS an octave), then two bits a bucket. An empty text has length code 0 and no bucket set."""
    codes = quartile_codes(triplet_counts(text)).reshape(-1, 4)
    size = min(255, round(STEPS * math.log2(1 + len(text))))
    return bytes([size]) + (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).astype(np.uint8).tobytes()


def bucket_distances() -> np.ndarray:
    """For two bytes of codes, the sum of the four differences; of opposite quartiles 6 rather than 3."""
    step = np.abs(np.arange(4)[:, None] - np.arange(4))
    step[step == 3] = 6
    b = np.arange(256)
    return sum(step[(b[:, None] >> s) & 3, (b >> s) & 3] for s in (0, 2, 4, 6)).astype(np.uint16)


#: The most that a length counts, as a share of all.
LENGTH_SHARE = 0.1


def code_counts() -> np.ndarray:
    """How many of a byte's four codes are 0, 1, 2, 3: a row a byte."""
    b = np.arange(256)
    return sum(((b[:, None] >> s) & 3 == np.arange(4)).astype(np.int64) for s in (0, 2, 4, 6))


def likeness(a: bytes, b: bytes, table: np.ndarray, codes: np.ndarray) -> float:
    """1 for equal digests, 0 for those that differ as much as independent ones with as many buckets of each quartile would, or more.
    table: bucket_distances(); codes: code_counts()."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    p, q = (np.bincount(v[1:], minlength=256) @ codes for v in (x, y))
    step = np.abs(np.arange(4)[:, None] - np.arange(4))
    step[step == 3] = 6
    chance = float(p @ step @ q) / (4 * (len(x) - 1))
    differ = float(table[x[1:], y[1:]].sum())
    buckets = differ / chance if chance else float(differ > 0)
    length = min(1.0, abs(int(x[0]) - int(y[0])) / (4 * STEPS))
    return max(0.0, 1.0 - buckets - LENGTH_SHARE * length)


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs as (doc_id, text, part, tail), dealt out and sorted so that within a part each row's next one by descending key follows
    it; the last row of each part, with tail set, is a copy of the next part's first row (after the last part: the first part's).

    The parts are ranges of keys between quantiles; the driver gets the quantiles and each part's first key.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = Rows(docs)
    rows = plain.df.select(F.col(plain.column(key)).cast("long").alias("doc_id"), F.coalesce(plain.column(text), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first().q
    bounds = np.unique(np.array(cuts or [0], np.int64))
    lowest = F.coalesce("doc_id", F.lit(-(1 << 63)))  # null keys come last

    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(), "right")).astype("int32")

    slim = rows.select("doc_id", F.xxhash64("text").alias("h")).withColumn("part", F.pandas_udf(place, "int")(lowest))
    heads = slim.groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    first = slim.join(F.broadcast(heads.withColumnsRenamed({"part": "p", "doc_id": "d"})), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d"))).groupBy("part").agg(F.max("doc_id").alias("doc_id"), F.min("h").alias("h"))
    order = sorted((r.part, r.doc_id, r.h) for r in first.collect())  # a row per part
    ahead = [(d, h, order[i - 1][0]) for i, (_, d, h) in enumerate(order)]
    need = spark.createDataFrame(ahead or [(None, 0, -1)], "__d long, __h long, __before int")
    placed = rows.withColumn("h", F.xxhash64("text")).withColumn("part", F.pandas_udf(place, "int")(lowest))
    placed = placed.join(F.broadcast(need), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")), "left")
    own, copy = F.struct("part", F.lit(False).alias("tail")), F.struct(F.col("__before").alias("part"), F.lit(True).alias("tail"))
    placed = placed.select("doc_id", "text", "h", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("at")).select("doc_id", "text", "h", "at.part", "at.tail")
    return placed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "h").select("doc_id", "text", "part", "tail")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each of docs.

    The edited text has its last third (rounded down, in code points) replaced by the first as many code points of the next text by
    descending key, or all of that text; the last row's next is the first. Fingerprints are base64 of digest(). Whole texts count.
    A null text is empty; the empty text has a fingerprint of its own, of likeness 1 to itself. Null keys come last; equal keys are
    ordered by a hash of their texts, equal rows are next to each other. A single row is its own next. An empty table gives no rows.
    Each text is moved once, with one more copy at the end of each range of keys. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, codes = bucket_distances(), code_counts()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                out = []
                for doc, text_, where, tail in zip(part.column("doc_id").to_pylist(), texts.to_pylist(), *(part.column(c).to_pylist() for c in ("part", "tail")), strict=True):
                    mine = digest(text_.encode())
                    if held is not None and held[2] == where:
                        before, now = held[:2]
                        cut_ = len(before[1]) // 3
                        edited = (before[1][: len(before[1]) - cut_] + text_[:cut_]).encode()
                        other = digest(edited)
                        out.append((before[0], len(before[1]), hashlib.sha256(edited).hexdigest(), base64.b64encode(now).decode(), base64.b64encode(other).decode(), likeness(now, other, table, codes), likeness(now, mine, table, codes)))
                    held = None if tail else ((doc, text_), mine, where)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return with_next(docs, text, key).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
