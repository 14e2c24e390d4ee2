"""What several of the operators share: tables in the shared folder, global ranks, and word hashes of Arrow text columns."""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U = np.uint64
#: Odd bases of the polynomial hashes, and what the rows of a second, independent hash use.
BYTE_BASE, GRAM_BASE, GRAM_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bytes of text that are hashed at once, and text bytes of the documents handled together.
PIECE, CHUNK = 1 << 18, 1 << 19
#: Rows of an Arrow batch of texts at most.
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where it is unset, one in /tmp if all tasks run in
    the driver's own process, as in tests; else an error, since executors wouldn't see one another's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return "/tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so losing executors costs no earlier work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept("tables")[path] = None
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> list[str]:
    """Paths of the tables that cut() has written in this process and release() hasn't removed."""
    return list(kept("tables"))


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables of the shared folder. Only for those that no DataFrame still to be run reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        kept("tables").pop(path, None)


class Rows:
    """A table whose columns have plain names, __c0 and so on by position, whatever the original ones are: dots, quotes, names that
    differ by case alone, or an operator's own names. back() gives the original names again."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.plain = [f"__c{i}" for i in range(len(self.names))]
        self.df = docs.toDF(*self.plain)

    def column(self, name: str) -> str:
        """The plain name of a column; names are matched by case first, without case if none does."""
        same = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name!r} among {self.names}")
        return self.plain[same[0]]

    def back(self, out: DataFrame, added: dict[str, str | Column]) -> DataFrame:
        """out with the original columns under their names, but for those that an added one replaces (whatever their case), and the
        added ones, by name."""
        new = {a.lower() for a in added}
        stay = [F.col(c).alias(n) for c, n in zip(self.plain, self.names, strict=True) if n.lower() not in new]
        return out.select(*stay, *[(F.col(c) if isinstance(c, str) else c).alias(a) for a, c in added.items()])


def with_fields(df: DataFrame, fields: str) -> StructType:
    """The schema of df and further fields, for functions that add columns to Arrow batches."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> tuple[DataFrame, int]:
    """df with a gapless rank by `order` from 0, and the number of rows. No window over all rows: the rows are range-partitioned and
    sorted, then each partition's offset is added. `order` must be a total order up to equal rows. df should be narrow, as it is
    written once."""
    mid = f"__{rank}_mid"
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id()))
    part, at = F.shiftrightunsigned(mid, 33), F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row per partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    spark = df.sparkSession
    base = spark.createDataFrame(offsets or [(0, 0)], "__p long, __base long")
    out = placed.join(F.broadcast(base), part == F.col("__p")).withColumn(rank, F.col("__base") + at)
    return out.drop("__p", "__base", mid), total


def heavy_join(big: DataFrame, small: DataFrame, on: list[str], size: str, share: int = 1000) -> DataFrame:
    """big joined with small, which has one row a key, on columns that one key may dominate. size: a column of small with the number of
    big's rows of that key, dropped from the result. Keys of more than 1 / share of all rows counted are fewer than `share`; they are
    broadcast, so their rows stay where they are; the others meet by a shuffle. Both tables are read twice."""
    total = small.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    hot = small.where(F.col(size) > total // share)
    common = big.join(F.broadcast(hot.drop(size)), on)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(F.col(size) <= total // share).drop(size), on)
    return common.unionByName(rest)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that every bit depends on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def kept(name: str) -> dict:
    """A store of this process; module globals would travel with every function that is sent to executors."""
    return sys.__dict__.setdefault(f"_tessella_{name}", {})


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = kept("powers").get(base)
    if have is None or len(have[0]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        one = lambda b: np.cumprod(np.concatenate([np.ones(1, U), np.full(m - 1, b, U)]), dtype=U)
        have = one(base), one(pow(base, -1, 1 << 64))
        if m <= 1 << 20:
            kept("powers")[base] = have
    return have


def byte_table(separators: str, fold: bool) -> np.ndarray:
    """What each byte becomes: 0 inside separators, else itself, A-Z as a-z if fold. separators: "space" (0x20, 0x09-0x0D) or
    "alnum" (every ASCII byte but digits and letters)."""
    t = np.arange(256, dtype=np.uint8)
    if fold:
        t[65:91] += 32
    if separators == "space":
        t[[0x20, *range(0x09, 0x0E)]] = 0
        t[0] = 255  # a zero byte is a word's byte; no byte of UTF-8 is 255
    else:
        keep = np.zeros(256, bool)
        keep[0x30:0x3A] = keep[0x61:0x7B] = keep[0x80:] = True
        keep[0x41:0x5B] = fold
        t[~keep] = 0
    return t


class Words:
    """The words of several texts, one after another: hash, text number, and byte range of each; first[i]:first[i + 1] are those of text i."""

    __slots__ = ("hash", "doc", "start", "end", "first")

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, n_docs: int) -> None:
        self.hash, self.doc, self.start, self.end = hashes, doc, start, end
        self.first = np.searchsorted(doc, np.arange(n_docs + 1))

    def __len__(self) -> int:
        return len(self.hash)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and each text's first byte (and the end)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def words_of(column: pa.Array, table: np.ndarray) -> Words:
    """Words by byte_table() of a string column without nulls. A word never reaches from one text into the next."""
    data, offsets = text_bytes(column)
    n = len(data)
    mask = table[data] != 0
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, mask[:-1]
        after[-1], after[:-1] = False, mask[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = False
        after[inner - 1] = False
    start = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    del mask, before, after
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):  # pieces of whole words
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        lo, hi = start[at], end[to - 1]
        p, q = powers(BYTE_BASE, int(hi - lo) + 1)
        s = np.zeros(hi - lo + 1, U)
        np.cumsum(table[data[lo:hi]].astype(U) * p[: hi - lo], out=s[1:])
        a, b = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix((s[b] - s[a]) * q[a] + (b - a).astype(U))
        at = to
    return Words(out, np.searchsorted(offsets, start, "right") - 1, start, end, len(column))


def sums(hashes: np.ndarray, base: int = GRAM_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which ranged() takes the hash of any run of words."""
    p, q = powers(base, len(hashes) + 1)
    s = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * p[: len(hashes)], out=s[1:])
    return s, q


def ranged(s: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the word runs a:b."""
    return mix((s[0][b] - s[0][a]) * s[1][a] + (b - a).astype(U))


def grams(hashes: np.ndarray, k: int, base: int = GRAM_BASE) -> np.ndarray:
    """Hashes of all runs of k words; empty with fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    a = np.arange(n)
    return ranged(sums(hashes, base), a, a + k)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches have BATCH_ROWS rows at most in this session, as a batch of whole texts is held by the JVM and by a Python
    worker at once. A smaller setting stays. For those who own the session (the queries and the pipeline); operators don't call it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with about `limit` bytes of text each, one row at least, and each one's texts, nulls as empty."""
    texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield batch.slice(row, to - row), texts.slice(row, to - row)
        row = to


def sent(spark: SparkSession, value: object) -> Broadcast:
    """value for functions on executors, which read it with got(); its class travels with it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def got(value: Broadcast) -> object:
    return pickle.loads(value.value)


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart, as two long columns t1 and t2; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("t2")]
