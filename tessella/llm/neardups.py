"""Near-duplicate groups by min-max hashing.

Every hash function of a text's shingles gives two signature values, its least and its greatest value, so half as many hashes are
evaluated as there are values; a value agrees between two sets with the probability of their Jaccard similarity. Bands of values
propose candidates, which are then compared on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, byte_table, chunks, cut, grams, heavy_join, mix, text_key, words_of
from .graph import components

#: 64 hashes make 128 values in 32 bands of four: a pair of similarity 0.8 shares no band once in 2e7.
HASHES, BAND = 64, 4
#: Values that must agree before full sets are compared: at similarity 0.8, fewer do once in 1e12.
AGREE = 70
#: Texts of a block that one task compares, and shingles of its texts in all, about; and texts of a band's bucket whose signatures are
#: compared in one task.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
BUCKET = 2048


def shingles(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as hashes, and each one's text number; ordered by text, then hash. A text with fewer than
    k words has the sequence of all as its one shingle, a text without words none."""
    g = grams(words.hash, k)
    doc = words.doc[: len(g)]
    whole = doc == words.doc[k - 1 :] if len(g) else np.zeros(0, bool)
    g, doc = g[whole], doc[whole]
    count = np.diff(words.first)
    for i in np.flatnonzero((count > 0) & (count < k)):
        g, doc = np.append(g, mix(grams(words.hash[words.first[i] : words.first[i + 1]], int(count[i])))), np.append(doc, i)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], doc[new]


def signature(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of least and greatest values of each run at[i]:at[i + 1] of g; no run may be empty."""
    rng = np.random.default_rng(20240607)
    flips, factors = rng.integers(0, 1 << 63, HASHES, np.uint64), rng.integers(0, 1 << 63, HASHES, np.uint64) << np.uint64(1) | np.uint64(1)
    out = np.empty((len(at), 2 * HASHES), np.uint64)
    for j in range(HASHES):
        h = (g ^ flips[j]) * factors[j]
        out[:, 2 * j] = np.minimum.reduceat(h, at)
        out[:, 2 * j + 1] = np.maximum.reduceat(h, at)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A hash of each band's values and number."""
    bands = values.shape[1] // BAND
    parts = values.reshape(len(values), bands, BAND)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(values), bands)).copy()
    for i in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def signatures(rows: DataFrame, k: int, fold: bool) -> DataFrame:
    """From (doc_id, t1, t2, text): (doc_id, t1, t2, n, s1, s2, bands, sketch): text key, number of shingles, 128-bit hash of their set,
    keys of the bands, and the last byte of each signature value."""
    table = byte_table("space", fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in chunks(batch, "text"):
                n = len(part)
                g, doc = shingles(words_of(body, table), k)
                count = np.bincount(doc, minlength=n)
                some = np.flatnonzero(count)
                at = np.searchsorted(doc, some)
                s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                bands = np.zeros((n, 2 * HASHES // BAND), np.uint64)
                sketch = np.zeros((n, 2 * HASHES), np.uint8)
                if len(some):
                    s1[some] = np.add.reduceat(mix(g), at)
                    s2[some] = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), at)
                    values = signature(g, at)
                    bands[some] = band_keys(values)
                    sketch[some] = (mix(values) >> np.uint64(56)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), pa.array(bands.view(np.int64).ravel()))
                raw = binaries(sketch.tobytes(), np.full(n, sketch.shape[1]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "t1", "t2")), pa.array(count.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists, raw], names=["doc_id", "t1", "t2", "n", "s1", "s2", "bands", "sketch"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, n long, s1 long, s2 long, bands array<long>, sketch binary")


def binaries(data: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary column of values of these sizes, one after another in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def groups_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in `by`; equal ones must follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(starts, starts[1:]):
            now = tuple(keys[lo].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def pairs(links: list[tuple[int, int]], *more) -> pa.RecordBatch:
    """(a, b) of links, and further columns."""
    return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)), *(c for _, c in more)], names=["a", "b", *(n for n, _ in more)])


def alike(n: np.ndarray, sketch: np.ndarray, root: np.ndarray, pivots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between pivots and any other texts whose sketches agree and whose sizes allow the similarity, none between those connected
    already (by root, changed in place)."""
    order = np.argsort(n, kind="stable")
    sizes, out = n[order], []
    for i in pivots.tolist():
        lo, hi = np.searchsorted(sizes, -(-percent * n[i] // 100), "left"), np.searchsorted(sizes, 100 * n[i] // percent, "right")
        others = order[lo:hi]
        others = others[root[others] != root[i]]
        if len(others):
            for j in others[(sketch[others] == sketch[i]).sum(axis=1) >= AGREE].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((i, j))
    return out


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) where enough signature values agree, such that any two texts of a band's bucket that agree and whose sizes allow
    the similarity are connected. classes: node, n, bands, sketch.

    A bucket of BUCKET texts at most is compared in one task, with its first text first and then, of what that leaves apart, every
    text with every other. Of larger buckets see large_buckets()."""
    held = classes.select("node", F.explode("bands").alias("h"))
    shared = held.groupBy("h").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("size > 1")
    met = cut(held.join(shared, "h"))
    facts = classes.select("node", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            h, node, n = (table.column(c).to_numpy() for c in ("h", "node", "n"))
            sketch = sketches(table.column("sketch"))
            first = np.flatnonzero(np.diff(h, prepend=h[0] ^ 1) != 0)
            bucket = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            with_first = (sketch == sketch[first[bucket]]).sum(axis=1) >= AGREE
            root = np.where(with_first, first[bucket], np.arange(len(h)))
            links = [(int(node[first[bucket[i]]]), int(node[i])) for i in np.flatnonzero(with_first & (root != np.arange(len(h)))).tolist()]
            left = np.flatnonzero(~with_first)  # of buckets with three texts or more, all are compared with these
            for b in np.unique(bucket[left]).tolist():
                lo, hi = int(first[b]), int(first[b + 1]) if b + 1 < len(first) else len(h)
                if hi - lo > 2:
                    found = alike(n[lo:hi], sketch[lo:hi], root[lo:hi], left[np.searchsorted(left, lo) : np.searchsorted(left, hi)] - lo, percent)
                    links += [(int(node[lo + i]), int(node[lo + j])) for i, j in found]
            if links:
                yield pairs(links)

    small = met.where(F.col("size") <= BUCKET).select("h", "node").join(facts, "node")
    links = cut(small.repartition("h").sortWithinPartitions("h", "node").mapInArrow(run, "a long, b long"))
    large = met.where(F.col("size") > BUCKET)
    return links.union(large_buckets(cut(large), facts, percent)) if large.limit(1).count() else links


def whole_buckets(batches: Iterator[pa.RecordBatch], least: int = 8 * BUCKET) -> Iterator[pa.Table]:
    """Tables of about `least` rows in which all rows of an h are together; equal ones must follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            h = batch.column("h").to_numpy()
            if sum(b.num_rows for b in held) >= least:
                last = held[-1].column("h")[-1].as_py()
                ends = np.flatnonzero(h != last)
                if len(ends):
                    if ends[0]:
                        held.append(batch.slice(0, ends[0]))
                        batch = batch.slice(ends[0])
                    yield pa.Table.from_batches(held)
                    held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def large_buckets(large: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect any two texts of a large bucket that agree. large: h, node, size, lo, hi; facts: node, n, sketch.

    Every text is compared with the first and the last of its buckets. What isn't connected with a bucket's first text then, by this bucket
    or any other, is compared with the whole bucket, in blocks of about BUCKET texts on either side. So work is quadratic only in what a
    bucket has of texts unlike its ends."""
    stars = large.select("node", F.explode(F.array("lo", "hi")).alias("b")).where("node <> b")
    stars = stars.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    side = lambda c: facts.select(F.col("node").alias(c), F.col("sketch").alias(f"{c}_sketch"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (sketches(batch.column(c)) for c in ("a_sketch", "b_sketch"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))

    links = cut(stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sketch", "b_sketch").mapInArrow(agree, "a long, b long"))
    now = cut(large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
    main = now.where("node = lo").select("h", F.col("root").alias("main"), F.col("size").alias("rows"))
    now = cut(heavy_join(now.select("h", "node", "size", "root"), cut(main), ["h"], "rows"))
    loose = now.where("root <> main").select("h", "node")
    many = loose.groupBy("h").agg(F.count("*").alias("loose"))
    blocks = lambda c: F.expr(f"({c} + {BUCKET - 1}) div {BUCKET}")
    mixed = now.join(many, "h").withColumn("rows", blocks("size")).withColumn("groups", blocks("loose"))
    number = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    every = mixed.withColumn("block", number("rows")).withColumn("group", upto("groups")).withColumn("pivot", F.lit(False))
    each = mixed.where("root <> main").withColumn("group", number("groups")).withColumn("block", upto("rows")).withColumn("pivot", F.lit(True))
    tasks = every.unionByName(each).select("h", (F.col("group") * (1 << 31) + F.col("block")).alias("pair"), "node", "root", "pivot").join(facts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["h", "pair"]):
            node = rows.column("node").to_numpy()
            rows = rows.take(np.unique(node, return_index=True)[1])  # a pivot of this block stands once, as pivot
            node, n, pivot, root = (rows.column(c).to_numpy() for c in ("node", "n", "pivot", "root"))
            found = alike(n, sketches(rows.column("sketch")), root.copy(), np.flatnonzero(pivot), percent)
            if found:
                yield pairs([(int(node[i]), int(node[j])) for i, j in found])

    rest = tasks.select("h", "pair", "node", "root", "pivot", "n", "sketch").repartition("h", "pair").sortWithinPartitions("h", "pair", "node", F.desc("pivot"))
    return links.union(cut(rest.mapInArrow(run, "a long, b long")))


class Block:
    """The sets of one task's texts; finds links between those that aren't connected yet."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        self.node = table.column("node").to_numpy()
        self.sketch = sketches(table.column("sketch"))
        self.percent = percent
        self.g = np.frombuffer(b"".join(table.column("set").to_pylist()), np.uint64)
        self.n = table.column("n").to_numpy()
        self.at = np.cumsum(self.n) - self.n

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are similar to i, on full sets."""
        n, m = self.n[i], self.n[others]
        others = others[100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)]
        others = others[(self.sketch[others] == self.sketch[i]).sum(axis=1) >= AGREE]
        own = self.g[self.at[i] : self.at[i] + n]
        kept, begin = [others[:0]], 0
        while begin < len(others):  # of about BLOCK_SHINGLES shingles at once
            end = begin + max(1, int(np.searchsorted(np.cumsum(self.n[others[begin:]]), BLOCK_SHINGLES, "right")))
            some, begin = others[begin:end], end
            m = self.n[some]
            ends = np.cumsum(m)
            theirs = self.g[np.arange(ends[-1]) + np.repeat(self.at[some] - (ends - m), m)]
            spot = np.minimum(np.searchsorted(own, theirs), n - 1)
            same = np.add.reduceat((own[spot] == theirs).astype(np.int64), ends - m)
            kept.append(some[100 * same >= self.percent * (n + m - same)])
        return np.concatenate(kept)


def union_links(block: Block, pivots: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what pivots can be connected with, none between those connected already. root: of each text, changed in place."""
    out = []
    for i in pivots:
        for j in block.linked(i, np.flatnonzero(root != root[i])):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((int(block.node[i]), int(block.node[j])))
    return out


def with_sets(rows: DataFrame, k: int, fold: bool) -> DataFrame:
    """rows with their column text replaced by set, the sorted hashes of its shingles."""
    table = byte_table("space", fold)
    stay = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in chunks(batch, "text"):
                g, doc = shingles(words_of(body, table), k)
                raw = binaries(g.tobytes(), 8 * np.bincount(doc, minlength=len(part)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), raw], names=[*stay, "set"])

    kinds = dict(rows.dtypes)
    return rows.select(*stay, "text").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in stay), "set binary"]))


def compared(tasks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, done) within each task (task1, task2: long). tasks: node, root, pivot (whether to compare it with all), whole (whether
    no other task has texts of this cluster), n, sketch, set. Links of whole clusters lead from each component's least node to all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["task1", "task2"]):
            node = rows.column("node").to_numpy()
            rows = rows.take(np.unique(node, return_index=True)[1])
            block = Block(rows, percent)
            root = rows.column("root").to_numpy().copy()
            links = union_links(block, np.flatnonzero(rows.column("pivot").to_numpy()), root)
            whole = bool(rows.column("whole")[0].as_py())
            if whole and links:
                _, first, number = np.unique(root, return_index=True, return_inverse=True)  # nodes are in order
                least = block.node[first][number.ravel()]
                links = [(int(a), int(b)) for a, b in zip(least, block.node, strict=True) if a != b]
            if links:
                yield pairs(links, ("done", pa.array([whole] * len(links))))

    rows = tasks.select("task1", "task2", "node", "root", "pivot", "whole", "n", "sketch", "set")
    return rows.repartition("task1", "task2").sortWithinPartitions("task1", "task2", "node", F.desc("pivot")).mapInArrow(run, "a long, b long, done boolean")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, fold: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, t1, t2, n_shingles, component_id), a row for each of docs: documents whose sets of distinct k-word shingles have a
    Jaccard similarity of at least percent / 100 are linked, component_id is the least key that links lead to; t1, t2 is text_key().

    Words are runs of other than ASCII white space, A-Z lower-cased if fold. Equal sets are one node whatever their number. Band
    buckets connect possible partners into clusters; a cluster is dealt in blocks of about BLOCK texts or BLOCK_SHINGLES shingles, each
    with the cluster's first text, and each block compares full sets until it is connected or exhausted. What is then not connected to
    the first text of a cluster of several blocks is compared with all its blocks. So no pairs are emitted and no cluster is
    collected, and every link that bands propose counts. Two sets at the threshold share no band once in 2e7 pairs.
    Null and empty texts have no shingles and are linked with nothing; their component is their own key. Texts of any length count
    whole. Rows of equal text but other keys are in one component; repeated keys are rows of their own. A null key counts as greatest.
    An empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    return grouped(docs, k, percent, fold, text, key).drop("root")


def grouped(docs: DataFrame, k: int, percent: int, fold: bool, text: str, key: str) -> DataFrame:
    """near_duplicates() with root, a number of each component, which keys may not tell apart; null without shingles."""
    given = Rows(docs)
    body = F.col(given.column(text))
    rows = given.df.select(F.col(given.column(key)).alias("doc_id"), *text_key(body), F.coalesce(body, F.lit("")).alias("text"))
    sig = cut(signatures(rows, k, fold))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t1", "t2"))
    classes = sig.where("n > 0").groupBy("s1", "s2", "n").agg(first.alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "copies", F.col("rep.doc_id").alias("id"), "rep.t1", "rep.t2", "bands", "sketch"))

    clusters = components(candidates(classes, percent)).withColumnRenamed("root", "cluster")
    placed = cut(clusters.join(classes.select("node", "n", "id", "t1", "t2", "sketch"), "node"))
    blocks = F.greatest(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}"), F.expr(f"(sum(n) + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES}"))
    sizes = cut(placed.groupBy("cluster").agg(F.count("*").alias("size"), blocks.alias("blocks")))
    placed = heavy_join(placed, sizes, ["cluster"], "size").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    texts = rows.withColumnsRenamed({"t1": "k1", "t2": "k2"})
    members = placed.join(texts, (placed.t1 == texts.k1) & (placed.t2 == texts.k2) & placed.id.eqNullSafe(texts.doc_id))
    members = with_sets(members.select("node", "cluster", "block", "blocks", "n", "sketch", "text"), k, fold)
    members = cut(members.dropDuplicates(["node"]))  # the sets of texts that have possible partners; equal rows gave one each
    dealt = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    tasks = members.withColumn("task2", F.explode(dealt)).select("*", F.col("cluster").alias("task1"), F.col("node").alias("root"), F.lit(True).alias("pivot"), (F.col("blocks") == 1).alias("whole"))
    links = cut(compared(tasks, percent))
    roots = links.where("done").select(F.col("b").alias("node"), F.col("a").alias("root"))
    large = members.where("blocks > 1")
    if large.limit(1).count():
        roots = roots.union(components(large_links(large, links.where("not done").select("a", "b"), percent)))

    ids = cut(classes.join(roots, "node", "left").select("s1", "s2", "n", "copies", "id", F.coalesce("root", "node").alias("root")))
    least = cut(ids.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("size")))
    ids = cut(heavy_join(ids.drop("id"), least, ["root"], "size"))
    some = heavy_join(sig.where("n > 0").select("doc_id", "t1", "t2", "n", "s1", "s2"), ids, ["s1", "s2", "n"], "copies")
    none = sig.where("n = 0").select("doc_id", "t1", "t2", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    every = some.select("doc_id", "t1", "t2", "n", "root", "component_id").union(none)
    return every.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), "component_id", "root")


def large_links(large: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """links, and those of clusters of several blocks between what isn't connected to the cluster's first text and any block. A task has
    one group of loose texts as pivots and one block of the cluster."""
    now = cut(large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
    main = now.where("node = cluster").select("cluster", F.col("root").alias("main"))
    sizes = now.groupBy("cluster").agg(F.count("*").alias("size"))
    now = cut(heavy_join(now, main.join(sizes, "cluster"), ["cluster"], "size"))
    loose = now.where("root <> main")
    if not loose.limit(1).count():
        return links
    groups = F.greatest(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}"), F.expr(f"(sum(n) + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES}"))
    groups = loose.groupBy("cluster").agg(groups.alias("groups")).join(sizes, "cluster")
    now = heavy_join(now, cut(groups), ["cluster"], "size")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    every = now.withColumn("group", upto("groups")).withColumn("pivot", F.lit(False))
    each = now.where("root <> main").withColumn("block", upto("blocks")).withColumn("group", F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups"))).withColumn("pivot", F.lit(True))
    tasks = every.unionByName(each).select("*", F.col("cluster").alias("task1"), (F.col("group") * (1 << 31) + F.col("block")).alias("task2"), F.lit(False).alias("whole"))
    return links.union(cut(compared(tasks, percent)).select("a", "b"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of near_duplicates(): the least key's, a null key greatest, then by text key; of rows equal in both,
    the one whose other columns as JSON have the least hash. Rows without shingles are linked with nothing, so they all stay. All
    columns of docs stay, whatever their names."""
    each = grouped(docs, k, percent, True, text, key).groupBy("root", "doc_id", "t1", "t2").agg(F.count("*").alias("same"))
    each = cut(each)
    least = each.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t1", "t2", "same")).alias("row"))
    found = least.select("row.doc_id", "row.t1", "row.t2", "row.same").union(each.where("root is null").select("doc_id", "t1", "t2", F.lit(0).cast("long")))
    found = cut(found.toDF("id", "t1", "t2", "same"))
    given = Rows(docs)
    one, two = text_key(F.col(given.column(text)))
    rows = given.df.select(*given.plain, one.alias("k1"), two.alias("k2"))
    kept = rows.join(found, [rows["k1"] == found["t1"], rows["k2"] == found["t2"], rows[given.column(key)].eqNullSafe(found["id"])])
    if found.where("same > 1").limit(1).count():
        one = kept.where("same > 1").groupBy("k1", "k2", "id").agg(F.min_by(F.struct(*given.plain), F.xxhash64(F.to_json(F.struct(*given.plain)))).alias("row"))
        kept = kept.where("same < 2").select(*given.plain).unionByName(one.select("row.*"))
    return given.back(kept, {})
