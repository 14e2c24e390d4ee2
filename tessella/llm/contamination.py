"""Benchmark passages in documents by a prefix-filtered set join.

Every window of an item is a set of placed shingles that a document must contain whole. Ordered by rarity in the corpus, the rarest
shingle alone is the prefix that containment needs; documents are joined with windows on it, the place of the shingle must leave room
for the window within the document (length and position), and what is left is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GRAM_BASE_2, Rows, byte_table, chunks, got, grams, ranged, sent, sums, with_fields, words_of

#: Words of a shingle, and bytes of benchmark text whose index is sent to executors at once.
SHINGLE, BLOCK_BYTES = 3, 4 << 20


class Vocabulary:
    """The distinct shingles of windows by their size in words (at most SHINGLE; a shorter window is its own shingle), numbered on."""

    def __init__(self, hashes: dict[int, np.ndarray]) -> None:
        self.sizes = sorted(hashes)
        self.hashes = {k: np.unique(hashes[k]) for k in self.sizes}
        ends = np.cumsum([0, *(len(self.hashes[k]) for k in self.sizes)])
        self.base = dict(zip(self.sizes, ends.tolist(), strict=False))
        self.total = int(ends[-1])
        #: Marks of the leading 20 bits; most other shingles fail here.
        self.marks = {k: np.zeros(1 << 20, bool) for k in self.sizes}
        for k in self.sizes:
            self.marks[k][(self.hashes[k] >> np.uint64(44)).astype(np.int64)] = True

    def number(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Numbers of shingles of k words that are in the vocabulary."""
        return np.searchsorted(self.hashes[k], hashes) + self.base[k]

    def places(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers at which a shingle of the vocabulary starts, and its number."""
        ats, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in self.sizes:
            g = grams(words.hash, k)
            if not len(g):
                continue
            at = np.flatnonzero(self.marks[k][(g >> np.uint64(44)).astype(np.int64)])
            at = at[words.doc[at] == words.doc[at + k - 1]]
            spot = np.minimum(np.searchsorted(self.hashes[k], g[at]), len(self.hashes[k]) - 1)
            right = self.hashes[k][spot] == g[at]
            ats.append(at[right])
            numbers.append(spot[right] + self.base[k])
        return np.concatenate(ats), np.concatenate(numbers)


class Index:
    """The distinct windows of some items, as places in the items' word hashes, and their items. Its size is bounded by that of the
    items' text: a few numbers a word."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        items = sorted(set(items))
        words = words_of(pa.array([t for _, t in items], pa.large_string()), byte_table("alnum", True))
        self.window, self.words = window, words.hash
        count = np.diff(words.first)
        size = np.minimum(count, window)
        each = np.where(count > 0, count - size + 1, 0)  # windows of each item
        owner = np.repeat(np.arange(len(items)), each)
        start = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + words.first[owner]
        size = size[owner]
        one, two = (ranged(sums(words.hash, *base), start, start + size) for base in ((), (GRAM_BASE_2,)))
        key = np.empty(len(start), [("size", np.int64), ("one", np.uint64), ("two", np.uint64)])
        key["size"], key["one"], key["two"] = size, one, two
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.size = start[first], size[first]
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        item = np.array([at[name] for name, _ in items], np.int64)[owner] if len(owner) else owner
        pairs = np.unique(np.stack([number.ravel(), item], axis=1), axis=0)
        self.item = pairs[:, 1].astype(np.int32)
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1))
        self.hashes = {k: grams(words.hash, k) for k in sorted(set(np.minimum(self.size, SHINGLE).tolist()))}

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose shingles have k words, and the hashes of all their shingles, as many for each window as it has, one after another."""
        mine = np.flatnonzero(np.minimum(self.size, SHINGLE) == k)
        n = self.size[mine] - k + 1
        owner = np.repeat(mine, n)
        return owner, self.hashes[k][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.start[owner]]

    def vocabulary(self) -> Vocabulary:
        return Vocabulary({k: self.shingles(k)[1] for k in self.hashes})

    def order(self, vocabulary: Vocabulary, counts: np.ndarray) -> None:
        """Chooses each window's rarest shingle as its prefix (the first of equals)."""
        self.known = vocabulary
        prefix, offset = np.zeros(len(self.start), np.int64), np.zeros(len(self.start), np.int64)
        for k in self.hashes:
            owner, hashes = self.shingles(k)
            number = vocabulary.number(k, hashes)
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            by = np.lexsort((place, counts[number], owner))
            best = by[np.unique(owner[by], return_index=True)[1]]
            prefix[owner[best]], offset[owner[best]] = number[best], place[best]
        by = np.argsort(prefix, kind="stable")
        self.posting, self.offset = by.astype(np.int32), offset[by].astype(np.int32)
        self.posting_at = np.searchsorted(prefix[by], np.arange(vocabulary.total + 1))
        self.hashes = {}

    def occurrences(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window number) of every place where a window stands."""
        at, shingle = self.known.places(words)
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = 1 << 16
        for lo in range(0, len(at), step):
            lengths = (self.posting_at[shingle[lo : lo + step] + 1] - self.posting_at[shingle[lo : lo + step]]).astype(np.int64)
            owner = np.repeat(np.arange(lo, lo + len(lengths)), lengths)
            post = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + self.posting_at[shingle[owner]]
            window, start = self.posting[post].astype(np.int64), at[owner] - self.offset[post]
            doc = words.doc[at[owner]]
            fits = (start >= words.first[doc]) & (start + self.size[window] <= words.first[doc + 1])
            window, start = window[fits], start[fits]
            for i in range(self.window):
                n = self.size[window]
                theirs = self.words[np.minimum(self.start[window] + i, len(self.words) - 1)]
                same = (i >= n) | (words.hash[np.minimum(start + i, len(words.hash) - 1)] == theirs)
                window, start = window[same], start[same]
            starts.append(start)
            windows.append(window)
        return np.concatenate(starts), np.concatenate(windows)


def corpus_counts(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each shingle of the vocabulary stands in all documents. Only the vocabulary is sent to executors."""
    table, size = byte_table("alnum", True), vocabulary.total
    known = sent(texts.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = got(known)
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, part in chunks(batch, "text"):
                total += np.bincount(voc.places(words_of(part, table))[1], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "n"])

    out = np.zeros(size, np.int64)
    for r in texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect():  # as many rows as the vocabulary
        out[r.shingle] = r.n
    return out


FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def search(rows: DataFrame, text: str, index) -> DataFrame:
    """rows with FOUND: word ranges in which windows of the index stand, and their items."""
    table = byte_table("alnum", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = got(index)
        for batch in batches:
            for part, texts in chunks(batch, text):
                words = words_of(texts, table)
                start, window = ix.occurrences(words)
                spans: list[list[dict]] = [[] for _ in range(len(part))]
                items: list[list[str]] = [[] for _ in range(len(part))]
                if len(start):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + ix.size[window], -1)
                    hit = np.cumsum(change[:-1]) > 0
                    edge = np.ones(len(words), bool)
                    edge[1:] = (hit[1:] != hit[:-1]) | (words.doc[1:] != words.doc[:-1])
                    at = np.flatnonzero(edge)
                    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(words)], strict=True):
                        if hit[a]:
                            d = int(words.doc[a])
                            spans[d].append({"start": a - int(words.first[d]), "end": b - int(words.first[d])})
                    pair = np.unique(np.stack([words.doc[start], window], axis=1), axis=0)
                    ends = np.append(np.flatnonzero(np.diff(pair[:, 0], prepend=-1)), len(pair))
                    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                        found = {i for w in pair[lo:hi, 1] for i in ix.item[ix.item_at[w] : ix.item_at[w + 1]].tolist()}
                        items[int(pair[lo, 0])] = [ix.names[i] for i in sorted(found)]
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(words.first).astype(np.int64)), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=[*part.schema.names, "n_words", "spans", "items"])

    return rows.mapInArrow(run, with_fields(rows, FOUND))


def pieces(items: DataFrame, window: int, limit: int) -> DataFrame:
    """items (name, text) with every text of more than `limit` bytes in pieces of about so many, each of which begins with the last
    window - 1 words of the one before, so that all windows stand in one piece whole."""
    table = byte_table("alnum", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                for name, text in zip(part.column("name").to_pylist(), texts.to_pylist(), strict=True):
                    data = text.encode()
                    out = [text]
                    if len(data) > limit:
                        words = words_of(pa.array([text], pa.large_string()), table)
                        n, lo, out = len(words), 0, []
                        while lo < n:
                            hi = min(n, max(lo + 2 * window, int(np.searchsorted(words.end, words.start[lo] + limit, "right"))))
                            out.append(data[words.start[lo] : words.end[hi - 1]].decode())
                            lo = n if hi == n else hi - window + 1
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array(out, pa.string())], names=["name", "text"])

    return items.mapInArrow(run, "name string, text string")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, spans (word ranges that windows of items cover) and items (names of items with such windows, sorted).

    Words: runs of ASCII letters and digits and all that isn't ASCII, A-Z lower-cased. A window is `window` consecutive words of an
    item, or all of a shorter one that has any. The items are taken in blocks of about block_bytes of text (long ones in pieces): one
    block's index is with the driver and each executor at a time, and every block meets all documents, so the benchmark may be of any
    size. With one block (the usual case) there is no shuffle; with more, the blocks' results meet by row. Of equally rare shingles
    of a window the first is its prefix, which changes no result.
    Null or empty texts and items have no words; a null item name is the string "null"; equal items count once. Whole texts count,
    however long. Repeated rows are repeated; empty tables give no rows or no hits. All columns of docs stay, whatever their names, but
    for those named like an added one (in any case), which the result's replace.
    """
    spark = docs.sparkSession
    given, plain = Rows(benchmark), Rows(docs)
    items = given.df.select(F.coalesce(F.col(given.column(item)).cast("string"), F.lit("null")).alias("name"), F.col(given.column(text)).alias("text")).where("text is not null")
    items = pieces(items.distinct(), window, block_bytes)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    body = plain.column(text)
    texts = plain.df.select(F.col(body).alias("text"))
    results = []
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        index = Index([(r.name, r.text) for r in mine.toLocalIterator()], window)
        vocabulary = index.vocabulary()
        index.order(vocabulary, corpus_counts(texts, vocabulary))
        results.append(search(plain.df, body, sent(spark, index)))
    out = results[0]
    if blocks > 1:
        out = merge_blocks(plain.df, results)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    return plain.back(out.withColumn("n_hit", hit), {c: c for c in ("n_words", "n_hit", "spans", "items")})


def merge_blocks(rows: DataFrame, results: list[DataFrame]) -> DataFrame:
    """One row for each distinct row with what any block found, given back to every copy of it."""
    names = rows.columns
    key = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias("key")
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    found = every.select(key, "n_words", "spans", "items").distinct().groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.array_sort("spans")
    joined = F.aggregate(
        start,
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))),
    )
    return rows.select(*names, key).join(found, "key").select(*names, "n_words", joined.alias("spans"), "items")
