"""Duplicate passages by Relative Lempel-Ziv parsing against the whole corpus.

The reference is every text of the corpus. It is indexed as phrases: maximal runs of windows that share their rarest-hashed k-gram, the
anchor, so that equal windows always lie in phrases of one anchor. The index is dealt by anchor into blocks; a phrase of a text meets
the blocks that can hold a match of any of its windows, and no other. In a block, a suffix array of windows gives the longest match of
every place with any other; the greedy parse takes the longest match at the first window that has one, then looks up the windows that
cross the factor's end, and so on. A factor has a whole window of words at least. Factors of neighbouring phrases whose sources follow
one another are joined, and the words in factors are the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GRAM_BASE, GRAM_BASE_2, Rows, byte_table, chunks, cut, grams, heavy_join, ranged, sums, text_key, words_of

#: Words of an anchor, and words of the phrases that a task holds at once. An anchor with more has a block's size by itself; its windows
#: are looked up one by one instead.
ANCHOR, BLOCK_WORDS = 6, 1 << 19


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def phrases(words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, anchor hash, content hash, whether the anchor stands in it more than once) of
    each phrase in each text."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(words) < window:
        return empty
    gram = grams(words.hash, anchor)
    low = sliding_min(gram, window - anchor + 1)  # by window start
    doc = words.doc[: len(low)]
    whole = doc == words.doc[window - 1 :]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(low)))
    at, size = at[whole[at]], size[whole[at]]
    if not len(at):
        return empty
    # Two equal windows of one phrase hold its anchor at two places.
    reach = size + window - anchor
    begin = np.cumsum(reach) - reach
    owner = np.repeat(np.arange(len(at)), reach)
    same = gram[np.arange(reach.sum()) - begin[owner] + at[owner]] == low[at][owner]
    again = np.add.reduceat(same.astype(np.int64), begin) > 1
    return doc[at], at - words.first[doc[at]], size, low[at], ranged(sums(words.hash), at, at + size + window - 1), again


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def places_in(runs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs that begin at `runs` and are `lengths` long: the run's number, and the place, of each of their elements."""
    owner = np.repeat(np.arange(len(runs)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + runs[owner]


def numbered(*keys: np.ndarray) -> np.ndarray:
    """A number for each row of the keys, equal for equal rows, in their order (the first key counts most)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def block_factors(size: np.ndarray, words: np.ndarray, window: int, parsed: np.ndarray) -> tuple[np.ndarray, ...]:
    """The greedy parse of phrases against a block that holds them all. size: windows of each phrase; words: their word hashes, one phrase
    after another; parsed: whether a phrase is to be parsed. (phrase, first window, number of windows, source phrase, source's first
    window) of each factor: the longest run of windows from there on that stands at any other place of the block."""
    none = np.zeros(0, np.int64)
    first = np.cumsum(size + window - 1) - (size + window - 1)
    phrase, at = places_in(first, size)
    own = ranged(sums(words, GRAM_BASE), at, at + window), ranged(sums(words, GRAM_BASE_2), at, at + window)
    rank = numbered(*own)
    twice = np.bincount(rank)[rank] > 1
    if not (twice & parsed[phrase]).any():
        return none, none, none, none, none
    begin = np.cumsum(size) - size
    rest = (begin + size)[phrase] - np.arange(len(phrase))  # windows up to the phrase's end
    # Suffix ranks by doubling: levels[k] tells apart what differs within 2**k windows.
    levels, reach = [rank], 1
    while reach < rest.max() and len(np.unique(rank[twice])) < twice.sum():
        ahead = np.full(len(rank), -1)
        more = np.flatnonzero(rest > reach)
        ahead[more] = rank[more + reach]
        rank = numbered(rank, ahead)
        levels.append(rank)
        reach *= 2
    order = np.flatnonzero(twice)
    order = order[np.argsort(rank[order], kind="stable")]

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Windows that i and j have in common from there on."""
        out = np.zeros(len(i), np.int64)
        most = np.minimum(rest[i], rest[j])
        for k in range(len(levels) - 1, -1, -1):
            open_ = np.flatnonzero(out < most)
            same = levels[k][i[open_] + out[open_]] == levels[k][j[open_] + out[open_]]
            out[open_[same]] += 1 << k
        return np.minimum(out, most)

    best, source = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    beside = common(order[:-1], order[1:])
    best[order[1:]], source[order[1:]] = beside, order[:-1]
    longer = beside > best[order[:-1]]
    best[order[:-1][longer]], source[order[:-1][longer]] = beside[longer], order[1:][longer]

    nxt = np.where(twice, np.arange(len(rank)), len(rank))
    nxt = np.append(np.minimum.accumulate(nxt[::-1])[::-1], len(rank))
    active = np.flatnonzero(parsed)
    now, found = nxt[begin[active]], []
    while len(active):
        inside = now < (begin + size)[active]
        active, now = active[inside], now[inside]
        found.append((active, now))
        now = nxt[now + best[now]]  # the next window that has a match and reaches beyond the factor's end
    of, start = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    length, src = best[start], source[start]
    owner, step = places_in(np.zeros(len(start), np.int64), length + window - 1)
    place = lambda w: first[phrase[w]] + w - begin[phrase[w]]
    if not (words[place(start)[owner] + step] == words[place(src)[owner] + step]).all():
        raise ValueError("a factor differs from its source")  # two windows of one 128-bit hash
    return of, start - begin[of], length, phrase[src], src - begin[phrase[src]]


def whole_groups(batches: Iterator[pa.RecordBatch], by: str, weight: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about `limit` weight in which all rows of a key are together; equal keys must follow one another."""
    held: list[pa.RecordBatch] = []
    have, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in (by, weight))
        before = np.concatenate([[0], np.cumsum(w)])
        starts = np.flatnonzero(key[1:] != key[:-1]) + 1
        lo = 0
        for b in ([0] if held and key[0] != last else []) + starts.tolist():
            if have + before[b] - before[lo] >= limit:
                if b > lo:
                    held.append(batch.slice(lo, b - lo))
                yield pa.Table.from_batches(held)
                held, have, lo = [], 0, b
        held.append(batch.slice(lo))
        have += int(before[-1] - before[lo])
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


FACTOR = "at int, size int, src1 long, src2 long, src_at int"


def duplicate_spans(texts: DataFrame, window: int = 35) -> DataFrame:
    """From (t1, t2, text), a row for each place a text stands at: per distinct text the text, and `whole`, its factors by phrase with
    their sources, and `single`, first words of further windows that stand elsewhere too. Both may be null."""
    anchor = min(ANCHOR, window)
    table = byte_table("space", False)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in chunks(batch, "text"):
                doc, at, size, low, content, again = phrases(words_of(body, table), window, anchor)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([signed(low), signed(content), part.column("t1").take(take), part.column("t2").take(take), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again)], names=["v", "s", "t1", "t2", "at", "size", "again"])

    found = texts.mapInArrow(index, "v long, s long, t1 long, t2 long, at int, size int, again boolean")
    # Anchors that stand once, in text that doesn't repeat itself within one phrase, can't be in an equal window.
    anchors = found.groupBy("v").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.max("again").alias("again"))
    loose = (F.col("lo") != F.col("hi")) | F.col("again")
    anchors = anchors.where((F.col("n") > 1) | loose).select("v", loose.alias("loose"))
    met = cut(found.join(anchors, "v").select("v", "s", "t1", "t2", "at", "size", "loose"))
    place = F.struct("t1", "t2", "at", "size")
    equal = cut(met.groupBy("v", "s").agg(F.count("*").alias("n"), F.min(place).alias("src"), F.max(place).alias("other"), F.first("loose").alias("loose")))
    # A phrase that stands elsewhere as a whole: one factor, whose source is the least place, for that itself the greatest.
    whole = heavy_join(met.select("v", "s", "t1", "t2", "at", "size"), equal.where("n > 1").select("v", "s", "n", "src", "other"), ["v", "s"], "n")
    src = F.when(F.struct("t1", "t2", "at", "size") == F.col("src"), F.col("other")).otherwise(F.col("src"))
    whole = whole.select("t1", "t2", "at", "size", src["t1"].alias("src1"), src["t2"].alias("src2"), src["at"].alias("src_at"))

    each = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    # One place of each phrase beside which its anchor has others; whether it still has to be parsed, and whether its block is too large.
    contexts = equal.where("loose").select("v", "src", (F.col("n") == 1).alias("alone"))
    blocks = contexts.groupBy("v").agg((F.sum(F.col("src.size").cast("long") + (window - 1)) > BLOCK_WORDS).alias("large"))
    open_ = contexts.join(blocks, "v").groupBy("src.t1", "src.t2").agg(F.collect_list(F.struct("src.at", "src.size", "alone", "v", "large")).alias("open"))
    opened = each.join(open_, ["t1", "t2"]).select("t1", "t2", "text", "open")
    named = "v long, t1 long, t2 long, at int, size int, alone boolean, reach int, words binary"

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word hashes of phrases whose blocks fit."""
        for batch in batches:
            for part, body in chunks(batch, "text"):
                words = words_of(body, table)
                runs = part.column("open")
                item = runs.flatten()
                doc = np.repeat(np.arange(len(part)), runs.value_lengths().to_numpy(zero_copy_only=False))
                at, size, large = (item.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
                use = np.flatnonzero(~large)
                for lo in range(0, len(use), 4096):
                    some = use[lo : lo + 4096]
                    reach = (size[some] + window - 1).astype(np.int64)
                    _, where = places_in(at[some] + words.first[doc[some]], reach)
                    offsets = np.concatenate([[0], np.cumsum(8 * reach)]).astype(np.int32)
                    raw = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(words.hash[where].tobytes())])
                    take, own = pa.array(doc[some]), pa.array(some)
                    yield pa.RecordBatch.from_arrays([item.field(3).take(own), part.column("t1").take(take), part.column("t2").take(take), pa.array(at[some].astype(np.int32)), pa.array(size[some].astype(np.int32)), item.field(2).take(own), pa.array(reach.astype(np.int32)), raw], names=["v", "t1", "t2", "at", "size", "alone", "reach", "words"])

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, "v", "reach", BLOCK_WORDS):
            t1, t2, at, size, alone = (block.column(c).to_numpy() for c in ("t1", "t2", "at", "size", "alone"))
            words = np.frombuffer(b"".join(block.column("words").to_pylist()), np.uint64)
            of, start, length, source, src_start = block_factors(size.astype(np.int64), words, window, alone)
            int_ = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(t1[of]), pa.array(t2[of]), int_(at[of] + start), int_(length), pa.array(t1[source]), pa.array(t2[source]), int_(at[source] + src_start)], names=["t1", "t2", "at", "size", "src1", "src2", "src_at"])

    inside = opened.mapInArrow(cut_out, named).repartition("v").sortWithinPartitions("v").mapInArrow(factored, f"t1 long, t2 long, {FACTOR}")
    names = [f.split()[0] for f in FACTOR.split(", ")]
    whole = whole.unionByName(inside).groupBy("t1", "t2").agg(F.collect_set(F.struct(*names)).alias("whole"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of phrases whose blocks are too large."""
        for batch in batches:
            for part, body in chunks(batch, "text"):
                words = words_of(body, table)
                runs = part.column("open")
                item = runs.flatten()
                doc = np.repeat(np.arange(len(part)), runs.value_lengths().to_numpy(zero_copy_only=False))
                at, size, alone, _, large = (item.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                use = np.flatnonzero(large)
                doc, at, size, alone = doc[use], at[use], size[use].astype(np.int64), alone[use]
                one, two = sums(words.hash, GRAM_BASE), sums(words.hash, GRAM_BASE_2)
                ends = np.cumsum(size)
                step = 1 << 18
                lo = 0
                while lo < len(size):
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + step, "right")))
                    owner, pos = places_in(at[lo:hi], size[lo:hi])
                    owner += lo
                    first = pos + words.first[doc[owner]]
                    take = pa.array(doc[owner])
                    yield pa.RecordBatch.from_arrays([signed(ranged(one, first, first + window)), signed(ranged(two, first, first + window)), part.column("t1").take(take), part.column("t2").take(take), pa.array(pos.astype(np.int32)), pa.array(alone[owner])], names=["w1", "w2", "t1", "t2", "pos", "alone"])
                    lo = hi

    if not blocks.where("large").limit(1).count():
        return each.join(whole, ["t1", "t2"], "left").withColumn("single", F.lit(None).cast("array<int>"))
    seen = cut(opened.where(F.exists("open", lambda p: p["large"])).mapInArrow(windows, "w1 long, w2 long, t1 long, t2 long, pos int, alone boolean"))
    twice = cut(seen.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1"))
    single = heavy_join(seen.where("alone").drop("alone"), twice, ["w1", "w2"], "n").groupBy("t1", "t2").agg(F.collect_set("pos").alias("single"))
    return each.join(whole, ["t1", "t2"], "left").join(single, ["t1", "t2"], "left")


def factors(whole: list[dict], window: int) -> list[tuple[int, int, int, int, int]]:
    """The factors of phrases, joined as far as their sources follow one another. (start, end, source's t1, t2, start), in words."""
    out: list[tuple[int, int, int, int, int]] = []
    for p in sorted(whole, key=lambda p: p["at"]):
        at, to = p["at"], p["at"] + p["size"] + window - 1
        if out and out[-1][1] - window + 1 == at and out[-1][2:4] == (p["src1"], p["src2"]) and p["src_at"] - out[-1][4] == at - out[-1][0]:
            out[-1] = (out[-1][0], to, *out[-1][2:])
        else:
            out.append((at, to, p["src1"], p["src2"], p["src_at"]))
    return out


SPAN = "struct<start:int,end:int>"
RESULT = f"t1 long, t2 long, n_words long, n_removed long, kept string, spans array<{SPAN}>, factors array<struct<start:int,end:int,src1:long,src2:long,src_start:int>>"


def parsed(spans: DataFrame, window: int, digest: bool) -> DataFrame:
    """From duplicate_spans(): RESULT for each text; kept is the text left, or its SHA-256 if digest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in chunks(batch, "text"):
                rows = []
                for text, t1, t2, whole, single in zip(body.to_pylist(), *(part.column(c).to_pylist() for c in ("t1", "t2", "whole", "single")), strict=True):
                    words = text.encode().split()
                    parse_ = factors(whole or [], window)
                    runs = [(a, b) for a, b, *_ in parse_] + [(p, p + window) for p in single or []]
                    merged: list[list[int]] = []
                    for a, b in sorted(runs):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    removed = 0
                    if merged:
                        stay = bytearray(b"\1") * len(words)
                        for a, b in merged:
                            stay[a:b] = bytes(b - a)
                            removed += b - a
                        left = b" ".join(compress(words, stay))
                    else:
                        left = b" ".join(words)
                    rows.append((t1, t2, len(words), removed, hashlib.sha256(left).hexdigest() if digest else left.decode() if removed else text, [{"start": a, "end": b} for a, b in merged], [dict(zip(("start", "end", "src1", "src2", "src_start"), f, strict=True)) for f in parse_]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    return spans.select("t1", "t2", "text", "whole", "single").mapInArrow(parse, RESULT)


NAMES = ["t1", "t2", "n_words", "n_removed", "kept", "spans", "factors"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("src1", pa.int64()), ("src2", pa.int64()), ("src_start", pa.int32())]))]


def substring_dedup(docs: DataFrame, window: int = 35, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with n_words, n_removed, kept, spans, factors: each word covered by a run of `window` words that starts at another place
    too, in any text or the same, is removed from kept.

    Words are runs of other than ASCII white space. kept is the text itself where nothing goes, else the words left joined by one
    space; with digest, the SHA-256 of the words left. spans: the removed word ranges; factors: the parse, with each factor's source.
    Equal texts are worked on once; every copy of a text counts as a place, so copies of `window` words or more go in full, the
    first too. Of equally long matches any may be the source, which changes no removed word. An anchor whose phrases have more than
    BLOCK_WORDS words in all isn't gathered in one task: its windows are looked up singly by a shuffle on their hashes, and stand in
    spans but in no factor. Texts of any length are worked on whole, nulls and empty ones have no words; an empty table gives no
    rows; shorter texts lose nothing; repeated rows are repeated. All columns of docs stay, whatever their names, but for those
    named like an added one (in any case), which the result's replace.
    """
    rows = Rows(docs)
    body = F.col(rows.column(text))
    done = parsed(duplicate_spans(rows.df.select(F.coalesce(body, F.lit("")).alias("text"), *text_key(body)), window), window, digest)
    one, two = text_key(body)
    # The old text is moved only if the result keeps it.
    replaced = {n.lower() for n in NAMES[2:]}
    stay = [c for c, n in zip(rows.plain, rows.names, strict=True) if n.lower() not in replaced]
    out = rows.df.select(*stay, one.alias("t1"), two.alias("t2")).join(done, ["t1", "t2"], "left")
    return rows.back(out, {n: n for n in NAMES[2:]})
