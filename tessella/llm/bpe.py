"""Byte-level BPE with a sentencepiece model that is serialised from a rank vocabulary.

Every byte is written as one printable character; a vocabulary entry becomes the piece of its bytes' characters with its negative
rank as score, so that sentencepiece, which joins the best-scored pair first, joins in rank order. Pieces stand at their rank, hence
piece numbers are token ids.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rows, chunks, kept, with_fields

#: Characters of a pre-token up to which its encoding is remembered, and how many are.
REMEMBERED, MEMORY = 48, 150_000


def byte_characters() -> list[str]:
    """A printable character for each byte: consecutive code points from U+0100, none of them white space or special to the library."""
    return [chr(0x100 + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file's lines, base64 of the bytes and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """A protocol buffer field: length-delimited, 32-bit float, or varint (negatives as 64 bits)."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(int(value) & (1 << 64) - 1)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model: pieces 0 to the highest rank, then the unknown piece. Ranks that no entry has are filled with unused pieces.

    Fixed field numbers of the model format: pieces 1 (piece 1, score 2, type 3: unknown 2, unused 5), trainer 2 (type 3: BPE 2,
    vocabulary size 4, unknown, begin, end, padding ids 40 to 43), normaliser 3 (name 1, rules 2, dummy prefix 3, extra white space
    4, escaped white space 5).
    """
    char = byte_characters()
    by_rank = {r: "".join([char[b] for b in token]) for token, r in ranks.items()}
    n = max(by_rank, default=-1) + 1
    pieces = [field(1, field(1, by_rank[r]) + field(2, float(-r))) if r in by_rank else field(1, field(1, f"<gap{r}>") + field(2, 0.0) + field(3, 5)) for r in range(n)]
    pieces.append(field(1, field(1, "<unk>") + field(2, 0.0) + field(3, 2)))
    trainer = field(3, 2) + field(4, n + 1) + field(40, n) + field(41, -1) + field(42, -1) + field(43, -1)
    normaliser = field(1, "identity") + field(2, b"") + field(3, False) + field(4, False) + field(5, False)
    return b"".join(pieces) + field(2, trainer) + field(3, normaliser)


class Codec:
    """Encodes and decodes with a serialised model; what a pre-token gives is remembered, so frequent ones cost a look-up."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.unknown = self.sp.unk_id()
        self.table = dict(enumerate(byte_characters()))
        self.back = {ord(c): b for b, c in self.table.items()}
        self.memory: dict[str, tuple[str, int, bytes]] = {}
        self.piece_bytes: dict[int, bytes] = {}

    def ids(self, pretoken: bytes) -> list[int]:
        mapped = pretoken.decode("latin-1").translate(self.table)
        whole = self.sp.piece_to_id(mapped)  # an entry stands for itself even where no joins lead to it
        return [whole] if whole != self.unknown else self.sp.encode(mapped, num_threads=1)

    def bytes_of(self, i: int) -> bytes:
        got = self.piece_bytes.get(i)
        if got is None:
            got = self.piece_bytes[i] = bytes(self.back[ord(c)] for c in self.sp.id_to_piece(i))
        return got

    def one(self, pretoken: str) -> tuple[str, int, bytes]:
        """Ids as text, their number, and the bytes they decode to."""
        ids = self.ids(pretoken.encode())
        got = ",".join(map(str, ids)), len(ids), b"".join(map(self.bytes_of, ids))
        if len(pretoken) <= REMEMBERED:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[pretoken] = got
        return got

    def encode(self, text: str) -> tuple[list[tuple[str, int, bytes]], int]:
        memory, one = self.memory, self.one
        parts = []
        for t in self.split(text):
            got = memory.get(t)
            parts.append(got if got is not None else one(t))
        return parts, sum([p[1] for p in parts])


def codec(model: bytes, pattern: str) -> Codec:
    """The process's codec for the model."""
    store, key = kept("codecs"), (hashlib.sha256(model).digest(), pattern)
    if key not in store:
        store[key] = Codec(model, pattern)
    return store[key]


def byte_bpe(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with n_tokens, and token_ids and decoded (bytes) or, with digest, ids_sha256 and decoded_sha256.

    Each match of pattern is encoded by itself, as pairs of the lowest rank join first; no special tokens. Whole texts, whatever
    their length; a null or empty text has no tokens, and an empty table gives no rows. Each row by itself: repeated rows are
    repeated, ties can't arise, no shuffle. All columns of docs stay, whatever their names, but for those named like an added one
    (in any case), which the result's replace. Only the vocabulary is sent to executors, whose size is that of its file.
    """
    added = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["token_ids", "decoded"])]
    model = docs.sparkSession.sparkContext.broadcast(serialise(ranks))
    rows = Rows(docs)
    body = rows.column(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(model.value, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part, texts in chunks(batch, body):
                counts, ids, decoded = [], [], []
                for t in texts.to_pylist():
                    parts, n = enc.encode(t)
                    counts.append(n)
                    joined, plain = ",".join([p[0] for p in parts]), b"".join([p[2] for p in parts])
                    ids.append(sha(joined.encode()) if digest else [int(i) for i in joined.split(",")] if joined else [])
                    decoded.append(sha(plain) if digest else plain)
                kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), pa.array(ids, kinds[0]), pa.array(decoded, kinds[1])], names=[*part.schema.names, *added])

    kinds = ("string", "string") if digest else ("array<int>", "binary")
    schema = with_fields(rows.df, f"n_tokens long, {added[1]} {kinds[0]}, {added[2]} {kinds[1]}")
    return rows.back(rows.df.mapInArrow(run, schema), {a: a for a in added})
