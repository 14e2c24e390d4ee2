import hashlib

import public_tokenizers
import pytest
import tiktoken

from tessella.llm.bpe import Codec, byte_bpe, read_ranks, serialise

RANKS = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def expected():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_as_the_public_library(docs, corpus, expected):
    rows = byte_bpe(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.token_ids == expected.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_digests(docs, expected):
    for r in byte_bpe(docs, RANKS, public_tokenizers.PATTERN, digest=True).collect():
        ids = ",".join(map(str, expected.encode_ordinary(r.text or "")))
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_every_byte_and_odd_texts(expected):
    codec = Codec(serialise(RANKS), public_tokenizers.PATTERN)
    for text in ["".join(map(chr, range(0x300))), "<unk> ▁▁ <gap1> <|endoftext|>", "\x00\x01\x7f", "😀‍👩‍👩", " " * 999, "ab" * 3000]:
        parts, n = codec.encode(text)
        ids = [int(i) for p in parts for i in p[0].split(",")]
        assert ids == expected.encode_ordinary(text) and n == len(ids)
        assert b"".join(p[2] for p in parts) == text.encode()


def test_own_vocabulary_with_unreachable_entry_and_gaps(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"xyz": 400}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([("abc",), ("xyz",), ("axyz abab",), (None,), ("",)], "text string")
    for r in byte_bpe(docs, ranks, public_tokenizers.PATTERN).collect():
        assert r.token_ids == enc.encode_ordinary(r.text or "")


def test_empty_and_clashing(spark, empty):
    assert byte_bpe(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    rows = byte_bpe(spark.createDataFrame([(7, "hi"), (7, "hi")], "n_tokens int, text string"), RANKS, public_tokenizers.PATTERN).collect()
    assert [r.n_tokens for r in rows] == [1, 1]
