import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import substrings
from tessella.llm.substrings import block_factors, factors, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize(("window", "block"), [(35, 1 << 19), (3, 1 << 19), (1, 1 << 19), (10, 30)])
def test_against_brute_force(docs, corpus, monkeypatch, window, block):
    """Whether an anchor's phrases fit a block or are looked up window by window."""
    monkeypatch.setattr(substrings, "BLOCK_WORDS", block)
    want = {i: v for (i, _, _), v in zip(corpus, brute([t for _, t, _ in corpus], window), strict=True)}
    rows = substring_dedup(docs, window).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        n, removed, left = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, removed)
        assert r.kept == (left if removed else r.text or "")
        assert sum(s.end - s.start for s in r.spans) == removed
        assert r.t1 == "y" and r["rank"] == 1  # columns of the input with clashing names stay


def test_factors_are_copies_of_their_sources(docs, corpus):
    rows = substring_dedup(docs, 35).collect()
    assert any(f.end - f.start > 60 for r in rows for f in r.factors)
    assert all(f.end - f.start >= 35 for r in rows for f in r.factors)
    merged = factors([{"at": 0, "size": 5, "src1": 1, "src2": 1, "src_at": 7}, {"at": 5, "size": 3, "src1": 1, "src2": 1, "src_at": 12}, {"at": 8, "size": 2, "src1": 2, "src2": 1, "src_at": 0}], 4)
    assert merged == [(0, 11, 1, 1, 7), (8, 13, 2, 1, 0)]


def test_digest_empty_and_repeated_rows(spark, empty):
    assert substring_dedup(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = substring_dedup(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string"), 35, digest=True).collect()
    assert sorted(r.n_removed for r in rows) == [0, 40, 40]
    assert {r.kept for r in rows} == {hashlib.sha256(b"").hexdigest()}


def longest(words, i, window):
    """Brute force: the greatest number of windows from i on that stand at another place of the block too."""
    (p, at), best = i, 0
    for q, other in enumerate(words):
        for b in range(len(other) - window + 1):
            if (q, b) != (p, at):
                n = 0
                while at + n < len(words[p]) and b + n < len(other) and words[p][at + n] == other[b + n]:
                    n += 1
                best = max(best, n - window + 1)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_greedy_parse_takes_longest_matches(seed):
    rng = np.random.default_rng(seed)
    window, kinds = 4, (2, 3, 9, 50, 2, 4)[seed]
    words = [rng.integers(1, kinds + 1, rng.integers(window, 40)).astype(np.uint64) for _ in range(12)]
    words += [words[0][3:], np.concatenate([words[1], words[2]]), np.full(30, 7, np.uint64), words[3]]
    words = [w for w in words if len(w) >= window]
    size = np.array([len(w) - window + 1 for w in words])
    parsed = np.array([i % 5 != 0 for i in range(len(words))])
    got = sorted(zip(*(x.tolist() for x in block_factors(size, np.concatenate(words), window, parsed)), strict=True))
    want = []
    for p, w in enumerate(words):
        at = 0
        while parsed[p] and at < size[p]:
            n = longest(words, (p, at), window)
            if n > 0:
                want.append((p, at, n))
            at += max(n, 1)
    assert [g[:3] for g in got] == want and want
    for p, at, n, q, b in got:
        assert (p, at) != (q, b) and (words[p][at : at + n + window - 1] == words[q][b : b + n + window - 1]).all()


def test_groups_stay_whole():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4, 5]
    batches = [pa.RecordBatch.from_pydict({"v": keys[i : i + 2], "w": [3] * len(keys[i : i + 2])}) for i in range(0, len(keys), 2)]
    for limit in (1, 7, 100):
        out = [t.column("v").to_pylist() for t in substrings.whole_groups(iter(batches), "v", "w", limit)]
        assert sum(out, []) == keys and all(a[-1] != b[0] for a, b in zip(out, out[1:]))
    assert len(out) == 1
