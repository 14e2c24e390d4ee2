import random
import re

import pytest

from tessella.llm import neardups
from tessella.llm.graph import components
from tessella.llm.neardups import drop_near_duplicates, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(texts, k):
    out = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if c < "\x7f" else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(ids, texts, k):
    s = sets(texts, k)
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            m = len(s[i] & s[j])
            if s[i] and s[j] and 100 * m >= 80 * (len(s[i]) + len(s[j]) - m):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return [(len(s[i]), ids[find(i)]) for i in range(len(ids))]


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(docs, corpus, k):
    want = {i: v for (i, _, _), v in zip(corpus, brute([i for i, _, _ in corpus], [t for _, t, _ in corpus], k), strict=True)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, k).collect()}
    assert got == want


def family(n, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("limit", [("BLOCK", 8), ("BLOCK_SHINGLES", 700)])
def test_clusters_of_several_blocks(spark, monkeypatch, limit):
    """A cluster larger than a block gives the same components as one compared in one piece."""
    monkeypatch.setattr(neardups, *limit)
    texts = family(60, 1) + family(40, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 2).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute(list(range(len(texts))), texts, 2))}
    assert len(set(got.values())) > 2


@pytest.mark.parametrize("bucket", [2048, 2])
def test_buckets_with_unlike_ends(spark, monkeypatch, bucket):
    """Texts of one bucket that agree are connected, whether they agree with neither end or each with another end."""
    monkeypatch.setattr(neardups, "BUCKET", bucket)
    width = 2 * neardups.HASHES
    part = lambda *runs: b"".join(bytes([v]) * n for v, n in runs)
    sketch = {0: part((1, width)), 9: part((1, 60), (2, 68)), 2: part((1, 70), (6, 58)), 6: part((1, 60), (2, 10), (6, 58))}
    sketch |= {3: part((3, width)), 4: part((3, width)), 5: part((3, 80), (4, 48)), 7: part((5, width))}
    rows = [(i, [77], 100 if i != 4 else 300, bytearray(s)) for i, s in sketch.items()]
    classes = spark.createDataFrame(rows, "node long, bands array<long>, n long, sketch binary")
    got = {r.node: r.root for r in components(neardups.candidates(classes, 80)).collect()}
    agree = lambda a, b: sum(x == y for x, y in zip(sketch[a], sketch[b], strict=True)) >= neardups.AGREE
    assert agree(3, 5) and agree(2, 0) and agree(6, 9) and agree(2, 6) and not agree(6, 0) and not agree(2, 9) and not agree(0, 9)
    assert got[3] == got[5] and {got[i] for i in (0, 2, 6, 9)} == {0} and 7 not in got and 4 not in got


def test_few_frequent_lines(spark, monkeypatch):
    monkeypatch.setattr(neardups, "BUCKET", 20)
    rng = random.Random(7)
    lines = [" ".join(f"l{i}w{j}" for j in range(8)) for i in range(30)]
    texts = []
    for _ in range(700):
        some = rng.sample(lines, 10)
        texts.append("\n".join(some))
        if rng.random() < 0.3:
            texts.append("\n".join([*some[:9], rng.choice(lines)]))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 2).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute(list(range(len(texts))), texts, 2))}


def test_one_of_each_group_stays(docs, corpus):
    want = {i for (i, _, _), (_, c) in zip(corpus, brute([i for i, _, _ in corpus], [t for _, t, _ in corpus], 5), strict=True) if c == i}
    out = drop_near_duplicates(docs, 5)
    assert {r.doc_id for r in out.collect()} == want and out.columns == docs.columns


def test_repeated_rows_and_null_keys_leave_one(spark):
    long = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "a b c d", 5), (1, "a b c d", 5), (1, "a b c d", 7), (None, "e f g h", 1), (None, "e f g h", 1), (None, "i j k l", 1), (2, long, 1), (2, long + " x", 1), (1, "m n o p", 1), (3, "", 1), (3, "", 1)]
    out = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()
    texts = sorted(r.text[:7] for r in out)
    assert texts == ["", "", "a b c d", "e f g h", "i j k l", "m n o p", long[:7]]


def test_defined_results(spark, empty):
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (4, "d e f"), (9, None), (None, "")], "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in rows if r.component_id is not None) == [(-1, 2, 4), (4, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9)]


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    names = list(range(300))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(299) if i not in (99, 180)] + [(names[0], names[0]), (names[5], names[4])]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for part in (names[:100], names[100:181], names[181:]):
        assert {got[n] for n in part} == {min(part)}
