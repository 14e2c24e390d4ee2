import re

import pytest

from tessella.llm.contamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, window):
    w = words(text)
    hit, names = set(), set()
    for name, item in items:
        v = words(item)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            part = v[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    names.add("null" if name is None else str(name))
    return len(w), len(hit), sorted(names)


@pytest.fixture(scope="module")
def items(corpus):
    long = [t for _, t, _ in corpus if t and 100 < len(t.split()) < 200]
    return [(10, " ".join(long[0].split()[5:40])), (9, " ".join(long[1].split()[3:13]).upper()), (2, "one"), (3, "x x x"), (4, None), (5, " ... "), (6, "never stands here at all " * 4), (7, "w1 w2"), (None, "café 漢字"), (10, "mit license"), (11, "one")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_against_brute_force(spark, docs, corpus, items, block_bytes):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(docs, bench, 10, block_bytes=block_bytes).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r.n_words, r.n_hit, list(r["items"])) == brute(r.text, items, 10)
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and r.t1 == "y"


def test_ten_word_items_only(spark, docs, corpus, items):
    long = [(n, t) for n, t in items if t and len(words(t)) >= 10]
    for r in contamination(docs, spark.createDataFrame(long, "item_id long, text string"), 10).collect():
        assert (r.n_words, r.n_hit, list(r["items"])) == brute(r.text, long, 10)


def test_empty_tables_and_repeats(spark, docs, empty, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(empty, bench).count() == 0
    assert contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    rows = contamination(spark.createDataFrame([("one",), ("one",), (None,)], "text string"), bench, block_bytes=100).collect()
    assert sorted((r.n_hit, tuple(r["items"])) for r in rows) == [(0, ()), (1, ("11", "2")), (1, ("11", "2"))]
