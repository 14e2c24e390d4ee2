from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int, str | None, str]]:
    """(doc_id, text, source): copies, near copies, shared passages, repeated lines, nulls, empty and long texts."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    passage = prose(rng, 60)
    texts: list[str | None] = [None, "", " \n\t", "one", "one two", "One two", "x " * 200, "Ünïcode café 漢字 😀 " * 15]
    texts += base + [base[0]] * 5
    for i in range(12):  # near copies of one text, some below the threshold
        words = base[1].split()
        for _ in range(i):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 40)}\n{passage} {prose(rng, 30)}" for _ in range(4)]
    texts += [(prose(rng, 40) + "\n") * 3, prose(rng, 9000, 5000), "a" * 5000]
    texts += ["Released under the MIT License.", prose(rng, 20) + " Licensed under the Apache License, Version 2.0. CC BY-NC", "don't stop  --  1234 <|endoftext|>"]
    rng.shuffle(texts)
    return [(i * 3, t, f"src{i % 2}") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, s, len(t or ""), "x", 1, "y") for i, t, s in corpus], "doc_id long, text string, source string, n_chars long, kept string, rank int, t1 string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
