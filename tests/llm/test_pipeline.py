"""The pipeline stage by stage against plain Python, on the smallest tables; and near-duplicate recall at the threshold."""

import importlib
import math
import random

import public_tokenizers
import pytest
import tiktoken

from tessella.llm.bpe import read_ranks
from tessella.llm.neardups import near_duplicates
from tessella.llm.quality import STATISTICS, train

from . import test_contamination, test_neardups, test_substrings
from .conftest import SF
from .test_quality import slow_statistics


@pytest.fixture(scope="module")
def stages():
    return dict(importlib.import_module("corpus_pipeline").STAGES)


def test_stages_by_plain_python(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    frame = lambda kept: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in sorted(kept.items())], "doc_id long, text string, lang string, source string, n_chars long").persist()

    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def score(text):
        s = slow_statistics(text or "")
        raw = model.intercept + sum(w for rule, w in model.rules if all((s[STATISTICS[i]] > t) == above for i, above, t in rule.terms))
        return 1 / (1 + math.exp(-raw))

    want = {i: t for i, t in rows.items() if score(t) >= 0.7}
    assert texts(stages["quality classifier"](spark, docs, SF)) == want and 0 < len(want) < len(rows)

    ids = sorted(want)
    groups = test_neardups.brute(ids, [want[i] for i in ids], 5)
    kept = {i: want[i] for i, (_, c) in zip(ids, groups, strict=True) if c == i}
    docs = frame(want)
    assert texts(stages["near-dedup"](spark, docs, SF)) == kept and len(kept) < len(want)

    ids = sorted(kept)
    cut = test_substrings.brute([kept[i] for i in ids], 35)
    left = {i: (text if removed else kept[i]) for i, (_, removed, text) in zip(ids, cut, strict=True)}
    docs = frame(kept)
    out = stages["substring dedup"](spark, docs, SF)
    assert texts(out) == left and any(removed for _, removed, _ in cut)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = [(n, tuple(w[i : i + 10])) for n, t in items for w in [test_contamination.words(t)] for i in range(max(1, len(w) - 9) if w else 0)]

    def contaminated(text):
        w = test_contamination.words(text)
        have = {k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for k in {len(v) for _, v in windows}}
        return any(v in have[len(v)] for _, v in windows)

    clean = {i: t for i, t in left.items() if not contaminated(t)}
    docs = frame(left)
    assert texts(stages["decontamination"](spark, docs, SF)) == clean

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    docs = frame(clean)
    for r in stages["byte-level BPE"](spark, docs, SF).collect():
        assert r.token_ids == enc.encode_ordinary(clean[r.doc_id] or "")


def test_stages_take_odd_columns(spark, stages):
    """Columns that operators add themselves, in other cases, with dots; they come through unchanged."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text + f" {i} " + "and some more words that differ" * (i % 3), "en", "s", 1, f"a{i}", f"b{i}", float(i), i) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `meta.src` string, Score string, kept double, N_Hit int")
    for name, stage in list(stages.items())[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all((r["meta.src"], r["Score"], r["kept"], r["N_Hit"]) == (f"a{r.doc_id}", f"b{r.doc_id}", float(r.doc_id), r.doc_id) for r in out.collect()), name


@pytest.mark.parametrize("k", [2, 5])
def test_recall_at_the_threshold(spark, k):
    """Pairs whose sets are just similar enough, and others that just aren't, among unlike texts: none is missed, none is wrong."""
    rng = random.Random(k)
    texts, want = [], []
    for n in range(150):
        size = rng.choice((20, 45, 90, 180))
        common = [f"c{n}w{i}" for i in range(size + k - 1)]
        # 2 a + size shingles in the union, if a words are added to either text at its end.
        a = next(a for a in range(1, size) if 100 * size < 80 * (size + 2 * a))
        near = n % 2 == 0
        a -= near
        if a == 0:
            continue
        texts += [" ".join(common + [f"x{n}e{i}" for i in range(a)]), " ".join(common + [f"y{n}e{i}" for i in range(a)])]
        want += [2 * (len(texts) // 2 - 1)] * 2 if near else [len(texts) - 2, len(texts) - 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, k).collect()}
    assert got == dict(enumerate(want)) and sum(a != b for a, b in enumerate(want)) > 50
