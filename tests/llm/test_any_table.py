"""All operators on tables with columns of odd names, and with very long texts."""

import random

import public_tokenizers
import pytest

from tessella.llm.bpe import byte_bpe, read_ranks
from tessella.llm.chats import rotate
from tessella.llm.contamination import contamination
from tessella.llm.fingerprints import fingerprints
from tessella.llm.licenses import scan_licenses
from tessella.llm.neardups import drop_near_duplicates, near_duplicates
from tessella.llm.quality import quality_scores, train
from tessella.llm.sharding import curve_shards, write_shards
from tessella.llm.substrings import substring_dedup
from tessella.llm.urls import filter_urls

#: Names with dots, quotes and blanks; such as operators add themselves, in another case; such as they might use inside.
ODD = ["meta.src", "a`b", "two words", "Host", "N_Tokens", "ITEMS", "Score", "Kept", "__whole", "__c0", "__c1", "row", "rank", "t1", "node", "segment", "v"]
RANKS = {bytes([b]): b for b in range(256)}


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(11)
    words = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    return " ".join(words * 4)  # more than 5 MB


@pytest.fixture(scope="module")
def odd(spark, corpus, long_text):
    rows = [(f"o{i}", *[f"{n}{i}" for n in ODD], i, t) for i, t, _ in corpus if i % 2] + [(None,) * (len(ODD) + 3), ("x", *ODD, 10**6, long_text), ("y", *ODD, 10**6 + 1, long_text + " end")]
    return spark.createDataFrame(rows, ["other.id", *ODD, "doc_id", "text"]).repartition(3)


def operators(spark, docs):
    bench = spark.createDataFrame([("b1", "w1 w2 w3", 1), (None, None, 2)], ["item_id", "text", "meta.src"])
    labels = docs.select("doc_id", docs["`meta.src`"].alias("meta.src")).selectExpr("doc_id", "cast(pmod(doc_id, 2) as int) quality", "`meta.src` as `a.b`")
    turns = docs.withColumnsRenamed({"doc_id": "conv_id"}).selectExpr("*", "1 as turn", "'ann' as role")
    return {
        "op1": lambda: curve_shards(docs, ["meta.src", "two words"], 3, carry=True),
        "op2": lambda: substring_dedup(docs, 35),
        "op3": lambda: byte_bpe(docs, RANKS, public_tokenizers.PATTERN),
        "op4": lambda: quality_scores(docs, train(docs, labels)),
        "op5": lambda: fingerprints(docs),
        "op6": lambda: near_duplicates(docs, 2),
        "op6 rows": lambda: drop_near_duplicates(docs, 2),
        "op7": lambda: contamination(docs, bench, 10),
        "op8": lambda: rotate(turns),
        "op9": lambda: filter_urls(docs, url="text"),
        "op10": lambda: scan_licenses(docs),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op6 rows", "op7", "op8", "op9", "op10"])
def test_odd_columns_and_long_texts(spark, odd, name):
    before = dict(spark.conf.getAll)
    out = operators(spark, odd)[name]()
    rows = out.collect()
    lower = [c.lower() for c in out.columns]
    assert len(set(lower)) == len(lower) and dict(spark.conf.getAll) == before
    n = odd.count()
    assert len(rows) == n or name in ("op6 rows", "op8") and 0 < len(rows) <= n
    if name in ("op2", "op3", "op4", "op6 rows", "op7", "op9"):
        meta = out.columns.index("meta.src")
        assert {r[meta] for r in rows} <= {r[1] for r in odd.collect()} and len({r[meta] for r in rows}) > 5
    if name == "op6":
        assert {r.component_id for r in rows if r.doc_id is not None and r.doc_id >= 10**6} == {10**6}
    if name == "op2":
        assert all(r.n_words >= 800_000 and r.n_words - r.n_removed <= 1 for r in rows if r.doc_id is not None and r.doc_id >= 10**6)


def test_written_shards_keep_odd_columns(spark, odd, tmp_path):
    write_shards(odd, ["meta.src"], str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(back.columns) == sorted([*odd.columns, "_shard"]) and back.count() == odd.count()


def test_no_operator_works_without_a_shared_folder(monkeypatch):
    from tessella.llm.common import shared_folder

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)
    Session.sparkContext.master = "local[2]"
    assert shared_folder(Session) == "/tmp/checkpoints"


def test_vocabulary_of_the_query_is_read(spark):
    assert len(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))) == 50256
