import zlib

import numpy as np
import pytest

from tessella.llm.queries import op1_hilbert_shards
from tessella.llm.sharding import curve_shards, hilbert_index, write_shards

from .conftest import SF


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 3), (2, 5), (3, 2), (3, 4), (4, 2), (1, 5)])
def test_curve_visits_every_cell_in_unit_steps(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(side**dims))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("shards", [1, 4, 7, 200])
def test_laws(docs, corpus, law, shards):
    rows = curve_shards(docs, ["source", "n_chars"], shards, law).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _, _ in corpus)
    texts = {i: (t or "").encode() for i, t, _ in corpus}
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(0 <= s < shards for s in by)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    if law == "rows":
        counts = [len(by.get(s, [])) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
    else:
        total, most = sum(r.size for r in rows), max(r.size for r in rows)
        assert all(abs(sum(r.size for r in by.get(s, [])) - total / shards) <= most for s in range(shards))
    ends = sorted((min(r.curve for r in part), max(r.curve for r in part), s) for s, part in by.items())
    assert [s for *_, s in ends] == sorted(by) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_query_by_plain_python(spark):
    """op1's rows from the raw table: quantile cells of whole values, a curve place a cell, and the order within."""
    import duckdb

    raw = duckdb.sql(f"SELECT doc_id, lang, source, n_chars, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    rows = {r.doc_id: r for r in op1_hilbert_shards(spark, SF).collect()}
    curve = {r.doc_id: r.curve for r in curve_shards(spark.read.parquet(f"{SF}/documents.parquet"), ["lang", "source", "n_chars"], 40, "rows").collect()}

    def cells(values):
        order = sorted(v for v in values if v is not None)
        order = [None] * (len(values) - len(order)) + order
        rank = {v: i for i, v in enumerate(dict.fromkeys(order))}
        cuts = sorted({rank[order[max(0, -(-i * len(order) // 64) - 1)]] for i in range(1, 64)})
        return [sum(c < rank[v] for c in cuts) for v in values]

    cell = dict(zip([r[0] for r in raw], zip(*(cells([r[i] for r in raw]) for i in (1, 2, 3)), strict=True), strict=True))
    of = {}
    for d, c in cell.items():
        assert of.setdefault(c, curve[d]) == curve[d]
    assert len(set(of.values())) == len(of) and [curve[d] for d in cell] == hilbert_index(np.array(list(cell.values())), 6).tolist()
    order = sorted(raw, key=lambda r: (curve[r[0]], zlib.crc32(r[4].encode()), r[0]))
    starts = {}
    for i, r in enumerate(order):
        shard = i * 40 // len(order)
        want = (len(r[4].encode()) + 16, zlib.crc32(r[4].encode()), "rows", shard, i - starts.setdefault(shard, i), None)
        assert tuple(rows[r[0]][c] for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")) == want


def test_whole_strings_prune(spark):
    """A dimension of strings with a long common start is cut as well as any other."""
    docs = spark.createDataFrame([(i, "x", f"https://example.org/dumps/2024-{i % 64:02d}", (i * 37) % 64 + 0.5) for i in range(1024)], "doc_id long, text string, url string, score double")
    rows = curve_shards(docs, ["url", "score"], 16, carry=True).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r.shard, []).append((r.row[2], r.row[3]))
    wide = [(len({u for u, _ in v}), len({s for _, s in v})) for v in spans.values()]
    assert len(wide) == 16 and all(a <= 24 and b <= 24 for a, b in wide)


def test_nulls_repeats_and_empty(spark, docs, empty):
    odd = spark.createDataFrame([(None, None, None, None)] * 3 + [(1, "a", "s", 1)] * 5, "doc_id long, text string, source string, n_chars long")
    rows = curve_shards(odd, ["source", "n_chars"], 4).collect()
    assert len(rows) == 8 and sorted(r.size for r in rows) == [16] * 3 + [17] * 5
    assert curve_shards(empty, ["source"], 4).count() == 0
    with pytest.raises(ValueError):
        curve_shards(docs, ["source"], 4, "other")


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_files_and_manifest(spark, docs, corpus, tmp_path, law):
    manifest = {r.shard: r for r in write_shards(docs, ["source", "n_chars"], str(tmp_path / "s"), 5, law).collect()}
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(back.columns) == sorted([*docs.columns, "_shard"])
    assert sorted((r.doc_id, r.text or "") for r in back.collect()) == sorted((i, t or "") for i, t, _ in corpus)
    for r in back.collect():
        m = manifest[r._shard]
        assert m.lo_source <= r.source <= m.hi_source and m.lo_n_chars <= r.n_chars <= m.hi_n_chars
    assert sum(m.rows for m in manifest.values()) == len(corpus)


def test_large_shards_are_several_files(spark, docs, corpus, tmp_path):
    write_shards(docs, ["n_chars"], str(tmp_path / "s"), 2, "rows", file_bytes=4000)
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "s").glob("_shard=*")]
    assert len(files) == 2 and max(files) > 1 and spark.read.parquet(str(tmp_path / "s")).count() == len(corpus)


def test_query(spark):
    out = op1_hilbert_shards(spark, SF)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 40 and max(counts) - min(counts) <= 1 and out.where("grown_shard is not null").count() == 0
