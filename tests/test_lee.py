import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import grids, inference, pairs, weights


@pytest.fixture(scope="module")
def chain(spark):
    """Four tiles in a row (and an empty one), three genes."""
    x = np.array([[1, 4, 2], [2, 1, 5], [4, 3, 1], [3, 2, 4]], float)
    counts = spark.createDataFrame([(f"s{i + 1}", f"g{j + 1}", float(x[i, j])) for i in range(4) for j in range(3)], "grid_id string, gene string, count double")
    info = spark.createDataFrame([(f"s{i}", i, 1, float(i - 1), float(i), 0.0, 1.0, i - 0.5, 0.5) for i in range(1, 6)], "grid_id string, gx int, gy int, xmin double, xmax double, ymin double, ymax double, center_x double, center_y double")
    return x, counts, info


def brute_l(x, w):
    s2 = (w.sum(axis=1) ** 2).sum()
    lag = w @ x
    norm = np.sqrt((x**2).sum(axis=0))
    return len(x) / s2 * (lag.T @ lag) / np.outer(norm, norm)


def test_normalisation_and_empty_tiles(chain):
    x, counts, info = chain
    z = grids.normalise(counts, info).toPandas().pivot(index="grid_id", columns="gene", values="z")
    share = x / x.sum(axis=1, keepdims=True)
    assert np.allclose(z.iloc[:4], (share - share.mean(axis=0)) / share.std(axis=0, ddof=1))
    assert (z.loc["s5"] == 0).all()
    kept = grids.normalise(counts, info, keep_zero=True).toPandas().pivot(index="grid_id", columns="gene", values="z")
    share = np.vstack([share, np.zeros(3)])
    assert np.allclose(kept, (share - share.mean(axis=0)) / share.std(axis=0, ddof=1))


def test_constant_genes_are_zero(spark):
    counts = spark.createDataFrame([(f"t{i}", g, 1.0) for i in range(3) for g in ("a", "b")], "grid_id string, gene string, count double")
    info = counts.select("grid_id").distinct()
    assert {r.z for r in grids.normalise(counts, info).collect()} == {0.0}


@pytest.mark.parametrize("dense", [False, True])
def test_against_matrices(spark, dense):
    rng = np.random.default_rng(20260728)
    x = rng.normal(size=(7, 5))
    x -= x.mean(axis=0)
    w = np.zeros((7, 7))
    for i, v in enumerate((1, 0.5, 1.5, 0.75, 1.25, 1)):
        w[i, i + 1] = w[i + 1, i] = v
    values = spark.createDataFrame([(f"t{i}", f"g{j}", float(x[i, j])) for i in range(7) for j in range(5)], "grid_id string, gene string, z double")
    edges = spark.createDataFrame([(f"t{i}", f"t{j}", float(w[i, j])) for i in range(7) for j in range(7) if w[i, j]], "i string, j string, w double")
    info = values.select("grid_id").distinct()
    want = brute_l(x, w)
    for r in pairs.lees_l(values, edges, info, dense=dense, diagonal=True).collect():
        assert r.L == pytest.approx(want[int(r.gene1[1]), int(r.gene2[1])], abs=1e-12)
    # permutations: counts don't depend on partitions, and agree with the definition
    seen = pairs.lees_l(values, edges, info)
    perms = inference.permutations(info, 9).persist()
    got = {(r.gene1, r.gene2): r.k for r in inference.permutation_test(values, edges, info, seen, perms, 9).collect()}
    again = {(r.gene1, r.gene2): r.k for r in inference.permutation_test(values.repartition(7), edges.repartition(2), info, seen, perms.repartition(3), 9).collect()}
    assert got == again
    k = np.zeros((5, 5), int)
    for b in range(1, 10):
        src = {r.grid_id: r.src for r in perms.where(f"b = {b}").collect()}
        moved = np.stack([x[int(src[f"t{i}"][1])] for i in range(7)])
        k += np.abs(brute_l(moved, w)) >= np.abs(want) - 1e-12
    assert got == {(f"g{i}", f"g{j}"): k[i, j] for i in range(5) for j in range(i + 1, 5)}


@pytest.mark.parametrize("block", [None, "block"])
def test_dense_permutations_are_those_of_the_joins(spark, block):
    """By blocks of genes, by joins, with any partitioning, and beyond the limit: the same counts."""
    rng = np.random.default_rng(4)
    info = spark.createDataFrame([(f"g{x}_{y}", x, y) for x in range(1, 7) for y in range(1, 6)], "grid_id string, gx int, gy int")
    tiles = grids.block_ids(info, 3).persist()
    rows = [(r.grid_id, f"g{j}", float(rng.normal())) for r in info.collect() for j in range(7)]
    z = spark.createDataFrame(rows, "grid_id string, gene string, z double").persist()
    e = weights.weights(info).persist()
    seen = pairs.lees_l(z, e, info).join(pairs.pearson(z, "grid_id", "z"), ["gene1", "gene2"]).persist()
    perms = inference.permutations(tiles, 11, block).persist()
    for reference in (None, "r"):
        want = {(r.gene1, r.gene2): r.k for r in inference.permutation_test(z, e, tiles, seen, perms, 11, reference).collect()}
        dense = lambda *a, **kw: {(r.gene1, r.gene2): r.k for r in inference.permutation_test_dense(*a, 11, block, reference, **kw).collect()}
        assert dense(z, e, tiles, seen, genes_a_block=3) == want
        assert dense(z.repartition(5), e.repartition(1), tiles, seen.repartition(2)) == want
        assert dense(z, e, tiles, seen, limit=3) == want
    assert dense(z, e, tiles, seen, recompute=True) == want
    with pytest.raises(ValueError):
        inference.permutation_test_dense(z, e, tiles, seen, 11, recompute=True)


@pytest.mark.parametrize("genes", [3, 2])
def test_dense_products_in_blocks_of_genes(spark, monkeypatch, genes):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9, 7))
    values = spark.createDataFrame([(f"t{i}", f"g{j}", float(x[i, j])) for i in range(9) for j in range(7)], "grid_id string, gene string, z double")
    monkeypatch.setattr(pairs, "GENES", genes)
    got = {(r.gene1, r.gene2): r.s for r in pairs.pair_sums_dense(values, "grid_id", "z", 4).collect()}
    want = x.T @ x
    assert len(got) == 28 and all(abs(s - want[int(a[1]), int(b[1])]) < 1e-12 for (a, b), s in got.items())
    with pytest.raises(MemoryError):
        pairs.require_size(values.select("gene").distinct(), 1e-9)


def test_kendall(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (12, 3))
    values = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(12) for j in range(3) if x[i, j]], "u int, gene string, value double")
    for r in pairs.kendall(values, "u").collect():
        a, b = x[:, int(r.gene1[1])], x[:, int(r.gene2[1])]
        s = [np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(12) for j in range(i)]
        n = [sum(v[i] != v[j] for i in range(12) for j in range(i)) for v in (a, b)]
        assert r.r == pytest.approx(sum(s) / np.sqrt(n[0] * n[1]))


def test_blocks_are_kept(spark):
    info = spark.createDataFrame([(f"g{x}_{y}", x, y) for x in range(1, 7) for y in range(1, 6)], "grid_id string, gx int, gy int")
    blocks = grids.block_ids(info, 2)
    row = inference.check_permutations(inference.permutations(blocks, 4, "block"), blocks, "block").first()
    assert (row.permutations, row.not_bijective, row.across_blocks) == (4, 0, 0)
    assert sorted({r.block for r in blocks.collect()}) == list(range(1, 10))


def test_zero_gene_has_zero_l(spark):
    v = spark.createDataFrame([(f"t{i}", g, float(z)) for i in range(4) for g, z in (("a", i - 1.5), ("b", 0.0))], "grid_id string, gene string, z double")
    e = spark.createDataFrame([(f"t{i}", f"t{i + 1}", 1.0) for i in range(3)] + [(f"t{i + 1}", f"t{i}", 1.0) for i in range(3)], "i string, j string, w double")
    seen = pairs.lees_l(v, e, v.select("grid_id").distinct())
    assert seen.first().L == 0
    perms = inference.permutations(v.select("grid_id").distinct(), 2)
    assert inference.permutation_test(v, e, v.select("grid_id").distinct(), seen, perms, 2).first().k == 2


def test_correlations(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.poisson(0.7, (40, 6)).astype(float), 1)
    x[:, 5] = 2.0
    rows = [(i, f"g{j}", x[i, j]) for i in range(40) for j in range(6) if x[i, j]]
    v = spark.createDataFrame([(i, g, float(a)) for i, g, a in rows], "cell int, gene string, value double")
    n = spark.createDataFrame([(40.0,)], "n double")
    for dense in (False, True):
        for r in pairs.pearson(v, "cell", n=n, dense=dense).collect():
            i, j = int(r.gene1[1]), int(r.gene2[1])
            assert r.r == pytest.approx(0.0 if 5 in (i, j) else np.corrcoef(x[:, i], x[:, j])[0, 1], abs=1e-12)
    signed = x[:, :5] * np.where(np.arange(40) % 3 == 0, -1, 1)[:, None]
    sparse = spark.createDataFrame([(i, f"g{j}", float(signed[i, j])) for i in range(40) for j in range(5) if signed[i, j]], "cell int, gene string, value double")
    want = pd.DataFrame(signed).rank().corr().to_numpy()
    for r in pairs.spearman(sparse, "cell", n=n).collect():
        assert r.r == pytest.approx(want[int(r.gene1[1]), int(r.gene2[1])], abs=1e-9)
    full = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(40) for j in range(5)], "cell int, gene string, value double")
    want = pd.DataFrame(x[:, :5]).rank().corr().to_numpy()
    for r in pairs.spearman(full, "cell").collect():
        assert r.r == pytest.approx(want[int(r.gene1[1]), int(r.gene2[1])], abs=1e-9)


def test_idelta_and_overlap(spark):
    c = spark.createDataFrame([("t1", "a", 3), ("t2", "a", 1), ("t1", "b", 1), ("t2", "c", 2), ("t1", "c", 2)], "grid_id string, gene string, count int")
    got = {r.gene: r.idelta for r in pairs.idelta(c, spark.createDataFrame([(2.0,)], "q double")).collect()}
    assert got == {"a": 2 * 6 / 12, "b": None, "c": 2 * 4 / 12}
    v = c.select("grid_id", "gene", F.col("count").cast("double").alias("value"))
    p = spark.createDataFrame([("a", "c"), ("b", "c")], "gene1 string, gene2 string")
    got = {r.gene1: r.mh for r in pairs.morisita_horn(v, p, chao=False).collect()}
    assert got["a"] == pytest.approx(2 * 8 / ((10 / 16 + 8 / 16) * 16)) and got["b"] == pytest.approx(2 * 2 / ((1 + 0.5) * 4))
