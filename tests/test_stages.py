"""Community detection, the second clustering stage, and the verbs of a scope."""

import itertools
import logging

import numpy as np
import pytest

from tessella.operators import graphs
from tessella.scope import Scope
from tessella.sources.tables import cell_counts, molecules

SF = "/root/testdata/sf0.001"


def blocks(sizes, inside, outside, seed):
    rng = np.random.default_rng(seed)
    label = np.repeat(np.arange(len(sizes)), sizes)
    n = len(label)
    w = np.where(label[:, None] == label, rng.random((n, n)) < inside, rng.random((n, n)) < outside) * rng.uniform(0.5, 1.5, (n, n))
    w = np.triu(w, 1)
    return w + w.T, label


def modularity(w, label):
    t = w.sum()
    return sum(w[np.ix_(label == c, label == c)].sum() / t - (w[label == c].sum() / t) ** 2 for c in set(label.tolist()))


@pytest.mark.parametrize("algorithm", ["leiden", "louvain"])
def test_planted_communities_are_found(algorithm):
    w, label = blocks([12, 15, 9, 14], 0.7, 0.03, 1)
    found = graphs.communities_of(w, 3, algorithm=algorithm)
    assert len(set(zip(found.tolist(), label.tolist()))) == 4
    assert found.tolist() == graphs.communities_of(w, 3, algorithm=algorithm).tolist()
    assert len(set(graphs.communities_of(w, 3, 0.2, "CPM", algorithm).tolist())) >= 4


def test_leiden_communities_are_connected_and_no_worse():
    for seed in range(8):
        w, _ = blocks([6, 7, 5, 9, 8], 0.4, 0.08, seed)
        leiden, louvain = (graphs.communities_of(w, 1, algorithm=a) for a in ("leiden", "louvain"))
        assert len(set(graphs.connected_parts(w, leiden).tolist())) == len(set(leiden.tolist()))
        assert modularity(w, leiden) >= modularity(w, louvain) - 0.03
        single = graphs.moved(w, w.sum(axis=1), leiden - 1, w.sum(), 1.0, np.random.default_rng(0))
        assert len(set(zip(single.tolist(), leiden.tolist()))) == len(set(leiden.tolist()))  # no single move gains


def test_cut_nodes_by_removal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 14))
        w = np.triu(rng.random((n, n)) < 0.18, 1).astype(float)
        w += w.T
        base = graphs.connected_parts(w, np.zeros(n)).max() + 1
        want = {}
        for i in range(n):
            keep = np.arange(n) != i
            more = graphs.connected_parts(w[np.ix_(keep, keep)], np.zeros(n - 1)).max(initial=-1) + 1 - base
            if more > 0:
                want[i] = more
        assert graphs.cut_nodes(w) == want


def test_accepting_parts():
    good = np.array([6, 7]), np.array([0.9, 0.8])
    assert graphs.accepted(*good, 0.5) and not graphs.accepted(*good, 0.8)  # no gain
    assert not graphs.accepted(np.array([6, 4]), np.array([1.0, 1.0]), 0.1)  # a small part
    assert not graphs.accepted(np.array([20]), np.array([1.0]), 0.1) and not graphs.accepted(np.full(4, 9), np.ones(4), 0.1)  # too few, too many


def frame(spark, w, names, least=0.0):
    return spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i, j in itertools.combinations(range(len(names)), 2) if w[i, j] > least], "gene1 string, gene2 string, L double")


def test_second_stage(spark):
    """Two planted modules that the first stage joined are parted again; pairs inside the band and isolated genes go."""
    w, label = blocks([12, 12, 10], 0.9, 0.02, 5)
    names = [f"g{i:02d}" for i in range(34)]
    raw = frame(spark, w, names).persist()
    first = spark.createDataFrame([(g, 1 if k < 2 else 2) for g, k in zip(names, label.tolist())], "gene string, module int")
    kept = raw.where("gene1 <> 'g00' and gene2 <> 'g00'")
    found, graph = graphs.second_stage(raw, raw, first, None, kept, 5, 0.5, drop_unstable=False)
    got = {r.gene: r.module for r in found.collect()}
    planted = dict(zip(names, label.tolist()))
    of = {}
    for g, m in got.items():
        if g != "g00":
            of.setdefault(m, set()).add(planted[g])
    assert all(len(v) == 1 for v in of.values()) and {c for v in of.values() for c in v} == {0, 1, 2}
    edges = {(r.gene1, r.gene2) for r in graph.collect()}
    assert 1 <= sum("g00" in e for e in edges) <= 4  # what the module's spanning tree needs


def test_loose_modules_are_parted(spark):
    w, label = blocks([8, 8, 10], 1.0, 0.0, 6)
    w[0, 8] = w[8, 0] = 0.4
    names = [f"g{i:02d}" for i in range(26)]
    edges = graphs.log_weights(frame(spark, w, names)).persist()
    modules = spark.createDataFrame([(g, 1 if k < 2 else 2) for g, k in zip(names, label.tolist())], "gene string, module int")
    metrics = spark.createDataFrame([(1, 16, 0.4, 0.7), (2, 10, 0.4, 0.5)], "module int, size long, within_cons double, conductance double")
    parts = {r.gene: (r.module, r.part) for r in graphs.sub_modules(edges, modules, metrics).collect()}
    assert len({parts[g] for g in names[:16]}) == 2 and {parts[g] for g in names[16:]} == {(2, 1)}
    none = graphs.sub_modules(edges, modules, metrics, child=9).collect()
    assert {r.part for r in none} == {1}


@pytest.fixture(scope="module")
def scope(spark):
    s = Scope.create(molecules(spark, SF), [200.0], cells=cell_counts(spark, SF))
    return s.normalise("grid200").compute_weights("grid200").compute_l("grid200", perms=9).compute_correlation("grid200")


def test_curve_and_ranking(scope, caplog):
    with caplog.at_level(logging.INFO, "tessella"):
        s = scope.compute_curve("grid200", points=21, b=20, n_strata=5, min_rel_width=0.1, jitter=0.5)
    assert any("compute_curve bootstrap done" in m for m in caplog.messages)
    assert s.curves["curve"].count() == 21 and s.made["curve"]["b"] == 20 and len(s.made["curve"]["settings_sha256"]) == 64
    few = s.compute_curve("grid200", name="few", points=11, b=5, n_strata=3, downsample=150)
    assert few.curves["few"].count() == 11
    outside = s.top_l_vs_r("grid200", n=300, curve="curve")
    everything = s.top_l_vs_r("grid200", n=300)
    assert 0 <= outside.count() < everything.count() == 300
    tested = s.top_l_vs_r("grid200", n=5, direction="both", perms=9, block_side=2, p_mode="mid", r_range=(-0.5, 0.5)).collect()
    assert len(tested) >= 10 and all(0 < r.p <= 1 and r.p <= r.delta_fdr <= 1 and -0.5 <= r.r <= 0.5 for r in tested)


def test_stale_statistics_are_refused(scope):
    changed = scope.compute_weights("grid200", "W")
    with pytest.raises(ValueError, match="stale"):
        changed.top_l_vs_r("grid200")
    with pytest.raises(ValueError, match="stale"):
        changed.compute_curve("grid200", points=5, b=2)
    scope.top_l_vs_r("grid200", n=1).count()
    again = scope.normalise("grid200", keep_zero=True)
    assert again.source("grid200", "Xz")["formula"] == scope.made["L_Xz"]["formula"]


def test_other_verbs(spark, scope):
    s = scope.add_single_cells(cell_counts(spark, SF))
    with pytest.raises(ValueError):
        scope.add_single_cells(spark.createDataFrame([("nobody", "g", 1)], "cell string, gene string, count int"))
    s = s.add_histology("grid200", "hires", 640, 480, (0.0, 1100.0, 0.0, 1000.0), 0.5)
    assert s.grids["grid200"].histology["hires"]["width"] == 640
    with pytest.raises(ValueError):
        s.add_histology("grid200", "bad", 0, 1, (0, 1, 0, 1), 1.0)
    s = s.compute_mh("grid200").compute_idelta("grid200").gene_jaccard("grid200").cluster_genes(restarts=3, threshold=0.5, second_stage=True, drop_unstable=False)
    assert 0 < s.stats["modules"].count() <= 25
    s = s.with_stats(jaccard=s.stats["L_Xz"].selectExpr("gene1", "gene2", "L as jaccard"))
    for alternative in ("two.sided", "greater", "less"):
        assert 0 <= s.module_test(alternative=alternative).first().p <= 1
        assert 0 < s.module_test(method="flips", alternative=alternative, n_perm=20).first().p <= 1
    gene = s.stats["graph"].first().gene1
    assert s.dendro_paths(gene, cutoff=3, most=50).count() >= 1
    rows = spark.createDataFrame([("a", "xenium"), ("__scope_platform__", "cosmx")], "gene string, platform string")
    assert s.migrate_metadata(rows).metadata["platform"] == "Xenium"
    with pytest.raises(MemoryError):
        s.compute_l("grid200", mem_limit_gb=1e-9)
