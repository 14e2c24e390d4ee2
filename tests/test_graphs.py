import numpy as np
import pytest

from tessella.operators import graphs


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "gene1 string, gene2 string, weight double")


RUNS = {"A": "1111", "B": "1221", "C": "2213", "D": "2223", "E": "1111"}


def runs(spark):
    return spark.createDataFrame([(g, i, int(v)) for g, s in RUNS.items() for i, v in enumerate(s)], "gene string, run int, label int")


def test_consensus_and_views(spark):
    got = {(r.gene1, r.gene2): r.weight for r in graphs.consensus(runs(spark), 0.5).collect()}
    want = {}
    for a in RUNS:
        for b in RUNS:
            if a < b:
                f = np.mean([x == y for x, y in zip(RUNS[a], RUNS[b], strict=True)])
                if f >= 0.5:
                    want[a, b] = f
    assert got == want
    view = {(r.gene1, r.gene2): (r.frequency, r.is_consensus_edge) for r in graphs.graph_views(edges(spark, [("A", "E", 0.8), ("A", "C", 0.5), ("C", "D", 0.6)]), runs(spark), 0.75).collect()}
    assert view == {("A", "E"): (1.0, True), ("A", "C"): (0.25, False), ("C", "D"): (0.75, True)}


def two_cliques(spark, n=6):
    rows = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "ab" for i in range(n) for j in range(i + 1, n)]
    return edges(spark, [*rows, ("a0", "b0", 0.1)])


@pytest.mark.parametrize(("objective", "resolution"), [("modularity", 1.0), ("CPM", 0.3)])
def test_communities(spark, objective, resolution):
    for run in graphs.restarts(two_cliques(spark), 3, resolution, objective).toPandas().groupby("run"):
        label = dict(zip(run[1]["gene"], run[1]["label"], strict=True))
        assert len(set(label.values())) == 2 and len({label[f"a{i}"] for i in range(6)}) == 1
    modules = graphs.modules_of(two_cliques(spark), 4)
    assert modules.select("module").distinct().count() == 2
    assert graphs.modularity(two_cliques(spark), modules).first().modularity > 0.45


def test_hierarchical(spark):
    label = {r.gene: r.module for r in graphs.hierarchical(two_cliques(spark), 2).collect()}
    assert len(set(label.values())) == 2 and label["a1"] == label["a5"] != label["b5"]
    merged = graphs.hierarchical(two_cliques(spark), 4, least=3)
    assert merged.groupBy("module").count().where("count < 3").count() == 0


def test_trees(spark):
    e = edges(spark, [("A", "B", 3), ("B", "C", 2), ("A", "C", 1), ("D", "E", 5)])
    assert {(r.gene1, r.gene2) for r in graphs.spanning_forest(e).collect()} == {("A", "B"), ("B", "C"), ("D", "E")}
    modules = spark.createDataFrame([("A", 1), ("B", 2), ("C", 1), ("D", 2), ("E", 2)], "gene string, module int")
    assert {(r.gene1, r.gene2) for r in graphs.spanning_forest(e, modules).collect()} == {("A", "C"), ("D", "E")}
    kept = e.where("weight > 2.5")
    back = {(r.gene1, r.gene2): (r.weight, r.restored) for r in graphs.restored_backbone(e, kept, modules, 0.0).collect()}
    assert back == {("A", "B"): (3.0, False), ("D", "E"): (5.0, False), ("A", "C"): (1.0, True)}
    d = {(r.gene1, r.gene2): r.distance for r in graphs.tree_distances(graphs.spanning_forest(e)).collect()}
    assert d["A", "C"] == pytest.approx(1 / 3 + 1 / 2) and ("A", "D") not in d
    order = [r.gene for r in graphs.leaf_order(graphs.tree_distances(graphs.spanning_forest(e))).orderBy("position").collect()]
    assert sorted(order) == ["A", "B", "C", "D", "E"] and abs(order.index("D") - order.index("E")) == 1
    assert {r.gene for r in graphs.articulation(graphs.spanning_forest(e)).collect()} == {"B"}
    assert {r.runs for r in graphs.tree_union(graphs.stochastic_trees(e, 4, 0.0)).collect()} == {4}


def test_paths_components_ranks(spark):
    e = edges(spark, [("A", "B", 1), ("B", "C", 1), ("C", "A", 1), ("D", "E", 1)])
    assert sorted(r.path for r in graphs.simple_paths(e, "A", 3).collect()) == ["A>B", "A>B>C", "A>C", "A>C>B"]
    assert [r.path for r in graphs.simple_paths(e, "A", 3, target="C").collect()] == ["A>C", "A>B>C"]
    assert [r.path for r in graphs.simple_paths(e, "A", 3, target="C", shortest=True).collect()] == ["A>C"]
    assert graphs.simple_paths(e, "A", 3, target="D").count() == 0
    assert {r.gene: r.component for r in graphs.gene_components(e).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D"}
    start = spark.createDataFrame([("A", 1.0), ("B", 0.0), ("C", 0.0), ("D", 0.0), ("E", 0.0)], "gene string, score double")
    ranks = {r.gene: r.rank for r in graphs.page_ranks(e, start).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["A"] > ranks["B"] == pytest.approx(ranks["C"])


def test_pruning_and_metrics(spark):
    e = edges(spark, [("A", "B", 2), ("A", "C", 1), ("C", "D", 0)])
    modules = spark.createDataFrame([("A", 5), ("B", 5), ("C", 9), ("D", 9)], "gene string, module int")
    assert {r.gene: r.module for r in graphs.pruned(modules, e).collect()} == {"A": 1, "B": 1}
    m = {r.module: r for r in graphs.cluster_metrics(modules, graphs.consensus(runs(spark), 0.0), e).collect()}
    assert m[5].within_cons == 0.5 and m[5].conductance == pytest.approx(1 / 3) and m[9].conductance == pytest.approx(1.0)
    assert graphs.extra_edges(e, e.where("gene1 = 'C'"), 1).first().gene2 == "B"
