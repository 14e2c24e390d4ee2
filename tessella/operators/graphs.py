"""Graphs of genes: thresholds, consensus, communities, trees, paths, ranks.

A gene graph has a panel's genes as nodes, so single graphs fit a task; what is many (restarts, clusters, bootstrap runs) is dealt out.
Relational steps are joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .ranking import finite


def threshold_graph(pairs: DataFrame, min_cutoff: float = 0.0, fdr_max: float | None = None, fdr: str = "fdr") -> DataFrame:
    """Edges (gene1, gene2, L) of positive values above the cutoff, with a small FDR where asked for."""
    out = pairs.where((F.col("L") > 0) & (F.abs("L") >= min_cutoff))
    return out if fdr_max is None else out.where(finite(F.col(fdr)) & (F.col(fdr) <= fdr_max))


def log_weights(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.log1p("L"))


def smoothed_weights(edges: DataFrame, low: float = 0.05, high: float = 0.95, power: float = 0.5) -> DataFrame:
    """weight = log1p(L), clipped to two of its quantiles and brought to 0..1, to a power."""
    w = log_weights(edges)
    cut = w.agg(F.percentile("weight", F.array(F.lit(low), F.lit(high))).alias("q"))
    clipped = F.least(F.greatest("weight", F.col("q")[0]), F.col("q")[1])
    unit = F.coalesce(F.try_divide(clipped - F.col("q")[0], F.col("q")[1] - F.col("q")[0]), F.lit(0.0))
    return w.crossJoin(F.broadcast(cut)).withColumn("weight", F.pow(unit, F.lit(power))).drop("q")


def weighted_by_similarity(edges: DataFrame, similarity: DataFrame) -> DataFrame:
    """L times the pair's similarity mh, the median of all where there is none."""
    mid = similarity.agg(F.percentile("mh", F.lit(0.5)).alias("mid"))
    met = edges.join(similarity.select("gene1", "gene2", "mh"), ["gene1", "gene2"], "left").crossJoin(F.broadcast(mid))
    return met.withColumn("L", F.col("L") * F.coalesce("mh", "mid")).drop("mh", "mid")


def consensus(runs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(gene1, gene2, count, weight): how many runs give both genes one label, where that is at least the threshold's share."""
    n = runs.agg(F.count_distinct("run").alias("n"))
    a, b = runs.withColumnRenamed("gene", "gene1"), runs.withColumnRenamed("gene", "gene2")
    met = a.join(b, ["run", "label"]).where("gene1 < gene2").groupBy("gene1", "gene2").agg(F.count("*").alias("count"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("n") - 1e-12))
    return met.crossJoin(F.broadcast(n)).where(F.col("count") >= need).select("gene1", "gene2", "count", (F.col("count") / F.col("n")).alias("weight"))


def edge_frequency(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """edges with frequency, the share of runs that give both ends one label."""
    a = runs.select(F.col("gene").alias("gene1"), "run", F.col("label").alias("l1"))
    b = runs.select(F.col("gene").alias("gene2"), "run", F.col("label").alias("l2"))
    f = edges.select("gene1", "gene2").join(a, "gene1").join(b, ["gene2", "run"]).groupBy("gene1", "gene2").agg(F.avg((F.col("l1") == F.col("l2")).cast("double")).alias("frequency"))
    return edges.join(f, ["gene1", "gene2"], "left")


def graph_views(edges: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """The backbone's edges with their consensus frequency and whether they are in the consensus, the edges of the paper graph."""
    return edge_frequency(edges, runs).withColumn("is_consensus_edge", F.coalesce(F.col("frequency") >= threshold - 1e-12, F.lit(False)))


def directed(edges: DataFrame, value: str = "weight") -> DataFrame:
    return edges.select(F.col("gene1").alias("a"), F.col("gene2").alias("b"), F.col(value).alias("w")).union(edges.select("gene2", "gene1", value))


def degrees(edges: DataFrame) -> DataFrame:
    return directed(edges.withColumn("__one", F.lit(1.0)), "__one").groupBy(F.col("a").alias("gene")).agg(F.count("*").alias("degree"))


def gene_components(edges: DataFrame) -> DataFrame:
    """(gene, component), the least gene that can be reached; each round takes the least of the neighbours, then of their own, until
    nothing changes."""
    both = directed(edges.withColumn("__one", F.lit(1)), "__one").select("a", "b").distinct()
    both = stored(both)
    now = both.groupBy(F.col("a").alias("gene")).agg(F.min("b").alias("m")).select("gene", F.least("gene", "m").alias("component"))
    while True:
        near = both.join(now.select(F.col("gene").alias("b"), "component"), "b").groupBy(F.col("a").alias("gene")).agg(F.min("component").alias("m"))
        step = now.join(near, "gene").select("gene", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        up = step.select(F.col("gene").alias("c"), F.col("c").alias("cc"))
        step = step.join(up, "c").select("gene", "was", F.least("c", "cc").alias("component"))
        step = stored(step)
        done = not step.where("component <> was").limit(1).count()
        now = step.select("gene", "component")
        if done:
            return now


def cluster_metrics(modules: DataFrame, agreement: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, size, within_cons, conductance): mean agreement over all pairs inside, and cut / (cut + weight inside)."""
    size = modules.groupBy("module").agg(F.count("*").alias("size"))
    tag = lambda k: F.broadcast(modules.select(F.col("gene").alias(f"gene{k}"), F.col("module").alias(f"m{k}")))
    inside = agreement.join(tag(1), "gene1").join(tag(2), "gene2").where("m1 = m2").groupBy(F.col("m1").alias("module")).agg(F.sum("weight").alias("s"))
    met = edges.join(tag(1), "gene1").join(tag(2), "gene2")
    part = met.select(F.explode(F.array_distinct(F.array("m1", "m2"))).alias("module"), (F.col("m1") == F.col("m2")).alias("own"), "weight").groupBy("module").agg(F.sum(F.when(F.col("own"), F.col("weight")).otherwise(0.0)).alias("win"), F.sum(F.when(F.col("own"), 0.0).otherwise(F.col("weight"))).alias("cut"))
    n = F.col("size") * (F.col("size") - 1) / 2
    out = size.join(inside, "module", "left").join(part, "module", "left").na.fill(0.0, ["s", "win", "cut"])
    return out.select("module", "size", F.coalesce(F.try_divide("s", n), F.lit(0.0)).alias("within_cons"), (F.col("cut") / (F.col("cut") + F.col("win") + 1e-12)).alias("conductance"))


def gene_metrics(modules: DataFrame, agreement: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene, module, p_in, p_best_out, w_in): mean agreement with the own module, the best mean with another, weight inside."""
    size = modules.groupBy("module").agg(F.count("*").alias("n"))
    mine, theirs = modules.withColumnRenamed("gene", "a"), modules.select(F.col("gene").alias("b"), F.col("module").alias("other"))
    met = directed(agreement).join(F.broadcast(theirs), "b").groupBy("a", "other").agg(F.sum("w").alias("s")).join(F.broadcast(mine), "a").join(F.broadcast(size.withColumnRenamed("module", "other")), "other")
    own = F.col("other") == F.col("module")
    mean = F.coalesce(F.try_divide("s", F.when(own, F.col("n") - 1).otherwise(F.col("n"))), F.lit(0.0))
    p = met.groupBy("a").agg(F.max(F.when(own, mean)).alias("p_in"), F.max(F.when(~own, mean)).alias("p_best_out"))
    w = directed(edges).join(F.broadcast(theirs), "b").join(F.broadcast(mine), "a").where(own).groupBy("a").agg(F.sum("w").alias("w_in"))
    return mine.join(p, "a", "left").join(w, "a", "left").select(F.col("a").alias("gene"), "module", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p_in", "p_best_out", "w_in")])


def unstable_genes(metrics: DataFrame, p_in: float = 0.25, p_out: float = 0.6, q: float = 0.05) -> DataFrame:
    cut = metrics.agg(F.percentile("w_in", F.lit(q)).alias("cut"))
    return metrics.crossJoin(F.broadcast(cut)).where((F.col("p_in") < p_in) & (F.col("p_best_out") > p_out) & (F.col("w_in") <= F.col("cut"))).select("gene")


def pruned(modules: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Modules of genes that have a positive edge within, of `least` genes or more, numbered from 1."""
    met = directed(edges.where("weight > 0")).join(F.broadcast(modules.withColumnRenamed("gene", "a")), "a").join(F.broadcast(modules.select(F.col("gene").alias("b"), F.col("module").alias("other"))), "b").where("module = other")
    kept = modules.join(met.select(F.col("a").alias("gene")).distinct(), "gene", "left_semi")
    sized = kept.withColumn("n", F.count("*").over(Window.partitionBy("module"))).where(F.col("n") >= least)
    numbers = sized.select("module").distinct().withColumn("number", F.dense_rank().over(Window.orderBy("module")))
    return sized.join(F.broadcast(numbers), "module").select("gene", F.col("number").alias("module"))


def between_modules(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(m1, m2, weight): the greatest edge between each two modules."""
    tag = lambda k: F.broadcast(modules.select(F.col("gene").alias(f"gene{k}"), F.col("module").alias(f"x{k}")))
    met = edges.join(tag(1), "gene1").join(tag(2), "gene2").where("x1 <> x2")
    return met.groupBy(F.least("x1", "x2").alias("m1"), F.greatest("x1", "x2").alias("m2")).agg(F.max("weight").alias("weight"))


def tree_union(trees: DataFrame) -> DataFrame:
    """(gene1, gene2, weight, runs): mean weight and number of runs of each edge of several trees."""
    return trees.groupBy("gene1", "gene2").agg(F.avg("weight").alias("weight"), F.count("*").alias("runs"))


def simple_paths(edges: DataFrame, gene: str, cutoff: int = 8, most: int = 50_000, target: str | None = None, shortest: bool = False) -> DataFrame:
    """(path, length): simple paths from the gene of up to `cutoff` edges, grown from the frontier by joins; with a target those that end
    there, with shortest only the shortest of them. most is a stated limit of the report: shorter paths first, then by name."""
    both = directed(edges.withColumn("__one", F.lit(1)), "__one").select("a", "b").distinct()
    front = both.where(F.col("a") == gene).select(F.array("a", "b").alias("path"))
    out = front
    for _ in range(cutoff - 1):
        end = F.element_at("path", -1)
        open_ = front if target is None else front.where(end != target)
        front = open_.withColumn("a", end).join(both, "a").where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
        out = out.union(front)
        if target is not None and shortest:
            out = stored(out)
            if out.where(F.element_at("path", -1) == target).limit(1).count():
                break
    if target is not None:
        out = out.where(F.element_at("path", -1) == target)
    out = out.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("length")).distinct()
    if shortest:
        out = out.crossJoin(F.broadcast(out.agg(F.min("length").alias("least")))).where("length = least").drop("least")
    return out.orderBy("length", "path").limit(most)


def in_one_task(rows: DataFrame, by: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn on each group of a gene graph's rows; without a key the whole graph, whose size is that of the panel, is one group."""
    if by:
        return rows.groupBy(*by).applyInPandas(fn, schema)
    return rows.groupBy(F.lit(0).alias("__all")).applyInPandas(lambda pdf: fn(pdf.drop(columns="__all", errors="ignore")), schema)


def adjacency(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted({*pdf["gene1"], *pdf["gene2"]})
    at = {g: i for i, g in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, v in zip(pdf["gene1"].map(at), pdf["gene2"].map(at), pdf["weight"], strict=True):
        w[a, b] = w[b, a] = max(w[a, b], v)
    return names, w


def moved(a: np.ndarray, mass: np.ndarray, label: np.ndarray, norm: float, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Labels after moving single nodes to the label of the greatest gain until no move gains; every move raises the objective, so
    this ends."""
    label = label.copy()
    held = np.bincount(label, mass, len(a))
    again = True
    while again:
        again = False
        for i in rng.permutation(len(a)):
            links = np.bincount(label, a[i], len(a))
            links[label[i]] -= a[i, i]
            held[label[i]] -= mass[i]
            gain = links - resolution * mass[i] * held / norm
            gain[(links <= 0) & (np.arange(len(a)) != label[i])] = -np.inf
            best = int(gain.argmax())
            if gain[best] > gain[label[i]] + 1e-12:
                label[i] = best
                again = True
            held[label[i]] += mass[i]
    return label


def refined_parts(a: np.ndarray, mass: np.ndarray, label: np.ndarray, norm: float, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Each community's parts: from single nodes on, a node that is alone and well connected to its community joins the well-connected
    part of it that gains most. So parts are connected, and communities made of them are."""
    part = np.arange(len(a))
    size = mass.astype(float).copy()
    whole = np.bincount(label, mass, len(a))
    outer = np.array([a[p][label == label[p]].sum() - a[p, p] for p in range(len(a))])  # of each part, its links to the rest of its community
    for i in rng.permutation(len(a)):
        c = label[i]
        if (part == part[i]).sum() > 1 or outer[part[i]] < resolution * mass[i] * (whole[c] - mass[i]) / norm - 1e-12:
            continue
        links = np.bincount(part, np.where(label == c, a[i], 0.0), len(a))
        links[part[i]] = 0
        well = outer >= resolution * size * (whole[c] - size) / norm - 1e-12
        gain = np.where((links > 0) & well, links - resolution * mass[i] * size / norm, 0.0)
        best = int(gain.argmax())
        if gain[best] > 1e-12:
            outer[best] += outer[part[i]] - 2 * links[best]
            size[best] += mass[i]
            size[part[i]], outer[part[i]] = 0.0, 0.0
            part[i] = best
    return part


def communities_of(w: np.ndarray, seed: int, resolution: float = 1.0, objective: str = "modularity", algorithm: str = "leiden") -> np.ndarray:
    """Labels from 1 by moving nodes and aggregation until nothing gains. leiden: what is aggregated are the refined parts of the
    communities, which may then be moved apart, and all is repeated from its result until no single node gains by a move, so communities
    are connected; louvain: the communities themselves are aggregated, once. objective: modularity, or CPM (sizes in the place of
    degrees)."""
    rng = np.random.default_rng(seed)
    total = w.sum()
    weight = w.sum(axis=1) if objective == "modularity" else np.ones(len(w))
    norm = total if objective == "modularity" and total > 0 else 1.0

    def once(label: np.ndarray) -> np.ndarray:
        member, a, mass = np.arange(len(w)), w.copy(), weight
        while True:
            _, label = np.unique(moved(a, mass, label, norm, resolution, rng), return_inverse=True)
            part = refined_parts(a, mass, label, norm, resolution, rng) if algorithm == "leiden" else label
            _, first, part = np.unique(part, return_index=True, return_inverse=True)
            if len(first) == len(a):
                return label[member]
            member, label = part[member], label[first]
            fold = np.zeros((len(first), len(a)))
            fold[part, np.arange(len(a))] = 1
            a, mass = fold @ a @ fold.T, fold @ mass

    out = once(np.arange(len(w)))
    while algorithm == "leiden":
        out = connected_parts(w, out)
        if (moved(w, weight, out, norm, resolution, rng) == out).all():
            break
        out = once(out)
    number: dict[int, int] = {}
    return np.array([number.setdefault(m, len(number) + 1) for m in out.tolist()], int)


def connected_parts(a: np.ndarray, label: np.ndarray) -> np.ndarray:
    out, fresh = np.full(len(a), -1), 0
    for s in range(len(a)):
        if out[s] >= 0:
            continue
        stack = [s]
        out[s] = fresh
        while stack:
            i = stack.pop()
            for j in np.flatnonzero((a[i] > 0) & (label == label[i]) & (out < 0)):
                out[j] = fresh
                stack.append(j)
        fresh += 1
    return out


def restarts(edges: DataFrame, n: int, resolution: float = 1.0, objective: str = "modularity", algorithm: str = "leiden") -> DataFrame:
    """(gene, run, label): communities of n seeded restarts, dealt out by run. edges: (gene1, gene2, weight) of one gene graph."""
    each = edges.select("gene1", "gene2", "weight").crossJoin(F.broadcast(edges.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("run"))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = adjacency(pdf)
        run = int(pdf["run"].iloc[0])
        return pd.DataFrame({"gene": names, "run": run, "label": communities_of(w, run, resolution, objective, algorithm)})

    return in_one_task(each, ["run"], one, "gene string, run int, label int")


def modules_of(edges: DataFrame, n: int = 20, threshold: float = 0.95, resolution: float = 1.0, objective: str = "modularity", algorithm: str = "leiden") -> DataFrame:
    """(gene, module): communities of the consensus graph of n restarts; the first restart's if the consensus is empty."""
    runs = stored(restarts(edges, n, resolution, objective, algorithm))
    agreed = consensus(runs, threshold).select("gene1", "gene2", "weight")
    if not agreed.limit(1).count():
        return runs.where("run = 1").select("gene", F.col("label").alias("module"))
    return restarts(agreed, 1, resolution, objective, algorithm).select("gene", F.col("label").alias("module"))


def agreed_labels(w: np.ndarray, n: int, threshold: float, resolution: float, objective: str, algorithm: str) -> tuple[np.ndarray, np.ndarray]:
    """Labels from 1 of the consensus of n restarts on one small graph, and the agreement matrix above the threshold."""
    runs = np.stack([communities_of(w, seed, resolution, objective, algorithm) for seed in range(1, n + 1)])
    agree = (runs[:, :, None] == runs[:, None, :]).mean(axis=0)
    np.fill_diagonal(agree, 0)
    agree[agree < threshold - 1e-12] = 0
    return (communities_of(agree, 1, resolution, objective, algorithm) if agree.any() else runs[0]), agree


def within(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """edges of genes of one module, with it."""
    tag = lambda k: F.broadcast(modules.select(F.col("gene").alias(f"gene{k}"), F.col("module").alias(f"m{k}")))
    return edges.join(tag(1), "gene1").join(tag(2), "gene2").where("m1 = m2").select("gene1", "gene2", "weight", F.col("m1").alias("module"))


def reclustered(edges: DataFrame, modules: DataFrame, n: int = 20, threshold: float = 0.95, resolution: float = 1.0, objective: str = "modularity", algorithm: str = "leiden") -> DataFrame:
    """(gene, module): every module clustered again on its own edges by the consensus of n restarts, a task a module; modules are numbered
    from 1 over all. Genes without an edge inside go."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = adjacency(pdf)
        label, _ = agreed_labels(w, n, threshold, resolution, objective, algorithm)
        return pd.DataFrame({"gene": names, "old": int(pdf["module"].iloc[0]), "label": label})

    found = within(edges, modules).withColumn("module", F.col("module").cast("int")).groupBy("module").applyInPandas(one, "gene string, old int, label int")
    return numbered(stored(found), "old", "label")


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """(gene, module): a number from 1 for each combination of columns, in their order. As many combinations as modules."""
    kinds = rows.select(*by).distinct().withColumn("__number", F.dense_rank().over(Window.orderBy(*by)))
    return rows.join(F.broadcast(kinds), list(by)).select("gene", F.col("__number").alias("module"))


def merge_tree(d: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Merges of agglomerative clustering (new clusters count from n on) by Lance-Williams updates; ward works on squared distances."""
    n = len(d)
    d = d.astype(float) ** 2 if method == "ward" else d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        if method == "ward":
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * h) / (size[i] + size[j] + size)
        else:
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        out.append((ids[i], ids[j], float(np.sqrt(h)) if method == "ward" else float(h)))
        new[np.isinf(d[i]) | np.isinf(d[j])] = np.inf
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        ids[i] = n + step
    return out


def tree_labels(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels from 1 of the k clusters before the last k - 1 merges."""
    member = {i: [i] for i in range(n)}
    for step, (a, b, _) in enumerate(merges[: max(0, n - k)]):
        member[n + step] = member.pop(a) + member.pop(b)
    out = np.zeros(n, int)
    for label, rows in enumerate(sorted(member.values(), key=min), 1):
        out[rows] = label
    return out


def hierarchical(edges: DataFrame, k: int, least: int = 2, method: str = "ward") -> DataFrame:
    """(gene, module): log1p similarities by their greatest, distances 1 less them, a cut into k, small modules merged into the most
    similar one."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = adjacency(pdf)
        s = np.log1p(np.clip(w, 0, None))
        s = s / s.max() if s.max() > 0 else s
        np.fill_diagonal(s, 1.0)
        label = tree_labels(merge_tree(1 - s, method), len(names), min(k, len(names)))
        while True:
            kinds, counts = np.unique(label, return_counts=True)
            small = kinds[counts < least]
            if not len(small) or len(kinds) == 1:
                break
            c = small[np.argmin(counts[counts < least])]
            mean = {o: s[np.ix_(label == c, label == o)].mean() for o in kinds if o != c}
            label[label == c] = max(mean, key=lambda o: (mean[o], -o))
        _, label = np.unique(label, return_inverse=True)
        return pd.DataFrame({"gene": names, "module": label + 1})

    return in_one_task(edges.select("gene1", "gene2", "weight"), [], one, "gene string, module int")


def tree_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """A maximum spanning forest: heaviest edges first, ties by name, kept where they join two parts."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    rows = pdf.sort_values(["weight", "gene1", "gene2"], ascending=[False, True, True])
    for a, b in zip(rows["gene1"], rows["gene2"], strict=True):
        ra, rb = find(a), find(b)
        keep.append(ra != rb)
        root[ra] = rb
    return rows[keep]


def spanning_forest(edges: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(gene1, gene2, weight): a maximum spanning forest of the graph, or one of each module, dealt out by module."""
    rows = edges.select("gene1", "gene2", "weight")
    schema = "gene1 string, gene2 string, weight double"
    if modules is None:
        return in_one_task(rows, [], tree_edges, schema)
    tag = lambda k: F.broadcast(modules.select(F.col("gene").alias(f"gene{k}"), F.col("module").alias(f"m{k}")))
    own = rows.join(tag(1), "gene1").join(tag(2), "gene2").where("m1 = m2")
    return own.select("gene1", "gene2", "weight", "m1").groupBy("m1").applyInPandas(lambda pdf: tree_edges(pdf)[["gene1", "gene2", "weight"]], schema)


def restored_backbone(raw: DataFrame, filtered: DataFrame, modules: DataFrame, floor_q: float = 0.02) -> DataFrame:
    """filtered with the edges of each module's maximum spanning tree that it lacks, at the least of their own weight and a low quantile
    of the filtered weights."""
    tree = spanning_forest(raw, modules).join(filtered.select("gene1", "gene2"), ["gene1", "gene2"], "left_anti")
    floor = filtered.agg(F.percentile("weight", F.lit(floor_q)).alias("floor"))
    added = tree.crossJoin(F.broadcast(floor)).select("gene1", "gene2", F.coalesce(F.least("weight", "floor"), "weight").alias("weight"), F.lit(True).alias("restored"))
    return filtered.select("gene1", "gene2", "weight", F.lit(False).alias("restored")).union(added)


def loose_modules(metrics: DataFrame, size: int = 10, within_cons: float = 0.5, conductance: float = 0.6) -> DataFrame:
    """(module, within_cons) of the modules that are large, agree little and are cut much."""
    return metrics.where((F.col("size") >= size) & (F.col("within_cons") < within_cons) & (F.col("conductance") > conductance)).select("module", "within_cons")


def accepted(size: np.ndarray, agreement: np.ndarray, before: float, child: int = 5, groups: int = 3, gain: float = 0.07) -> bool:
    """Whether parts take the place of their module: two to `groups` of them, each of `child` genes or more, whose mean agreement, by
    size, is greater than the module's by `gain`."""
    return bool(2 <= len(size) <= groups and size.min() >= child and (size * agreement).sum() / size.sum() >= before + gain)


def sub_modules(edges: DataFrame, modules: DataFrame, metrics: DataFrame, n: int = 10, size: int = 10, within_cons: float = 0.5, conductance: float = 0.6, factor: float = 1.3, child: int = 5, groups: int = 3, gain: float = 0.07, threshold: float = 0.95, resolution: float = 1.0, objective: str = "modularity", algorithm: str = "leiden") -> DataFrame:
    """(gene, module, part): loose_modules() clustered again at a higher resolution, by the consensus of n restarts, where the parts are
    accepted(); part is 1 elsewhere."""
    loose = loose_modules(metrics, size, within_cons, conductance)
    own = within(edges, modules).join(F.broadcast(loose), "module")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = adjacency(pdf)
        label, agree = agreed_labels(w, n, threshold, resolution * factor, objective, algorithm)
        counts = np.bincount(label)[1:]
        means = np.array([agree[np.ix_(label == c + 1, label == c + 1)].sum() / (k * (k - 1)) if k > 1 else 0.0 for c, k in enumerate(counts.tolist())])
        if not agree.any() or not accepted(counts, means, float(pdf["within_cons"].iloc[0]), child, groups, gain):
            label = np.ones(len(names), int)
        return pd.DataFrame({"gene": names, "part": label})

    parts = own.groupBy("module").applyInPandas(one, "gene string, part int")
    return modules.join(parts, "gene", "left").select("gene", "module", F.coalesce("part", F.lit(1)).alias("part"))


def second_stage(edges: DataFrame, raw: DataFrame, modules: DataFrame, similarity: DataFrame | None = None, kept_pairs: DataFrame | None = None, n: int = 20, threshold: float = 0.95, resolution: float = 1.0, objective: str = "modularity", algorithm: str = "leiden", drop_unstable: bool = True, subclusters: bool = True, least: int = 2, sub: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """((gene, module), edges): the first stage's modules corrected. edges and raw: (gene1, gene2, L) after and before the filters.

    Pairs outside of kept_pairs (those the reference curve's band leaves) go; L is multiplied by a similarity mh; the log weights' graph
    gets back what each module's spanning tree needs; modules are clustered again on it, unstable genes go, loose modules are parted,
    and what has no edge inside, or too few genes, is pruned."""
    now = edges.select("gene1", "gene2", "L")
    if kept_pairs is not None:
        now = now.join(kept_pairs.select("gene1", "gene2"), ["gene1", "gene2"], "left_semi")
    if similarity is not None:
        now = weighted_by_similarity(now, similarity)
    base = log_weights(raw.where("L > 0").select("gene1", "gene2", "L"))
    graph = stored(restored_backbone(base, log_weights(now.where("L > 0")), modules).select("gene1", "gene2", "weight"))
    fine = stored(reclustered(graph, modules, n, threshold, resolution, objective, algorithm))
    agreement = stored(consensus(restarts(graph, n, resolution, objective, algorithm), threshold).select("gene1", "gene2", "weight"))
    if drop_unstable:
        fine = stored(fine.join(unstable_genes(gene_metrics(fine, agreement, graph)), "gene", "left_anti"))
    if subclusters:
        parts = sub_modules(graph, fine, cluster_metrics(fine, agreement, graph), n, threshold=threshold, resolution=resolution, objective=objective, algorithm=algorithm, **(sub or {}))
        fine = numbered(stored(parts), "module", "part")
    return pruned(stored(fine), graph, least), graph


def page_ranks(edges: DataFrame, start: DataFrame, damping: float = 0.85, steps: int = 20) -> DataFrame:
    """(gene, rank) of personalised PageRank with softmax start weights (gene, score), scores clipped to their 10th to 90th percentile;
    a fixed number of joins."""
    cut = start.agg(F.percentile("score", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    soft = start.crossJoin(F.broadcast(cut)).select("gene", F.exp(F.least(F.greatest("score", F.col("q")[0]), F.col("q")[1])).alias("e"))
    nodes = directed(edges).select(F.col("a").alias("gene")).distinct().join(soft, "gene", "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    total = nodes.agg(F.sum("e").alias("t"), F.count("*").alias("n"))
    nodes = nodes.crossJoin(F.broadcast(total)).select("gene", F.when(F.col("t") > 0, F.col("e") / F.col("t")).otherwise(1.0 / F.col("n")).alias("p"))
    nodes = stored(nodes)
    out = directed(edges)
    flow = out.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("a")))
    flow = stored(flow)
    rank = nodes.withColumnRenamed("p", "rank")
    for step in range(steps):
        into = flow.join(rank.withColumnRenamed("gene", "a"), "a").groupBy(F.col("b").alias("gene")).agg(F.sum(F.col("w") * F.col("rank")).alias("r"))
        rank = nodes.join(into, "gene", "left").select("gene", (F.col("p") * (1 - damping) + damping * F.coalesce("r", F.lit(0.0))).alias("rank"))
        if step % 5 == 4:  # plans don't grow with the steps
            rank = stored(rank)
    return rank


def reweighted(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    side = lambda k: F.broadcast(ranks.select(F.col("gene").alias(f"gene{k}"), F.col("rank").alias(f"r{k}")))
    return edges.join(side(1), "gene1").join(side(2), "gene2").select("gene1", "gene2", (F.col("weight") * (F.col("r1") + F.col("r2")) / 2).alias("weight"))


def stochastic_trees(edges: DataFrame, n: int, sd: float = 0.2) -> DataFrame:
    """(run, gene1, gene2, weight): the spanning forests of n runs with weights times exp(N(0, sd)), seeded by run and edge."""
    each = edges.select("gene1", "gene2", "weight").crossJoin(F.broadcast(edges.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("run"))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gene1", "gene2"])
        run = int(pdf["run"].iloc[0])
        noise = np.random.default_rng((5, run)).normal(0, sd, len(pdf))
        return tree_edges(pdf.assign(weight=pdf["weight"].to_numpy() * np.exp(noise)))[["run", "gene1", "gene2", "weight"]]

    return each.groupBy("run").applyInPandas(one, "run int, gene1 string, gene2 string, weight double")


def cut_nodes(w: np.ndarray) -> dict[int, int]:
    """Nodes whose removal parts their component, and into how many parts more: by the least entry number that subtrees of a depth-first
    search reach (Tarjan), one pass over the edges."""
    n = len(w)
    entry, low, parts = np.full(n, -1), np.zeros(n, int), dict.fromkeys(range(n), 0)
    near = [np.flatnonzero(row > 0) for row in w]
    time = 0
    for root in range(n):
        if entry[root] >= 0:
            continue
        entry[root] = low[root] = time
        time += 1
        stack = [(root, -1, iter(near[root]))]
        while stack:
            v, parent, rest = stack[-1]
            for u in rest:
                if entry[u] < 0:
                    entry[u] = low[u] = time
                    time += 1
                    stack.append((u, v, iter(near[u])))
                    break
                if u != parent:
                    low[v] = min(low[v], entry[u])
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= entry[parent]:
                        parts[parent] += 1
        parts[root] -= 1
    return {v: k for v, k in parts.items() if k > 0}


def articulation(edges: DataFrame) -> DataFrame:
    """(gene, parts): genes whose removal splits their component, and into how many parts more."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = adjacency(pdf)
        return pd.DataFrame([(names[v], k) for v, k in cut_nodes(w).items()], columns=["gene", "parts"])

    return in_one_task(edges.select("gene1", "gene2", "weight"), [], one, "gene string, parts int")


def branches(edges: DataFrame, least: int = 3) -> DataFrame:
    """(gene, branch): parts that fall off at articulation genes and hold a gene of two edges, the largest first and none overlapping;
    communities where there are none."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = adjacency(pdf)
        n = len(names)
        found = []
        for i in cut_nodes(w):
            keep = np.flatnonzero(np.arange(n) != i)
            part = connected_parts(w[np.ix_(keep, keep)], np.zeros(len(keep)))
            if len(keep):
                for p in range(part.max() + 1):
                    rows = keep[part == p]
                    if least <= len(rows) < n - 1 and ((w[rows] > 0).sum(axis=1) >= 2).any():
                        found.append(frozenset(rows.tolist()))
        used: set[int] = set()
        label = np.zeros(n, int)
        for rows in sorted(set(found), key=lambda r: (-len(r), sorted(r))):
            if not used & rows:
                used |= rows
                label[list(rows)] = label.max() + 1
        if not used:
            label = communities_of(w, 1)
        return pd.DataFrame({"gene": names, "branch": label})

    return in_one_task(edges.select("gene1", "gene2", "weight"), [], one, "gene string, branch int").where("branch > 0")


def tree_distances(tree: DataFrame) -> DataFrame:
    """(gene1, gene2, distance): lengths of paths in a forest whose edges are 1 / (weight + 1e-9) long; unconnected pairs are left out.
    Nodes are taken in the order of a traversal: a new one is as far from all before it as its parent, and the edge."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, w = adjacency(pdf)
        n = len(names)
        d = np.full((n, n), np.inf)
        seen = np.zeros(n, bool)
        for root in range(n):
            if seen[root]:
                continue
            seen[root] = True
            d[root, root] = 0
            order, at = [root], 0
            while at < len(order):
                v = order[at]
                at += 1
                for u in np.flatnonzero((w[v] > 0) & ~seen):
                    seen[u] = True
                    d[u, order] = d[order, u] = d[v, order] + 1 / (w[v, u] + 1e-9)
                    d[u, u] = 0
                    order.append(u)
        i, j = np.triu_indices(n, 1)
        keep = np.isfinite(d[i, j])
        return pd.DataFrame({"gene1": [names[x] for x in i[keep]], "gene2": [names[x] for x in j[keep]], "distance": d[i, j][keep]})

    return in_one_task(tree.select("gene1", "gene2", "weight"), [], one, "gene1 string, gene2 string, distance double")


def together(distances: DataFrame, modules: DataFrame) -> DataFrame:
    """distances by their 95th percentile, 1 at most, with 1 added between modules, so that a module's leaves stay together."""
    top = distances.agg(F.percentile("distance", F.lit(0.95)).alias("top"))
    tag = lambda k: F.broadcast(modules.select(F.col("gene").alias(f"gene{k}"), F.col("module").alias(f"m{k}")))
    met = distances.crossJoin(F.broadcast(top)).join(tag(1), "gene1", "left").join(tag(2), "gene2", "left")
    near = F.least(F.lit(1.0), F.coalesce(F.try_divide("distance", "top"), F.lit(0.0)))
    return met.select("gene1", "gene2", (near + F.when(F.col("m1").eqNullSafe(F.col("m2")), 0.0).otherwise(1.0)).alias("distance"))


def leaf_order(distances: DataFrame) -> DataFrame:
    """(gene, position): leaves of an average-linkage tree over the distances, each merge turned so that its near ends meet."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["gene1"], *pdf["gene2"]})
        at = {g: i for i, g in enumerate(names)}
        far = pdf["distance"].max() * 2 if len(pdf) else 1.0
        d = np.full((len(names), len(names)), far)
        for a, b, v in zip(pdf["gene1"].map(at), pdf["gene2"].map(at), pdf["distance"], strict=True):
            d[a, b] = d[b, a] = v
        np.fill_diagonal(d, 0)
        order = {i: [i] for i in range(len(names))}
        for step, (a, b, _) in enumerate(merge_tree(d, "average")):
            x, y = order.pop(a), order.pop(b)
            turns = [(x, y), (x, y[::-1]), (x[::-1], y), (x[::-1], y[::-1])]
            x, y = min(turns, key=lambda t: d[t[0][-1], t[1][0]])
            order[len(names) + step] = x + y
        rows = next(iter(order.values())) if order else []
        return pd.DataFrame({"gene": [names[i] for i in rows], "position": range(1, len(rows) + 1)})

    return in_one_task(distances.select("gene1", "gene2", "distance"), [], one, "gene string, position int")


def extra_edges(edges: DataFrame, tree: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k heaviest edges off a tree, of weight `least` or more."""
    off = edges.select("gene1", "gene2", "weight").join(tree.select("gene1", "gene2"), ["gene1", "gene2"], "left_anti")
    return off.where(F.col("weight") >= least).orderBy(F.desc("weight"), "gene1", "gene2").limit(k)


def dendrogram_network(edges: DataFrame, modules: DataFrame, start: DataFrame | None = None, extra: int = 5, least: float = 0.0) -> DataFrame:
    """(gene1, gene2, weight, kind): the spanning tree of each module (within), the edges that join modules' trees, heaviest first
    (between), and the heaviest others (extra); weights are those of PageRank from start scores (gene, score), if any."""
    graph = stored(reweighted(edges, page_ranks(edges, start)) if start is not None else edges.select("gene1", "gene2", "weight"))
    own = stored(spanning_forest(graph, modules))
    tag = lambda k: F.broadcast(modules.select(F.col("gene").alias(f"gene{k}"), F.col("module").cast("string").alias(f"x{k}")))
    across = graph.join(tag(1), "gene1").join(tag(2), "gene2").where("x1 <> x2").withColumns({"m1": F.least("x1", "x2"), "m2": F.greatest("x1", "x2")})
    best = across.withColumn("n", F.row_number().over(Window.partitionBy("m1", "m2").orderBy(F.desc("weight"), "gene1", "gene2"))).where("n = 1")
    joins = spanning_forest(best.select(F.col("m1").alias("gene1"), F.col("m2").alias("gene2"), "weight")).select(F.col("gene1").alias("m1"), F.col("gene2").alias("m2"))
    between = stored(best.join(joins, ["m1", "m2"], "left_semi").select("gene1", "gene2", "weight"))
    tree = own.union(between)
    return own.withColumn("kind", F.lit("within")).union(between.withColumn("kind", F.lit("between"))).union(extra_edges(graph, tree, extra, least).withColumn("kind", F.lit("extra")))


def modularity(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """One row: the modularity of modules in a weighted graph."""
    tag = F.broadcast(modules.select(F.col("gene").alias("a"), F.col("module").alias("m")))
    both = directed(edges).join(tag, "a").join(F.broadcast(modules.select(F.col("gene").alias("b"), F.col("module").alias("o"))), "b")
    per = both.groupBy("m").agg(F.sum(F.when(F.col("m") == F.col("o"), F.col("w")).otherwise(0.0)).alias("own"), F.sum("w").alias("all"))
    total = both.agg(F.sum("w").alias("t"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("own") / F.col("t") - (F.col("all") / F.col("t")) * (F.col("all") / F.col("t"))).alias("modularity"))


def graph_quality(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """One row: edge density, mean and deviation of degrees over all genes, share of hubs (degree over twice the median)."""
    d = genes.select("gene").join(degrees(edges), "gene", "left").select(F.coalesce("degree", F.lit(0)).cast("double").alias("d"))
    mid = d.agg(F.percentile("d", F.lit(0.5)).alias("mid"), F.count("*").cast("double").alias("n"), F.sum("d").alias("s"))
    s = d.crossJoin(F.broadcast(mid)).groupBy("mid", "n", "s").agg(F.avg("d").alias("mean_degree"), F.stddev_samp("d").alias("sd_degree"), F.avg((F.col("d") > 2 * F.col("mid")).cast("double")).alias("hub_ratio"))
    return s.select((F.col("s") / (F.col("n") * (F.col("n") - 1))).alias("edge_density"), "mean_degree", "sd_degree", "hub_ratio")
