"""A scope: named tables of one tissue, and the verbs that add to them. What verbs add is stored in the shared
folder, so that plans stay short, with what it was made from; verbs that use it refuse it when that has changed."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import curve as curves
from .operators import graphs as graph_ops
from .operators import grids, inference, metadata, pairs, ranking, tables, weights
from .steps import step
from .storage import stored


@dataclass(frozen=True)
class GridLayer:
    """Tiles of one length: the tile table, counts, and what verbs add (layers of values, weights and their style, images' facts)."""

    length: float
    info: DataFrame
    counts: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    weights: DataFrame | None = None
    style: str | None = None
    histology: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Scope:
    """Molecules, grid layers by name, cell layers, pair statistics, curves and densities; made: what statistics were made from. Verbs
    return a new scope."""

    molecules: DataFrame
    grids: dict[str, GridLayer] = field(default_factory=dict)
    cells: dict[str, DataFrame] = field(default_factory=dict)
    stats: dict[str, DataFrame] = field(default_factory=dict)
    curves: dict[str, DataFrame] = field(default_factory=dict)
    density: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict[str, str | None] = field(default_factory=dict)
    genes: DataFrame | None = None
    made: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def create(cls, molecules: DataFrame, lengths: list[float], min_genes: int = 1, flipped: bool = False, cells: DataFrame | None = None) -> Scope:
        layers = {}
        for length in lengths:
            with step("create", "layer", length=length):
                info, counts = grids.layer(molecules, length, min_genes, flipped)
                layers[f"grid{length:g}"] = GridLayer(length, weights.validated(info), counts)
        return cls(molecules, layers, {"counts": cells} if cells is not None else {})

    def with_grid(self, name: str, **changes) -> Scope:
        return replace(self, grids=self.grids | {name: replace(self.grids[name], **changes)})

    def with_stats(self, **tables_: DataFrame) -> Scope:
        return replace(self, stats=self.stats | {k: stored(v) for k, v in tables_.items()})

    def add_single_cells(self, counts: DataFrame, name: str = "counts") -> Scope:
        """Counts a cell and gene (cell, gene, count). Where molecules name their cells, an error unless some of them are meant."""
        if "cell" in self.molecules.columns and not tables.alignment(counts.withColumn("cell", F.col("cell").cast("string")), self.molecules.withColumn("cell", F.col("cell").cast("string")), "cell").first().both:
            raise ValueError("no cell of the counts stands in the molecules")
        return replace(self, cells=self.cells | {name: counts})

    def add_histology(self, grid: str, name: str, width: int, height: int, box: tuple[float, float, float, float], microns_per_pixel: float) -> Scope:
        """An image's size, the box of coordinates it covers and its scale; plots take pixels by these. The pixels themselves stay in
        their file."""
        if width <= 0 or height <= 0 or box[1] <= box[0] or box[3] <= box[2]:
            raise ValueError("an image needs a size and a box")
        g = self.grids[grid]
        return self.with_grid(grid, histology=g.histology | {name: {"width": width, "height": height, "box": box, "microns_per_pixel": microns_per_pixel}})

    def migrate_metadata(self, rows: DataFrame, scalars: dict[str, str | None] | None = None) -> Scope:
        """The gene table without pseudo rows and columns that the scope's own metadata repeat."""
        genes, found = metadata.migrated(rows, dict(self.metadata), scalars or {})
        return replace(self, genes=genes, metadata=found)

    def normalise(self, grid: str, layer: str = "Xz", keep_zero: bool = False) -> Scope:
        g = self.grids[grid]
        return self.with_grid(grid, layers=g.layers | {layer: stored(grids.normalise(g.counts, g.info, keep_zero))})

    def normalise_cells(self, scale: float = 1e4) -> Scope:
        return replace(self, cells=self.cells | {"logCPM": grids.log_cpm(self.cells["counts"], scale)})

    def compute_weights(self, grid: str, style: str = "B", topology: str | None = None, **options) -> Scope:
        g = self.grids[grid]
        info = weights.validated(g.info)
        edges = stored(weights.weights(info, style, weights.choose_topology(info, topology, self.metadata.get("platform")), **options))
        return self.with_grid(grid, weights=edges, style=style)

    def source(self, grid: str, layer: str) -> dict:
        """What statistics of a layer are made from now."""
        g = self.grids[grid]
        return metadata.source_of(g.layers[layer], g.weights, layer, g.style or "")

    def require_fresh(self, name: str, grid: str, layer: str) -> None:
        """An error unless a statistic was made from the scope's layer and weights as they are."""
        metadata.require_fresh(self.made[name], self.source(grid, layer))

    def compute_l(self, grid: str, layer: str = "Xz", perms: int = 0, block_side: int | None = None, dense: bool = False, mem_limit_gb: float | None = None) -> Scope:
        """Lee's L of all pairs, with perms by permutations, of all tiles or within blocks. mem_limit_gb: an error if the matrix of all pairs
        is larger; None where it isn't to be collected."""
        g = self.grids[grid]
        x = g.layers[layer]
        bad = pairs.centring(x).where("not finite").limit(1).count()
        if bad:
            raise ValueError(f"layer {layer} has values that aren't finite")
        pairs.require_size(x.select("gene").distinct(), mem_limit_gb)
        with step("compute_l", "pairs", grid=grid, layer=layer, dense=dense):
            out = stored(pairs.lees_l(x, g.weights, g.info, dense=dense))
        if perms:
            tiles = g.info if block_side is None else grids.block_ids(g.info, block_side)
            with step("compute_l", "permutations", n=perms, block_side=block_side):
                out = inference.permutation_test_dense(x, g.weights, tiles, out, perms, None if block_side is None else "block")
                out = stored(inference.adjusted(out, "p", "BH", out="fdr"))
        made = self.source(grid, layer) | metadata.settings_of(perms=perms, block_side=block_side)
        return replace(self, stats=self.stats | {f"L_{layer}": out}, made=self.made | {f"L_{layer}": made})

    def compute_l_visium(self, grid: str, layer: str = "Xz", min_detect: float = 0.1, top: int = 500, winsorise: float = 0.95, **options) -> Scope:
        """compute_l() on the most counted genes that enough tiles have, with values above a quantile cut to it and centred again."""
        g = self.grids[grid]
        some = grids.prescreen(g.counts, g.info, min_detect, top).select("gene")
        cut = grids.winsorise(g.layers[layer].join(F.broadcast(some), "gene", "left_semi"), winsorise)
        mean = cut.groupBy("gene").agg(F.avg("z").alias("m"))
        centred = stored(cut.join(F.broadcast(mean), "gene").select("grid_id", "gene", (F.col("z") - F.col("m")).alias("z")))
        return self.with_grid(grid, layers=g.layers | {f"{layer}_visium": centred}).compute_l(grid, f"{layer}_visium", **options)

    def compute_correlation(self, grid: str | None = None, layer: str = "Xz", method: str = "pearson", mem_limit_gb: float | None = None) -> Scope:
        x, unit, value = (self.cells["logCPM"], "cell", "value") if grid is None else (self.grids[grid].layers[layer], "grid_id", "z")
        pairs.require_size(x.select("gene").distinct(), mem_limit_gb)
        fn = {"pearson": pairs.pearson, "spearman": pairs.spearman, "kendall": pairs.kendall}[method]
        return self.with_stats(r=fn(x, unit, value))

    def compute_density(self, grid: str, name: str, genes: Column, mode: str = "none") -> Scope:
        g = self.grids[grid]
        return replace(self, density=self.density | {name: grids.density(g.counts, g.info, genes, mode)})

    def compute_idelta(self, grid: str) -> Scope:
        g = self.grids[grid]
        return self.with_stats(idelta=pairs.idelta(g.counts, g.info.agg(F.count("*").cast("double").alias("q"))))

    def compute_mh(self, grid: str, stats: str = "L_Xz", chao: bool = True) -> Scope:
        g = self.grids[grid]
        value = g.counts.join(g.info.select("grid_id", (F.col("width") * F.col("height")).alias("area")), "grid_id").select("grid_id", "gene", (F.col("count") / F.col("area")).alias("value"))
        return self.with_stats(mh=pairs.morisita_horn(value, graph_ops.threshold_graph(self.stats[stats]), chao))

    def gene_jaccard(self, grid: str, min_tiles: int = 8, top: int = 60) -> Scope:
        """Similarity of presence among the genes that most tiles have; the table of a heat map, a row a pair."""
        return self.with_stats(jaccard=pairs.jaccard(self.grids[grid].counts, min_tiles, top))

    def module_test(self, modules: str = "modules", method: str = "signed_rank", alternative: str = "two.sided", n_perm: int = 10_000, min_within: int = 1, min_between: int = 1) -> DataFrame:
        """Whether genes are more alike (gene_jaccard()) within their module than with others: one row."""
        table = inference.within_between(self.stats["jaccard"], self.stats[modules], "jaccard", min_within, min_between)
        return inference.signed_rank(table, alternative) if method == "signed_rank" else inference.sign_flips(table, n_perm, alternative)

    def compute_curve(self, grid: str, layer: str = "Xz", name: str = "curve", points: int = 1000, b: int = 1000, span: float = 0.45, degree: int = 1, k_max: int = 0, n_strata: int = 50, downsample: float = 1, jitter: float = 0.0, method: str = "percentile", min_rel_width: float = 0.0, widen_span: float = 0.1) -> Scope:
        """The curve of L against r with its band, on an even grid over the range of r. downsample: a share (below 1) or number of pairs;
        jitter: how far r is moved at random, as a share of a fiftieth of its range."""
        self.require_fresh(f"L_{layer}", grid, layer)
        met = ranking.finite_pairs(ranking.deltas(self.stats[f"L_{layer}"].select("gene1", "gene2", "L"), self.stats["r"]))
        if downsample != 1:
            met = inference.downsample(met.withColumn("pair", F.concat_ws("|", "gene1", "gene2")), "pair", downsample).drop("pair")
        span_r = met.agg(F.min("r").alias("lo"), F.max("r").alias("hi")).first()
        if span_r.lo is None or span_r.hi <= span_r.lo:
            raise ValueError("r has no range")
        moved = F.col("r") + (inference.uniform("gene1", "gene2") - 0.5) * (jitter * (span_r.hi - span_r.lo) / 25)
        pts = stored(curves.strata(met.select((moved if jitter else F.col("r")).alias("x"), F.col("L").alias("y")), n_strata, "x"))
        with step("compute_curve", "bootstrap", b=b, span=span, points=points):
            raw = stored(curves.bootstrap_curve(pts, np.linspace(span_r.lo, span_r.hi, points), b, span, degree, k_max))
        done = curves.finished_curve(pts, raw, method, min_rel_width, widen_span)
        made = self.made[f"L_{layer}"] | metadata.settings_of(b=b, span=span, degree=degree, k_max=k_max, n_strata=n_strata, downsample=downsample, jitter=jitter, method=method, points=points)
        return replace(self, curves=self.curves | {name: stored(done)}, made=self.made | {name: made})

    def cluster_genes(self, stats: str = "L_Xz", restarts: int = 20, threshold: float = 0.95, least: int = 2, resolution: float = 1.0, min_cutoff: float = 0.0, fdr_max: float | None = None, algorithm: str = "leiden", objective: str = "modularity", second_stage: bool = False, curve: str | None = None, **options) -> Scope:
        """Modules of genes. With the second stage, pairs inside a curve's band go, Morisita-Horn similarities weigh the others (compute_mh()
        before), and the modules are corrected on that graph."""
        raw = stored(graph_ops.threshold_graph(self.stats[stats]))
        kept = stored(graph_ops.threshold_graph(self.stats[stats], min_cutoff, fdr_max))
        edges = stored(graph_ops.log_weights(kept))
        with step("cluster_genes", "first stage", restarts=restarts, algorithm=algorithm):
            modules = stored(graph_ops.modules_of(edges, restarts, threshold, resolution, objective, algorithm))
        if not second_stage:
            return self.with_stats(modules=graph_ops.pruned(modules, edges, least), graph=edges.select("gene1", "gene2", "weight"))
        outside = curves.ci_rule(ranking.deltas(self.stats[stats], self.stats["r"]), self.curves[curve], "remove_within") if curve else None
        with step("cluster_genes", "second stage", curve=curve):
            found, graph = graph_ops.second_stage(kept, raw, modules, self.stats.get("mh"), outside, restarts, threshold, resolution, objective, algorithm, least=least, **options)
        return self.with_stats(modules=found, graph=graph)

    def dendro_paths(self, gene: str, target: str | None = None, cutoff: int = 8, most: int = 50_000, shortest: bool = False) -> DataFrame:
        """Simple paths from a gene along the modules' trees and the edges between them."""
        network = graph_ops.dendrogram_network(self.stats["graph"], self.stats["modules"], extra=0)
        return graph_ops.simple_paths(stored(network), gene, cutoff, most, target, shortest)

    def top_l_vs_r(self, grid: str | None = None, layer: str = "Xz", n: int = 10, direction: str = "largest", clamp: str = "none", r_range: tuple[float, float] = (-1.0, 1.0), l_range: tuple[float, float] = (-1.0, 1.0), curve: str | None = None, ci_rule: str = "remove_within", perms: int = 0, block_side: int | None = 8, p_mode: str = "exact", p_adjust: str = "BH") -> DataFrame:
        """Pairs that L and r tell apart most: within ranges, outside of a curve's band, and with perms tested by permutations that keep r.
        With a grid, statistics made from another layer or weights are refused."""
        if grid is not None:
            self.require_fresh(f"L_{layer}", grid, layer)
            if curve is not None:
                metadata.require_fresh(self.made[curve], self.source(grid, layer))
        met = ranking.in_ranges(ranking.finite_pairs(ranking.deltas(self.stats[f"L_{layer}"].select("gene1", "gene2", "L"), self.stats["r"], clamp)), r_range, l_range)
        if curve is not None:
            met = curves.ci_rule(met, self.curves[curve], ci_rule)
        met = stored(met)
        top = ranking.top_pairs(met, n, direction)
        if not perms:
            return top
        g = self.grids[grid]
        tiles = g.info if block_side is None else grids.block_ids(g.info, block_side)
        tested = inference.permutation_test_dense(g.layers[layer], g.weights, tiles, stored(top), perms, None if block_side is None else "block", "r")
        tested = tested.withColumn("p", inference.p_value(F.col("k"), perms, p_mode, inference.uniform("gene1", "gene2")))
        return ranking.ranked(met, stored(tested), p_adjust)
