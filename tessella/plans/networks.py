"""Queries of graphs, plot tables, metadata, and the streaming counterpart of binning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curve, graphs, grids, metadata, pairs, points, ranking, views, weights
from ..sources import tables as T
from ..storage import stored
from ..streaming import binning
from .basic import BAND_SQL, BH_SQL, CURVE_SQL, P_SQL, band, delta, idelta, lee, lee_of, modules, with_p
from .registry import good, layer, md5_int, md5_sql, query, r, rounded, with_, xz

S = SparkSession


def graph(spark: S, sf: str) -> DataFrame:
    return stored(graphs.log_weights(graphs.threshold_graph(lee(spark, sf))).select("gene1", "gene2", "L", "weight"))


def runs(spark: S, sf: str) -> DataFrame:
    return T.memberships(spark, sf)


@query("GRF01_threshold_graph", with_("lee", f"SELECT gene1, gene2, {r('L')} FROM bh WHERE L > 0 AND abs(L) >= 0.002 AND fdr <= 0.9", P_SQL, BH_SQL))
def threshold(spark: S, sf: str) -> DataFrame:
    from ..operators.inference import adjusted

    return rounded(graphs.threshold_graph(adjusted(with_p(spark, sf)), 0.002, 0.9).select("gene1", "gene2", "L"))


@query("GRF02_log_weights", with_("graph", f"SELECT gene1, gene2, {r('weight')} FROM graph"))
def log_weights(spark: S, sf: str) -> DataFrame:
    return rounded(graph(spark, sf).select("gene1", "gene2", "weight"))


@query("GRF03_communities")
def communities(spark: S, sf: str) -> DataFrame:
    return graphs.restarts(graph(spark, sf), 4)


@query("GRF03_communities_cpm")
def communities_cpm(spark: S, sf: str) -> DataFrame:
    return graphs.restarts(graph(spark, sf), 4, 0.005, "CPM")


@query("GRF04_louvain")
def louvain(spark: S, sf: str) -> DataFrame:
    return graphs.restarts(graph(spark, sf), 4, algorithm="louvain")


@query("GRF05_consensus", with_("cons", f"SELECT gene1, gene2, n AS count, {r('n / 8.0', 'weight')} FROM cons WHERE n >= 4"))
def consensus(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.consensus(runs(spark, sf), 0.5))


@query("GRF06_consensus_modules")
def consensus_modules(spark: S, sf: str) -> DataFrame:
    return graphs.modules_of(graph(spark, sf), 8, 0.5)


@query("GRF07_hierarchical")
def hierarchical(spark: S, sf: str) -> DataFrame:
    return graphs.hierarchical(graph(spark, sf), 6)


@query("GRF08_smoothed_weights", with_("graph", f"SELECT gene1, gene2, {r('sqrt((least(greatest(weight, lo), hi) - lo) / (hi - lo))', 'weight')} FROM graph, (SELECT quantile_cont(weight, 0.05) AS lo, quantile_cont(weight, 0.95) AS hi FROM graph)"))
def smoothed(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.smoothed_weights(graph(spark, sf).drop("weight")).select("gene1", "gene2", "weight"))


SIMS = f"sims AS (SELECT gene1, gene2, {md5_sql('gene1', 'gene2')} % 100 / 100.0::DOUBLE AS mh FROM graph WHERE {md5_sql('gene1', 'gene2')} % 3 > 0)"


@query("JN09_similarity_lookup", with_("graph", f"SELECT gene1, gene2, {r('L * coalesce(mh, mid)', 'L')} FROM graph LEFT JOIN sims USING (gene1, gene2), (SELECT quantile_cont(mh, 0.5) AS mid FROM sims)", SIMS))
def lookup(spark: S, sf: str) -> DataFrame:
    g = graph(spark, sf)
    h = md5_int("gene1", "gene2")
    sims = g.where(h % 3 > 0).select("gene1", "gene2", (h % 100 / 100.0).alias("mh"))
    return rounded(graphs.weighted_by_similarity(g.select("gene1", "gene2", "L"), sims))


def forest_sql(source: str, name: str) -> list[str]:
    """name(gene1, gene2, weight): the maximum spanning forest of a source. An edge stands in it unless heavier ones (ties by name) lead
    from one of its ends to the other."""
    return [
        f"{name}_o AS (SELECT gene1, gene2, weight, row_number() OVER (ORDER BY weight DESC, gene1, gene2) AS k FROM ({source}))",
        f"{name}_d AS (SELECT gene1 AS a, gene2 AS b, k FROM {name}_o UNION ALL SELECT gene2, gene1, k FROM {name}_o)",
        f"{name}_r AS (SELECT k AS e, gene1 AS n FROM {name}_o UNION SELECT e, b FROM {name}_r JOIN {name}_d ON a = n AND k < e)",
        f"{name} AS (SELECT gene1, gene2, weight FROM {name}_o WHERE NOT EXISTS (SELECT 1 FROM {name}_r WHERE e = k AND n = gene2))",
    ]


@query("GRF09_restored_backbone", with_("graph mods", f"SELECT gene1, gene2, {r('weight')}, false AS restored FROM graph WHERE weight > 0.01 UNION ALL SELECT gene1, gene2, {r('least(weight, (SELECT quantile_cont(weight, 0.02) FROM graph WHERE weight > 0.01))', 'weight')}, true FROM tr WHERE weight <= 0.01", "e AS (SELECT g.*, a.module AS m1, b.module AS m2 FROM graph g JOIN mods a ON a.gene = gene1 JOIN mods b ON b.gene = gene2)", *forest_sql("SELECT gene1, gene2, weight FROM e WHERE m1 = m2", "tr")))
def restored(spark: S, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return rounded(graphs.restored_backbone(g, g.where("weight > 0.01"), modules(spark, sf)))


@query("GRF10_reclustered")
def reclustered(spark: S, sf: str) -> DataFrame:
    return graphs.reclustered(graph(spark, sf), modules(spark, sf), 8, 0.5)


@query("GRF12_sub_modules")
def sub_modules(spark: S, sf: str) -> DataFrame:
    """With thresholds at which some of the modules are loose."""
    return graphs.sub_modules(graph(spark, sf), modules(spark, sf), metrics(spark, sf), size=6, within_cons=0.8, conductance=0.7, child=2, gain=0.0, threshold=0.5)


def agreement(spark: S, sf: str) -> DataFrame:
    return graphs.consensus(runs(spark, sf), 0.0)


def metrics(spark: S, sf: str) -> DataFrame:
    return graphs.cluster_metrics(modules(spark, sf), agreement(spark, sf), graph(spark, sf))


TAGGED = "e AS (SELECT g.*, a.module AS m1, b.module AS m2 FROM graph g JOIN mods a ON a.gene = gene1 JOIN mods b ON b.gene = gene2)"
INSIDE = "ins AS (SELECT a.module, sum(n / 8.0) AS s FROM cons JOIN mods a ON a.gene = gene1 JOIN mods b ON b.gene = gene2 AND a.module = b.module GROUP BY a.module)"


@query("AGG14_cluster_metrics", with_("graph cons mods", f"SELECT module, size, {r('CASE WHEN size > 1 THEN coalesce(s, 0) / (size * (size - 1) / 2) ELSE 0 END', 'within_cons')}, {r('cut / (cut + win + 1e-12)', 'conductance')} FROM (SELECT module, count(*) AS size FROM mods GROUP BY module) LEFT JOIN ins USING (module) LEFT JOIN (SELECT module, sum(CASE WHEN m1 = m2 THEN weight ELSE 0 END) AS win, sum(CASE WHEN m1 <> m2 THEN weight ELSE 0 END) AS cut FROM mods JOIN e ON module = m1 OR module = m2 GROUP BY module) USING (module)", TAGGED, INSIDE))
def cluster_metrics(spark: S, sf: str) -> DataFrame:
    return rounded(metrics(spark, sf))


GENE_METRICS = "gm AS (SELECT m.gene, m.module, coalesce(max(CASE WHEN p.module = m.module THEN p.s / (z.n - 1) END), 0) AS p_in, coalesce(max(CASE WHEN p.module <> m.module THEN p.s / z.n END), 0) AS p_best_out, coalesce(any_value(w.w), 0) AS w_in FROM mods m LEFT JOIN (SELECT d.a AS gene, o.module, sum(d.w) AS s FROM (SELECT gene1 AS a, gene2 AS b, n / 8.0 AS w FROM cons UNION ALL SELECT gene2, gene1, n / 8.0 FROM cons) d JOIN mods o ON o.gene = d.b GROUP BY d.a, o.module) p ON p.gene = m.gene LEFT JOIN (SELECT module, count(*) AS n FROM mods GROUP BY module) z ON z.module = p.module LEFT JOIN (SELECT gene, sum(weight) AS w FROM (SELECT gene1 AS gene, weight FROM e WHERE m1 = m2 UNION ALL SELECT gene2, weight FROM e WHERE m1 = m2) GROUP BY gene) w ON w.gene = m.gene GROUP BY m.gene, m.module)"


def gene_table(spark: S, sf: str) -> DataFrame:
    return graphs.gene_metrics(modules(spark, sf), agreement(spark, sf), graph(spark, sf))


@query("AGG15_gene_metrics", with_("graph cons mods", f"SELECT gene, module, {r('p_in')}, {r('p_best_out')}, {r('w_in')} FROM gm", TAGGED, GENE_METRICS))
def gene_metrics(spark: S, sf: str) -> DataFrame:
    return rounded(gene_table(spark, sf))


@query("GRF11_unstable_genes", with_("graph cons mods", "SELECT gene FROM gm, (SELECT quantile_cont(w_in, 0.5) AS c FROM gm) WHERE p_in < 0.95 AND p_best_out > 0.01 AND w_in <= c", TAGGED, GENE_METRICS))
def unstable(spark: S, sf: str) -> DataFrame:
    return graphs.unstable_genes(gene_table(spark, sf), 0.95, 0.01, 0.5)


CLUSTER_METRICS = "cm AS (SELECT module, size, CASE WHEN size > 1 THEN coalesce(s, 0) / (size * (size - 1) / 2) ELSE 0 END AS within_cons, cut / (cut + win + 1e-12) AS conductance FROM (SELECT module, count(*) AS size FROM mods GROUP BY module) LEFT JOIN ins USING (module) LEFT JOIN (SELECT module, sum(CASE WHEN m1 = m2 THEN weight ELSE 0 END) AS win, sum(CASE WHEN m1 <> m2 THEN weight ELSE 0 END) AS cut FROM mods JOIN e ON module = m1 OR module = m2 GROUP BY module) USING (module))"


@query("GRF12_loose_modules", with_("graph cons mods", f"SELECT module, {r('within_cons')} FROM cm, (SELECT quantile_cont(size, 0.25)::INT AS a, quantile_cont(within_cons, 0.75) AS b, quantile_cont(conductance, 0.25) AS c FROM cm) WHERE size >= a AND within_cons < b AND conductance > c", TAGGED, INSIDE, CLUSTER_METRICS))
def loose(spark: S, sf: str) -> DataFrame:
    """At the quartiles of the modules' own metrics, so that each of the three conditions turns some away."""
    m = stored(metrics(spark, sf))
    q = m.agg(F.percentile("size", F.lit(0.25)).alias("a"), F.percentile("within_cons", F.lit(0.75)).alias("b"), F.percentile("conductance", F.lit(0.25)).alias("c")).first()
    return rounded(graphs.loose_modules(m, round(q.a), q.b, q.c))


@query("GRF13_pruned", with_("graph mods", "SELECT gene, dense_rank() OVER (ORDER BY module)::INT AS module FROM (SELECT *, count(*) OVER (PARTITION BY module) AS n FROM mods SEMI JOIN (SELECT gene1 AS gene FROM e WHERE m1 = m2 UNION SELECT gene2 FROM e WHERE m1 = m2) USING (gene)) WHERE n >= 2", TAGGED))
def pruned(spark: S, sf: str) -> DataFrame:
    return graphs.pruned(modules(spark, sf), graph(spark, sf))


FREQ = "f AS (SELECT gene1, gene2, weight, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0 END) AS frequency FROM graph JOIN runs a ON a.gene = gene1 JOIN runs b ON b.gene = gene2 AND a.run = b.run GROUP BY gene1, gene2, weight)"


@query("JN14_edge_frequency", with_("graph runs", f"SELECT gene1, gene2, {r('frequency')} FROM f", FREQ))
def frequency(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.edge_frequency(graph(spark, sf), runs(spark, sf)).select("gene1", "gene2", "frequency"))


@query("GRF14_graph_views", with_("graph runs", f"SELECT gene1, gene2, {r('weight')}, {r('frequency')}, frequency >= 0.5 - 1e-12 AS is_consensus_edge FROM f", FREQ))
def graph_views(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.graph_views(graph(spark, sf), runs(spark, sf), 0.5).select("gene1", "gene2", "weight", "frequency", "is_consensus_edge"))


@query("SET05_paper_graph", with_("graph runs", f"SELECT gene1, gene2, {r('weight')} FROM f WHERE frequency >= 0.5 - 1e-12", FREQ))
def paper(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.graph_views(graph(spark, sf), runs(spark, sf), 0.5).where("is_consensus_edge").select("gene1", "gene2", "weight"))


@query("GRF15_first_stage")
def first_stage(spark: S, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return graphs.pruned(graphs.modules_of(g, 8, 0.5), g)


@query("GRF15_clustered_genes")
def clustered(spark: S, sf: str) -> DataFrame:
    """Both stages: pairs inside the curve's band go, the others are weighted by Morisita-Horn similarity."""
    info, c = layer(spark, sf)
    z = stored(grids.normalise(c, info))
    met = stored(ranking.deltas(lee_of(info, z), pairs.pearson(z, "grid_id", "z")))
    raw = stored(graphs.threshold_graph(met.select("gene1", "gene2", "L")))
    value = c.join(info, "grid_id").select("grid_id", "gene", (F.col("count") / (F.col("width") * F.col("height"))).alias("value"))
    first = stored(graphs.modules_of(graphs.log_weights(raw), 8, 0.5))
    outside = curve.ci_rule(met, band(spark), "remove_within")
    return graphs.second_stage(raw, raw, first, pairs.morisita_horn(value, raw), outside, 8, 0.5)[0]


BOTH = "both_ AS (SELECT gene1 AS a, gene2 AS b FROM graph WHERE weight > 0.01 UNION SELECT gene2, gene1 FROM graph WHERE weight > 0.01)"


@query("GRF16_simple_paths", with_("graph", "SELECT array_to_string(p, '>') AS path, (len(p) - 1)::INT AS length FROM walk WHERE len(p) > 1 ORDER BY length, path LIMIT 300", BOTH, "walk AS (SELECT ['Brand#11'] AS p UNION ALL SELECT list_append(p, b) FROM walk JOIN both_ ON a = p[-1] WHERE NOT list_contains(p, b) AND len(p) <= 3)"))
def paths(spark: S, sf: str) -> DataFrame:
    return graphs.simple_paths(graph(spark, sf).where("weight > 0.01"), "Brand#11", 3, 300)


@query("GRF22_components", with_("graph", "SELECT a AS gene, least(a, min(b)) AS component FROM reach GROUP BY a", BOTH, "reach AS (SELECT a, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b)"))
def components(spark: S, sf: str) -> DataFrame:
    return graphs.gene_components(graph(spark, sf).where("weight > 0.01"))


@query("GRF22_degrees", with_("graph", "SELECT gene, count(*) AS degree FROM (SELECT gene1 AS gene FROM graph UNION ALL SELECT gene2 FROM graph) GROUP BY gene"))
def degree(spark: S, sf: str) -> DataFrame:
    return graphs.degrees(graph(spark, sf))


def page_rank_sql(steps: int = 20) -> list[str]:
    """rg(gene1, gene2, weight): the graph reweighted by PageRank from the genes' idelta; a table a step."""
    out = [
        "st AS (SELECT gene, (SELECT count(*) FROM info) * sum(c * (c - 1))::DOUBLE / (sum(c) * (sum(c) - 1)) AS score FROM counts GROUP BY gene HAVING sum(c) >= 2)",
        "ef AS (SELECT gene, exp(least(greatest(score, lo), hi)) AS e FROM st, (SELECT quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM st))",
        "gd AS (SELECT gene1 AS a, gene2 AS b, weight AS w FROM graph UNION ALL SELECT gene2, gene1, weight FROM graph)",
        "pn AS (SELECT gene, e / sum(e) OVER () AS p FROM (SELECT DISTINCT a AS gene FROM gd) JOIN ef USING (gene))",
        "fl AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS w FROM gd)", "k0 AS (SELECT gene, p AS rank FROM pn)",
    ]
    out += [f"k{i + 1} AS (SELECT pn.gene, any_value(p) * 0.15::DOUBLE + 0.85::DOUBLE * coalesce(sum(w * rank), 0) AS rank FROM pn LEFT JOIN fl ON b = pn.gene LEFT JOIN k{i} ON k{i}.gene = a GROUP BY pn.gene)" for i in range(steps)]
    return [*out, f"rg AS (SELECT gene1, gene2, weight * (x.rank + y.rank) / 2 AS weight FROM graph JOIN k{steps} x ON x.gene = gene1 JOIN k{steps} y ON y.gene = gene2)"]


def start_scores(spark: S, sf: str) -> DataFrame:
    return idelta(spark, sf).where("idelta is not null").select("gene", F.col("idelta").alias("score"))


@query("GRF17_page_rank", with_("graph counts info", f"SELECT gene1, gene2, {r('weight * 1000', 'weight')} FROM rg", *page_rank_sql()))
def page_rank(spark: S, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return rounded(graphs.reweighted(g, graphs.page_ranks(g, start_scores(spark, sf))).withColumn("weight", F.col("weight") * 1000))


@query("GRF18_spanning_trees", with_("graph mods", f"SELECT gene1, gene2, {r('weight')}, 'within' AS kind FROM tr UNION ALL SELECT gene1, gene2, {r('weight')}, 'between' FROM bt", TAGGED, *forest_sql("SELECT gene1, gene2, weight FROM e WHERE m1 = m2", "tr"), *forest_sql("SELECT least(m1, m2)::VARCHAR AS gene1, greatest(m1, m2)::VARCHAR AS gene2, max(weight) AS weight FROM e WHERE m1 <> m2 GROUP BY ALL", "bt")))
def trees(spark: S, sf: str) -> DataFrame:
    g = graph(spark, sf)
    own = graphs.spanning_forest(g, modules(spark, sf)).withColumn("kind", F.lit("within"))
    cross = graphs.between_modules(g, modules(spark, sf)).select(F.col("m1").cast("string").alias("gene1"), F.col("m2").cast("string").alias("gene2"), "weight")
    return rounded(own.union(graphs.spanning_forest(cross).withColumn("kind", F.lit("between"))))


@query("GRF19_stochastic_union")
def stochastic(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.tree_union(graphs.stochastic_trees(graph(spark, sf), 5)))


@query("GRF20_branches")
def branches(spark: S, sf: str) -> DataFrame:
    return graphs.branches(graphs.spanning_forest(graph(spark, sf)))


@query("GRF20_articulation", with_("graph", "SELECT gene, (count(*) - 1)::INT AS parts FROM (SELECT gene1 AS gene FROM tr UNION ALL SELECT gene2 FROM tr) GROUP BY gene HAVING count(*) > 1", *forest_sql("SELECT gene1, gene2, weight FROM graph", "tr")))
def articulation(spark: S, sf: str) -> DataFrame:
    return graphs.articulation(graphs.spanning_forest(graph(spark, sf)))


@query("GRF21_tree_distances", with_("graph", f"SELECT least(s, n) AS gene1, greatest(s, n) AS gene2, {r('any_value(d)', 'distance')} FROM wk WHERE s < n GROUP BY s, n", *forest_sql("SELECT gene1, gene2, weight FROM graph", "tr"), "td AS (SELECT gene1 AS a, gene2 AS b, 1 / (weight + 1e-9) AS w FROM tr UNION ALL SELECT gene2, gene1, 1 / (weight + 1e-9) FROM tr)", "wk AS (SELECT a AS s, b AS n, a AS f, w AS d FROM td UNION ALL SELECT s, b, n, d + w FROM wk JOIN td ON a = n AND b <> f)"))
def distances(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.tree_distances(graphs.spanning_forest(graph(spark, sf))))


@query("GRF21_leaf_order")
def leaves(spark: S, sf: str) -> DataFrame:
    far = stored(graphs.tree_distances(graphs.spanning_forest(graph(spark, sf))))
    return graphs.leaf_order(graphs.together(far, modules(spark, sf)))


@query("AGG11_between_modules", with_("graph mods", f"SELECT least(m1, m2) AS m1, greatest(m1, m2) AS m2, {r('max(weight)', 'weight')} FROM e WHERE m1 <> m2 GROUP BY ALL", TAGGED))
def between(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.between_modules(graph(spark, sf), modules(spark, sf)))


_parts = "u AS (SELECT gene1, gene2, weight * run AS weight FROM graph, range(1, 4) AS t(run) WHERE weight > 0.004 * run)"


@query("AGG12_tree_union", with_("graph", f"SELECT gene1, gene2, {r('avg(weight)', 'weight')}, count(*) AS runs FROM u GROUP BY gene1, gene2", _parts))
def union(spark: S, sf: str) -> DataFrame:
    each = graph(spark, sf).crossJoin(F.broadcast(spark.range(1, 4).withColumnRenamed("id", "run"))).where("weight > 0.004 * run")
    return rounded(graphs.tree_union(each.select("gene1", "gene2", (F.col("weight") * F.col("run")).alias("weight"))))


@query("TOP06_extra_edges", with_("graph", f"SELECT gene1, gene2, {r('weight')} FROM graph WHERE weight >= 0.001 AND gene1 <> 'Brand#11' ORDER BY weight DESC, gene1, gene2 LIMIT 10"))
def extra(spark: S, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return rounded(graphs.extra_edges(g, g.where("gene1 = 'Brand#11'"), 10, 0.001))


@query("QCM01_graph_quality", with_("graph xz", f"SELECT {r('sum(d) / (count(*) * (count(*) - 1))', 'edge_density')}, {r('avg(d)', 'mean_degree')}, {r('stddev_samp(d)', 'sd_degree')}, {r('avg(CASE WHEN d > 2 * mid THEN 1.0 ELSE 0 END)', 'hub_ratio')} FROM dg, (SELECT quantile_cont(d, 0.5) AS mid FROM dg)", "dg AS (SELECT gene, coalesce(n, 0)::DOUBLE AS d FROM (SELECT DISTINCT gene FROM xz) LEFT JOIN (SELECT gene, count(*) AS n FROM (SELECT gene1 AS gene FROM graph UNION ALL SELECT gene2 FROM graph) GROUP BY gene) USING (gene))"))
def graph_quality(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.graph_quality(graph(spark, sf), xz(spark, sf)[1].select("gene").distinct()))


@query("QCM01_modularity", with_("graph mods", f"SELECT {r('sum(own / t - (al / t) ** 2)', 'modularity')} FROM (SELECT m, sum(CASE WHEN m = o THEN w ELSE 0 END) AS own, sum(w) AS al FROM (SELECT m1 AS m, m2 AS o, weight AS w FROM e UNION ALL SELECT m2, m1, weight FROM e) GROUP BY m), (SELECT 2 * sum(weight) AS t FROM e)", TAGGED))
def modularity(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.modularity(graph(spark, sf), modules(spark, sf)))


@query("FLT16_network_edges", with_("lee", f"SELECT gene1, gene2, {r('L')}, {r('greatest(abs(L), 1e-6)', 'weight')}, sign(L)::INT AS sign FROM bh WHERE (L >= 0.001 OR L <= -0.002) AND L <> 0 AND abs(L) <= 0.05 AND p < 0.9 AND fdr <= 0.95", P_SQL, BH_SQL))
def network(spark: S, sf: str) -> DataFrame:
    from ..operators.inference import adjusted

    p = adjusted(with_p(spark, sf))
    return rounded(views.network_edges(p, None, 0.001, 0.002, 0.05, 0.9, 0.95, ["FDR_storey", "fdr"]))


@query("FLT16_symmetric_edges", with_("w", "SELECT least(i, j) AS i, greatest(i, j) AS j, sum(w) / 2 AS w FROM w GROUP BY ALL"))
def symmetric(spark: S, sf: str) -> DataFrame:
    return weights.symmetric(weights.weights(layer(spark, sf)[0]))


@query("PLT13_hubs", with_("graph", "SELECT gene, degree, degree > 1.05 * (SELECT quantile_cont(degree, 0.5) FROM d) AS hub FROM d", "d AS (SELECT gene, count(*) AS degree FROM (SELECT gene1 AS gene FROM graph UNION ALL SELECT gene2 FROM graph) GROUP BY gene)"))
def hubs(spark: S, sf: str) -> DataFrame:
    return views.hubs(graph(spark, sf), 1.05)


@query("PLT01_cluster_comparison", "SELECT DISTINCT p_brand AS gene, t.c AS clustering, CASE t.c WHEN 'first' THEN substr(p_brand, 7, 1) ELSE substr(p_brand, 8, 1) END AS cluster FROM part, (VALUES ('first'), ('second')) AS t(c)")
def comparison(spark: S, sf: str) -> DataFrame:
    p = T.table(spark, sf, "part").select(F.col("p_brand").alias("gene")).distinct()
    return views.cluster_comparison(p.select("gene", F.substring("gene", 7, 1).alias("first"), F.substring("gene", 8, 1).alias("second")), ["first", "second"])


DENS = "d AS (SELECT grid_id, coalesce(s, 0) / (width * height) AS density FROM info LEFT JOIN (SELECT grid_id, sum(c)::DOUBLE AS s FROM counts WHERE gene IN ('Brand#11', 'Brand#22') GROUP BY grid_id) USING (grid_id))"


def dens(spark: S, sf: str) -> DataFrame:
    info, c = layer(spark, sf)
    return grids.density(c, info, F.col("gene").isin("Brand#11", "Brand#22"))


@query("PLT06_density_map", with_("info counts", f"SELECT grid_id, xmin, xmax, ymin, ymax, {r('least(density, top)', 'density')}, {r('least(density, top) / top', 'alpha')} FROM info JOIN d USING (grid_id), (SELECT max(density) * 0.8 AS top FROM d)", DENS))
def density_map(spark: S, sf: str) -> DataFrame:
    return rounded(views.density_map(layer(spark, sf)[0], dens(spark, sf), 0.8))


@query("PLT07_density_centroids", with_("ring", f"SELECT cell_id || '_' || (cell_id % 4) AS cell, {r('x')}, {r('y')}, {r('least(cell_id % 10, 0.8 * 9) / (0.8 * 9)', 'alpha')} FROM ring WHERE cell_id % 10 > 0"))
def centroids(spark: S, sf: str) -> DataFrame:
    from ..sources.readers import centroids as read

    c = read(T.cells(spark, sf))
    d = T.cells(spark, sf).select(F.concat_ws("_", "cell_id", "fov").alias("cell"), (F.col("cell_id") % 10).cast("double").alias("density"))
    return rounded(views.density_centroids(c, d, 0.8))


@query("PLT08_grid_boundary", with_("info", f"""SELECT grid_id, xmin, xmax, ymin, ymax, {r('cx - h', '"left"')}, {r('cx + h', '"right"')}, {r('cy - h', 'bottom')}, {r('cy + h', 'top')} FROM info, (SELECT (min(xmin) + max(xmax)) / 2 AS cx, (min(ymin) + max(ymax)) / 2 AS cy, greatest(max(xmax) - min(xmin), max(ymax) - min(ymin)) / 2 AS h FROM info)"""))
def boundary(spark: S, sf: str) -> DataFrame:
    return rounded(views.grid_boundary(layer(spark, sf)[0]))


@query("PLT09_idelta_table", with_("counts info", f"SELECT gene, rank::INT AS rank, {r('d', 'idelta')} FROM (SELECT gene, d, rank() OVER (ORDER BY d DESC) AS rank FROM (SELECT gene, (SELECT count(*) FROM info) * sum(c * (c - 1))::DOUBLE / (sum(c) * (sum(c) - 1)) AS d FROM counts GROUP BY gene HAVING sum(c) >= 2)) WHERE rank <= 10"))
def idelta_table(spark: S, sf: str) -> DataFrame:
    met = idelta(spark, sf).where("idelta is not null").withColumn("all", F.lit(1))
    return rounded(ranking.per_group_top(met, "all", "idelta", 10).select("gene", "rank", "idelta"))


@query("PLT10_histogram", with_("lee", f"SELECT bin::INT AS bin, {r('lo + bin * step', 'low')}, {r('lo + (bin + 1) * step', 'high')}, count(*) AS n FROM (SELECT least(19, floor((L - lo) / step)) AS bin, lo, step FROM lee, (SELECT min(L) AS lo, (max(L) - min(L)) / 20 AS step FROM lee)) GROUP BY bin, lo, step"))
def histogram(spark: S, sf: str) -> DataFrame:
    return rounded(views.histogram(lee(spark, sf), "L", 20))


@query("PLT11_fold_scatter", with_("lee counts", f"SELECT gene1, gene2, {r('L')}, {r('greatest(a.total, b.total) / greatest(1, least(a.total, b.total))', 'fold')} FROM lee JOIN tot a ON a.gene = gene1 JOIN tot b ON b.gene = gene2", "tot AS (SELECT gene, sum(c)::DOUBLE AS total FROM counts GROUP BY gene)"))
def scatter(spark: S, sf: str) -> DataFrame:
    return rounded(lee(spark, sf).join(pairs.fold_pairs(grids.gene_totals(layer(spark, sf)[1])), ["gene1", "gene2"]).select("gene1", "gene2", "L", "fold"))


@query("PLT12_l_vs_r", with_("delta", f"SELECT gene1, gene2, {r('L')}, {r('r')}, {r('Delta')}, L < lo OR L > hi AS outside FROM band", CURVE_SQL, BAND_SQL))
def l_vs_r(spark: S, sf: str) -> DataFrame:
    met = curve.interpolate(delta(spark, sf), band(spark), "r", ["lo", "hi"])
    return rounded(met.select("gene1", "gene2", "L", "r", "Delta", ((F.col("L") < F.col("lo")) | (F.col("L") > F.col("hi"))).alias("outside")))


@query("PLT02_dendrogram")
def dendrogram(spark: S, sf: str) -> DataFrame:
    tree = stored(graphs.spanning_forest(graph(spark, sf)))
    return rounded(tree.join(graphs.leaf_order(graphs.tree_distances(tree)).withColumnRenamed("gene", "gene1"), "gene1"))


NETWORK = [
    *page_rank_sql(), *forest_sql("SELECT gene1, gene2, weight FROM rg JOIN mods a ON a.gene = gene1 JOIN mods b ON b.gene = gene2 WHERE a.module = b.module", "tr"),
    "ac AS (SELECT gene1, gene2, weight, least(a.module, b.module)::VARCHAR AS x1, greatest(a.module, b.module)::VARCHAR AS x2 FROM rg JOIN mods a ON a.gene = gene1 JOIN mods b ON b.gene = gene2 WHERE a.module <> b.module)",
    "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x1, x2 ORDER BY weight DESC, gene1, gene2) AS n FROM ac) WHERE n = 1)",
    *forest_sql("SELECT x1 AS gene1, x2 AS gene2, weight FROM bs", "bt"),
    "nt AS (SELECT gene1, gene2, weight, 'within' AS kind FROM tr UNION ALL SELECT bs.gene1, bs.gene2, bs.weight, 'between' FROM bs JOIN bt ON bt.gene1 = x1 AND bt.gene2 = x2)",
]


@query("PLT03_dendrogram_network", with_("graph counts info mods", f"SELECT gene1, gene2, {r('weight * 1000', 'weight')}, kind FROM nt UNION ALL (SELECT gene1, gene2, {r('weight * 1000', 'weight')}, 'extra' FROM rg ANTI JOIN nt USING (gene1, gene2) ORDER BY rg.weight DESC, gene1, gene2 LIMIT 5)", *NETWORK))
def dendrogram_network(spark: S, sf: str) -> DataFrame:
    out = graphs.dendrogram_network(graph(spark, sf), modules(spark, sf), start_scores(spark, sf), 5)
    return rounded(out.withColumn("weight", F.col("weight") * 1000))


@query("PLT04_dendrogram_multi")
def dendrogram_multi(spark: S, sf: str) -> DataFrame:
    return rounded(graphs.tree_union(graphs.stochastic_trees(graph(spark, sf), 3)).where("runs >= 2"))


@query("PLT05_dendrogram_branches")
def dendrogram_branches(spark: S, sf: str) -> DataFrame:
    tree = stored(graphs.spanning_forest(graph(spark, sf)))
    return rounded(tree.join(graphs.branches(tree).withColumnRenamed("gene", "gene1"), "gene1", "left"))


@query("MTA01_migrated_metadata", "SELECT p_brand AS gene, count(*) AS n_parts, 'Xenium' AS platform FROM part WHERE p_size < 20 GROUP BY p_brand")
def migrate(spark: S, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "part").where("p_size < 20").groupBy(F.col("p_brand").alias("gene")).agg(F.count("*").alias("n_parts")).withColumn("platform", F.lit("xenium v1"))
    pseudo = spark.createDataFrame([("__scope_platform__", None, "xenium v1")], "gene string, n_parts long, platform string")
    table, found = metadata.migrated(rows.union(pseudo), {}, {})
    return table.withColumn("platform", F.lit(found["platform"]))


@query("MTA02_platform_names", "SELECT DISTINCT p_type AS raw, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'Xenium' ELSE p_type END AS platform FROM part")
def platform(spark: S, sf: str) -> DataFrame:
    p = T.table(spark, sf, "part").select(F.col("p_type").alias("raw")).distinct()
    return p.select("raw", metadata.platform_name(F.when(F.lower("raw").contains("brass"), "10x Xenium").otherwise(F.col("raw"))).alias("platform"))


@query("PRV01_fingerprint", f"SELECT count(*) AS rows, sum({md5_sql('p_brand', 'p_partkey')[:-8].replace(chr(39) + '_' + chr(39), chr(39) + '|' + chr(39))}::BIGINT)::BIGINT AS hash FROM part")
def fingerprint(spark: S, sf: str) -> DataFrame:
    return metadata.fingerprint(T.table(spark, sf, "part"), ["p_brand", "p_partkey"])


@query("STR01_streaming_counts", with_("good", "SELECT floor(x / 100 + 1)::INT AS gx, floor(y / 100 + 1)::INT AS gy, gene, count(*) AS count FROM good GROUP BY ALL"))
def streaming(spark: S, sf: str) -> DataFrame:
    """A stream over the line items' files, joined with the table of parts, that runs until all there is has been read."""
    lines = spark.readStream.schema(T.table(spark, sf, "lineitem").schema).parquet(f"{sf}/lineitem.parquet*")
    found = points.good_quality(points.near_nucleus(T.molecules_of(lines, T.table(spark, sf, "part"))))
    return binning.counted(found, 100.0, 0.0, 0.0)
