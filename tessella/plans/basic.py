"""Queries of scans, filters, joins, aggregations, windows, sets and scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import curve, grids, inference, pairs, points, ranking, tables, weights
from ..sources import readers
from ..sources import tables as T
from ..storage import shared_folder, stored
from .registry import LENGTH, good, layer, md5_int, md5_sql, query, r, rounded, with_, xz

S = SparkSession


@query("SRC02_molecule_scan", with_("mol", f"SELECT gene AS feature_name, {r('x', 'x_location')}, {r('y', 'y_location')}, qv, nd AS nucleus_distance FROM mol"))
def molecule_scan(spark: S, sf: str) -> DataFrame:
    """The platform's file as the reader finds it, written out of the stand-in table."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    T.molecules(spark, sf).select("x_location", "y_location", "qv", "nucleus_distance", "feature_name", "cell").write.parquet(path)
    return rounded(readers.read_molecules(spark, path).select("feature_name", "x_location", "y_location", "qv", "nucleus_distance"))


@query("SRC03_centroids", with_("ring", f"SELECT cell_id || '_' || (cell_id % 4) AS cell, {r('x')}, {r('y')} FROM ring"))
def centroid_scan(spark: S, sf: str) -> DataFrame:
    return rounded(readers.centroids(T.cells(spark, sf)))


@query("SRC04_boundaries", with_("ring", f"SELECT 'c' || cell_id AS label_id, cell_id AS cell, 5::BIGINT AS n, {r('x - 4', 'first_x')}, {r('y - 4', 'last_y')} FROM ring"))
def boundary_scan(spark: S, sf: str) -> DataFrame:
    out = readers.boundaries(T.vertices(spark, sf), T.cells(spark, sf))
    return rounded(out.select("label_id", "cell", F.size("ring").cast("long").alias("n"), F.col("ring")[0]["x"].alias("first_x"), F.element_at("ring", -1)["y"].alias("last_y")))


@query("SRC04_boundaries_of_kept_cells", with_("ring good", f"SELECT 'c' || cell_id AS label_id, cell_id AS cell, {r('x - 4', 'first_x')} FROM ring SEMI JOIN (SELECT cell AS cell_id FROM good) USING (cell_id)"))
def kept_boundaries(spark: S, sf: str) -> DataFrame:
    """Of cells that have molecules after the default filters."""
    kept = tables.members(T.cells(spark, sf), good(spark, sf).select(F.col("cell").alias("cell_id")), "cell_id")
    return rounded(readers.boundaries(T.vertices(spark, sf), kept).select("label_id", "cell", F.col("ring")[0]["x"].alias("first_x")))


@query("SRC05_cosmx_molecules", with_("mol", f"SELECT {r('x * 0.120280945::DOUBLE', 'x_location')}, {r('y * 0.120280945::DOUBLE', 'y_location')}, qv, 0.0::DOUBLE AS nucleus_distance, gene AS feature_name FROM mol"))
def cosmx(spark: S, sf: str) -> DataFrame:
    raw = T.molecules(spark, sf).select(F.col("x_location").alias("x_global_px"), F.col("y_location").alias("y_global_px"), F.col("feature_name").alias("target"), "qv")
    return rounded(readers.cosmx_molecules(raw))


@query("SRC06_cells_from_vertices", with_("ring", f"SELECT cell_id, (cell_id % 4)::INT AS fov, {r('x')}, {r('y')} FROM ring"))
def vertex_means(spark: S, sf: str) -> DataFrame:
    v = T.vertices(spark, sf).select("cell_id", (F.col("cell_id") % 4).cast("int").alias("fov"), F.col("vertex_x").alias("x"), F.col("vertex_y").alias("y"))
    return rounded(readers.cells_from_vertices(v))


@query("SRC07_wide_expression", "SELECT o_orderkey AS cell_ID, g AS gene, v AS count FROM (SELECT o_orderkey, {'Total': o_totalprice, 'Low': CASE WHEN o_totalprice < 50000 THEN o_totalprice ELSE 0 END} AS m FROM orders), (VALUES ('Total'), ('Low')) AS t(g), LATERAL (SELECT CASE g WHEN 'Total' THEN m.Total ELSE m.Low END AS v) WHERE v <> 0")
def wide(spark: S, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders")
    low = F.when(F.col("o_totalprice") < 50000, F.col("o_totalprice")).otherwise(F.lit(0.0))
    raw = o.select(F.col("o_orderkey").alias("cell_ID"), F.col("o_totalprice").alias("Total"), low.alias("Low"), F.lit(1.0).alias("NegPrb1"))
    return readers.wide_to_long(raw, ["cell_ID"])


@query("SRC08_csc_expansion", with_("ex", f"SELECT sample AS col, substr(gene, 2)::INT AS row, {r('v', 'value')} FROM ex"))
def csc(spark: S, sf: str) -> DataFrame:
    e = T.table(spark, sf, "embeddings")
    cols = e.select(F.col("vec_id").alias("col"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("indices"), F.col("embedding").cast("array<double>").alias("data"))
    return rounded(readers.csc_to_long(cols))


@query("SRC09_mtx_counts", with_("cell", "SELECT 'b' || cell AS grid_id, gene, c AS count FROM cell"))
def mtx(spark: S, sf: str) -> DataFrame:
    m = T.cell_counts(spark, sf)
    genes = m.select("gene").distinct().withColumn("index", F.row_number().over(Window.orderBy("gene")).cast("long"))
    matrix = m.join(F.broadcast(genes), "gene").select(F.col("index").alias("row"), F.col("cell").alias("col"), F.col("count").alias("value"))
    barcodes = m.select("cell").distinct().select(F.col("cell").alias("index"), F.concat(F.lit("b"), "cell").alias("barcode"))
    return readers.mtx_counts(matrix, genes.withColumnRenamed("gene", "name"), barcodes)


@query("SRC10_positions", "SELECT 's' || s_suppkey AS barcode, 1 AS in_tissue, s_nationkey::INT AS array_row, (s_suppkey % 7)::INT AS array_col, s_acctbal AS pxl_row_in_fullres, s_acctbal * 2 AS pxl_col_in_fullres FROM supplier WHERE s_suppkey % 3 = 1")
def spot_positions(spark: S, sf: str) -> DataFrame:
    s = T.table(spark, sf, "supplier")
    raw = s.select(F.concat(F.lit("s"), "s_suppkey").alias("Barcode"), (F.col("s_suppkey") % 3 == 1).cast("int").alias("In_Tissue"), F.col("s_nationkey").alias("row"), (F.col("s_suppkey") % 7).alias("col"), F.col("s_acctbal").alias("imagerow"), (F.col("s_acctbal") * 2).alias("imagecol"))
    return readers.positions(raw)


@query("SRC11_scalefactors", "SELECT round(55.0 / (p_size + 10), 6) + 0.0 AS microns_per_pixel, 55.0::DOUBLE AS spot_um FROM part")
def factors(spark: S, sf: str) -> DataFrame:
    return rounded(readers.scalefactors(T.table(spark, sf, "part").select((F.col("p_size") + 10.0).alias("spot_diameter_fullres"))))


@query("SRC13_crop_box", with_("box", 'SELECT floor(xmin * 0.3::DOUBLE)::INT AS "left", least(ceil(xmax * 0.3::DOUBLE), 300)::INT AS "right", floor(ymin * 0.3::DOUBLE)::INT AS top, least(ceil(ymax * 0.3::DOUBLE), 280)::INT AS bottom FROM box'))
def crop(spark: S, sf: str) -> DataFrame:
    box = grids.bounds(good(spark, sf)).select(F.col("xmin").alias("left"), F.col("xmax").alias("right"), F.col("ymin").alias("top"), F.col("ymax").alias("bottom"))
    return readers.crop_box(box, 300, 280, 0.3)


@query("SRC14_bounding_ring", with_("box", f"SELECT 0 AS pos, {r('xmin', 'x')}, {r('ymin', 'y')} FROM box UNION ALL SELECT 1, {r('xmax')}, {r('ymin')} FROM box UNION ALL SELECT 2, {r('xmax')}, {r('ymax')} FROM box UNION ALL SELECT 3, {r('xmin')}, {r('ymax')} FROM box"))
def ring(spark: S, sf: str) -> DataFrame:
    return rounded(readers.bounding_ring(good(spark, sf), "x_location", "y_location"))


@query("SRC15_feature_metadata", with_("counts", "SELECT gene, sum(c)::BIGINT AS total, n_parts, size FROM counts LEFT JOIN (SELECT p_brand AS gene, count(*) AS n_parts, max(p_size)::INT AS size FROM part WHERE p_size < 10 GROUP BY 1) USING (gene) GROUP BY gene, n_parts, size"))
def feature_metadata(spark: S, sf: str) -> DataFrame:
    meta = T.table(spark, sf, "part").where("p_size < 10").groupBy(F.col("p_brand").alias("gene")).agg(F.count("*").alias("n_parts"), F.max("p_size").cast("int").alias("size"))
    return tables.with_metadata(layer(spark, sf)[1].groupBy("gene").agg(F.sum("count").alias("total")), meta)


MOLS = f"gene AS feature_name, {r('x', 'x_location')}, {r('y', 'y_location')}, qv, nd AS nucleus_distance"
KEPT = ["mol_id", "feature_name", "x_location", "y_location", "qv", "nucleus_distance"]
BRANDS = ("Brand#11", "Brand#22", "Brand#33")


@query("FLT01_gene_allow_list", with_("mol", f"SELECT mol_id, {MOLS} FROM mol WHERE gene IN {BRANDS}"))
def allow(spark: S, sf: str) -> DataFrame:
    return rounded(points.allow_genes(T.molecules(spark, sf), list(BRANDS)).select(*KEPT))


@query("FLT02_nucleus_distance", with_("mol", f"SELECT mol_id, {MOLS} FROM mol WHERE nd <= 25"))
def near(spark: S, sf: str) -> DataFrame:
    return rounded(points.near_nucleus(T.molecules(spark, sf)).select(*KEPT))


@query("FLT03_control_prefixes", with_("mol", f"SELECT mol_id, {MOLS} FROM mol WHERE NOT starts_with(gene, 'Brand#1') AND NOT starts_with(gene, 'Brand#22')"))
def controls(spark: S, sf: str) -> DataFrame:
    return rounded(points.without_controls(T.molecules(spark, sf), (*points.CONTROLS, "Brand#1", "Brand#22")).select(*KEPT))


@query("FLT04_quality", with_("mol", f"SELECT mol_id, {MOLS} FROM mol WHERE qv >= 20"))
def quality(spark: S, sf: str) -> DataFrame:
    return rounded(points.good_quality(T.molecules(spark, sf)).select(*KEPT))


@query("FLT05_flip_y", with_("good box", f"SELECT mol_id, gene AS feature_name, {r('x', 'x_location')}, {r('ymax - y', 'y_location')}, qv, nd AS nucleus_distance FROM good, box"))
def flip(spark: S, sf: str) -> DataFrame:
    return rounded(points.flip_y(good(spark, sf)).select(*KEPT))


@query("FLT06_gene_panel", with_("cell", f"SELECT cell, gene, c AS count FROM cell WHERE NOT starts_with(gene, 'Brand#2') AND gene IN {BRANDS}"))
def panel(spark: S, sf: str) -> DataFrame:
    return points.gene_panel(T.cell_counts(spark, sf), ("Brand#2",), list(BRANDS))


@query("FLT07_genes_a_tile", with_("counts", "SELECT grid_id, gene, c AS count FROM counts SEMI JOIN (SELECT grid_id FROM counts GROUP BY grid_id HAVING count(DISTINCT gene) BETWEEN 5 AND 24) USING (grid_id)"))
def rich(spark: S, sf: str) -> DataFrame:
    return grids.rich_tiles(layer(spark, sf)[1], 5, 24).select("grid_id", "gene", "count")


@query("FLT08_vertices_a_tile", with_("counts ring", "SELECT grid_id, gene, c AS count FROM counts SEMI JOIN (SELECT 'g' || (floor(x / 100) + 1)::INT || '_' || (floor(y / 100) + 1)::INT AS grid_id FROM ring GROUP BY 1 HAVING count(*) >= 3) USING (grid_id)"))
def segmented(spark: S, sf: str) -> DataFrame:
    at = lambda c: (F.floor(F.col(c) / 100) + 1).cast("int")
    tagged = T.cells(spark, sf).select(F.concat(F.lit("g"), at("x_centroid"), F.lit("_"), at("y_centroid")).alias("grid_id"))
    return grids.segmented_tiles(layer(spark, sf)[1], tagged, 3).select("grid_id", "gene", "count")


@query("FLT09_whole_tiles", with_("tile", "SELECT gx, gy, grid_id, xmin, xmax, ymin, ymax FROM tile"))
def whole(spark: S, sf: str) -> DataFrame:
    return grids.tiles(grids.bounds(good(spark, sf)), LENGTH).select("gx", "gy", "grid_id", "xmin", "xmax", "ymin", "ymax")


@query("FLT10_genes_of_cluster", with_("counts mods", "SELECT grid_id, gene, c AS count FROM counts SEMI JOIN (SELECT gene FROM mods WHERE module = 2) USING (gene)"))
def cluster_genes(spark: S, sf: str) -> DataFrame:
    return points.allow_genes(layer(spark, sf)[1], modules(spark, sf).where("module = 2"), "gene").select("grid_id", "gene", "count")


def modules(spark: S, sf: str) -> DataFrame:
    return T.table(spark, sf, "part").select(F.col("p_brand").alias("gene")).distinct().withColumn("module", (md5_int("gene") % 4).cast("int"))


def lee(spark: S, sf: str) -> DataFrame:
    return lee_of(*xz(spark, sf))


def lee_of(info: DataFrame, z: DataFrame) -> DataFrame:
    return stored(pairs.lees_l(z, stored(weights.weights(info)), info))


def pear(spark: S, sf: str) -> DataFrame:
    return pairs.pearson(xz(spark, sf)[1], "grid_id", "z")


def delta(spark: S, sf: str, clamp: str = "none") -> DataFrame:
    """Pairs with L, r and Delta, from one layer."""
    info, z = xz(spark, sf)
    return ranking.deltas(lee_of(info, z), pairs.pearson(z, "grid_id", "z"), clamp)


@query("FLT11_signed_quantiles", with_("lee", f"SELECT gene1, gene2, {r('L')} FROM lee, (SELECT quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.95) AS b FROM ent WHERE v >= 0), (SELECT quantile_cont(-v, 0.1) AS c, quantile_cont(-v, 0.95) AS d FROM ent WHERE v < 0) WHERE CASE WHEN L >= 0 THEN L BETWEEN a AND b ELSE -L BETWEEN c AND d END", "ent AS (SELECT L AS v FROM lee UNION ALL SELECT L FROM lee UNION ALL SELECT 0.0 FROM range((SELECT count(DISTINCT gene) FROM xz)))"))
def signed_quantiles(spark: S, sf: str) -> DataFrame:
    return rounded(ranking.quantile_filter(lee(spark, sf), xz(spark, sf)[1].select("gene").distinct(), 0.1, 0.95).select("gene1", "gene2", "L"))


P_SQL = f"pv AS (SELECT gene1, gene2, L, {md5_sql('gene1', 'gene2')} % 100 / 100.0::DOUBLE AS p FROM lee)"
BH_SQL = "bh AS (SELECT gene1, gene2, L, p, least(1.0, min(p * m / k) OVER (ORDER BY p DESC)) AS fdr FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS k FROM pv))"


def with_p(spark: S, sf: str) -> DataFrame:
    """Pairs with a p drawn from a hash of their names, so that ties and order are the same everywhere."""
    return lee(spark, sf).withColumn("p", md5_int("gene1", "gene2") % 100 / 100.0)


@query("FLT12_significance_mask", with_("lee", f"SELECT gene1, gene2, {r('CASE WHEN fdr <= 0.5 THEN L ELSE 0 END', 'L')} FROM bh", P_SQL, BH_SQL))
def mask(spark: S, sf: str) -> DataFrame:
    p = with_p(spark, sf)
    return rounded(ranking.significance_mask(p.select("gene1", "gene2", "L"), inference.adjusted(p), 0.5))


@query("FLT13_pair_ranges", with_("delta", f"SELECT gene1, gene2, {r('L')}, {r('r')} FROM delta WHERE r BETWEEN -0.5 AND 0.2 AND L BETWEEN -0.1 AND 0.1"))
def ranges(spark: S, sf: str) -> DataFrame:
    return rounded(ranking.in_ranges(delta(spark, sf), (-0.5, 0.2), (-0.1, 0.1)).select("gene1", "gene2", "L", "r"))


CURVE_SQL = "curve AS (SELECT i, -1.0::DOUBLE + i * 0.1::DOUBLE AS x, (-1.0::DOUBLE + i * 0.1::DOUBLE) * 0.5::DOUBLE - 0.05::DOUBLE AS lo, (-1.0::DOUBLE + i * 0.1::DOUBLE) * 0.5::DOUBLE + 0.05::DOUBLE AS hi FROM range(0, 21) AS t(i))"
BAND_SQL = "band AS (SELECT d.*, a.lo + (t - a.i) * (b.lo - a.lo) AS lo, a.hi + (t - a.i) * (b.hi - a.hi) AS hi FROM (SELECT *, least(greatest((r + 1) / 0.1::DOUBLE, 0), 20) AS t FROM delta) d JOIN curve a ON a.i = least(floor(t), 19) JOIN curve b ON b.i = a.i + 1)"


def band(spark: S) -> DataFrame:
    x = -1.0 + F.col("id") * 0.1
    return spark.range(21).select(x.alias("x"), (x * 0.5 - 0.05).alias("lo"), (x * 0.5 + 0.05).alias("hi"))


@query("FLT14_ci_rule", with_("delta", f"SELECT gene1, gene2, {r('L')}, {r('r')}, {r('lo')}, {r('hi')} FROM band WHERE L < lo OR L > hi", CURVE_SQL, BAND_SQL))
def ci(spark: S, sf: str) -> DataFrame:
    return rounded(curve.ci_rule(delta(spark, sf), band(spark), "remove_within").select("gene1", "gene2", "L", "r", "lo", "hi"))


@query("INT01_interpolation", with_("delta", f"SELECT gene1, gene2, {r('lo')}, {r('hi')} FROM band", CURVE_SQL, BAND_SQL))
def interpolation(spark: S, sf: str) -> DataFrame:
    return rounded(curve.interpolate(delta(spark, sf), band(spark), "r", ["lo", "hi"]).select("gene1", "gene2", "lo", "hi"))


@query("FLT15_finite_pairs", with_("delta", f"SELECT gene1, gene2, {r('L')}, {r('r')} FROM delta WHERE isfinite(L) AND isfinite(r)"))
def finite(spark: S, sf: str) -> DataFrame:
    return rounded(ranking.finite_pairs(delta(spark, sf)).select("gene1", "gene2", "L", "r"))


@query("FLT17_matrix_predicate", with_("lee", f"SELECT gene1, gene2, {r('L')} FROM lee WHERE L > 0.01"))
def predicate(spark: S, sf: str) -> DataFrame:
    return rounded(ranking.matrix_filter(lee(spark, sf), "gt", 0.01).select("gene1", "gene2", "L"))


@query("PRJ01_scaled", with_("mol", f"SELECT mol_id, {r('x * 0.5', 'x_location')}, {r('y * 0.5', 'y_location')} FROM mol"))
def scaled(spark: S, sf: str) -> DataFrame:
    return rounded(points.scaled(T.molecules(spark, sf), 0.5).select("mol_id", "x_location", "y_location"))


@query("PRJ02_level_pixels", with_("mol", f"SELECT mol_id, {r('x * 0.25', 'x_location')}, {r('500 - y * 0.25', 'y_location')} FROM mol"))
def level_pixels(spark: S, sf: str) -> DataFrame:
    return rounded(points.to_level_pixels(T.molecules(spark, sf), 0.25, 500.0, "x_location", "y_location").select("mol_id", "x_location", "y_location"))


@query("PRJ03_image_pixels", with_("mol", f"SELECT mol_id, {r('x / 1100 * 640', 'x_location')}, {r('(1000 - y) / 1000 * 480', 'y_location')} FROM mol"))
def image_pixels(spark: S, sf: str) -> DataFrame:
    return rounded(points.to_image_pixels(T.molecules(spark, sf), (0.0, 1100.0, 0.0, 1000.0), 640, 480, "x_location", "y_location").select("mol_id", "x_location", "y_location"))


@query("JN01_totals_join", with_("counts lib", f"SELECT grid_id, gene, {r('c / lib', 'per_grid')}, {r('c / tot', 'per_gene')} FROM counts JOIN lib USING (grid_id) JOIN (SELECT gene, sum(c)::DOUBLE AS tot FROM counts GROUP BY gene) USING (gene)"))
def totals(spark: S, sf: str) -> DataFrame:
    c = layer(spark, sf)[1]
    out = grids.library_share(c).join(F.broadcast(grids.gene_totals(c)), "gene")
    return rounded(out.select("grid_id", "gene", F.col("share").alias("per_grid"), (F.col("count") / F.col("total")).alias("per_gene")))


@query("JN02_grid_left_join", with_("info counts", "SELECT grid_id, coalesce(c, 0)::BIGINT AS count FROM info LEFT JOIN (SELECT * FROM counts WHERE gene = 'Brand#11') USING (grid_id)"))
def grid_left(spark: S, sf: str) -> DataFrame:
    return tables.over_tiles(*layer(spark, sf), F.col("gene") == "Brand#11")


@query("JN03_membership", with_("cell", "SELECT cell, gene, c AS count FROM cell SEMI JOIN (SELECT o_orderkey AS cell FROM orders WHERE o_orderstatus = 'O') USING (cell)"))
def membership(spark: S, sf: str) -> DataFrame:
    keep = T.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("cell"))
    return tables.members(T.cell_counts(spark, sf), keep, "cell")


ROI = [(100.0, 100.0), (900.0, 200.0), (700.0, 900.0), (400.0, 500.0), (200.0, 800.0)]
_edges = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(ROI, [*ROI[1:], ROI[0]], strict=True))
ROI_SQL = f"e(ax, ay, bx, b_y) AS (VALUES {_edges})"


@query("JN04_point_in_polygon", with_("mol", "SELECT mol_id FROM m, e GROUP BY n, mol_id HAVING sum(CASE WHEN (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AND max(CASE WHEN (bx - ax) * (y - ay) = (b_y - ay) * (x - ax) AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, b_y) AND greatest(ay, b_y) THEN 1 ELSE 0 END) = 0", "m AS (SELECT *, row_number() OVER () AS n FROM mol)", ROI_SQL))
def polygon(spark: S, sf: str) -> DataFrame:
    return points.in_ring(T.molecules(spark, sf), ROI, "x_location", "y_location").select("mol_id")


@query("JN04_points_in_cells", with_("mol ring", "SELECT mol_id, 'c' || cell_id AS label_id FROM mol m JOIN ring c ON m.x > c.x - 4 AND m.x < c.x + 4 AND m.y > c.y - 4 AND m.y < c.y + 4"))
def located(spark: S, sf: str) -> DataFrame:
    return points.locate(T.molecules(spark, sf), readers.boundaries(T.vertices(spark, sf)), 32.0, "x_location", "y_location").select("mol_id", "label_id")


for _name, _topology, _on in (("rook", "rook", "abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1"), ("queen", "queen", "abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.grid_id <> b.grid_id")):
    query(f"JN05_{_name}", with_("info", f"SELECT a.grid_id AS i, b.grid_id AS j FROM info a JOIN info b ON {_on}"))(lambda spark, sf, t=_topology: weights.neighbours(layer(spark, sf)[0], t).select("i", "j"))


def _hex_sql(by_row: bool, odd: bool) -> str:
    line, along = ("gy", "gx") if by_row else ("gx", "gy")
    pushed = f"({line} - 1) % 2 = {1 if odd else 0}"
    near = f"(b.{line} = a.{line} AND abs(b.{along} - a.{along}) = 1) OR (abs(b.{line} - a.{line}) = 1 AND b.{along} - a.{along} IN (0, CASE WHEN a.pushed THEN 1 ELSE -1 END))"
    return with_("info", f"SELECT a.grid_id AS i, b.grid_id AS j FROM h a JOIN h b ON {near}", f"h AS (SELECT *, {pushed} AS pushed FROM info)")


for _t, _row, _odd in (("hex-oddr", True, True), ("hex-evenr", True, False), ("hex-oddq", False, True), ("hex-evenq", False, False)):
    query(f"JN06_{_t.replace('-', '_')}", _hex_sql(_row, _odd))(lambda spark, sf, t=_t: weights.neighbours(layer(spark, sf)[0], t).select("i", "j"))


@query("JN07_neighbour_angles", with_("info", f"SELECT kind, {r('degrees(atan2(abs(b.center_y - a.center_y), abs(b.center_x - a.center_x)))', 'angle')}, {r('sqrt((b.center_x - a.center_x) ** 2 + (b.center_y - a.center_y) ** 2)', 'distance')} FROM info a, (VALUES ('horizontal', 1, 0), ('vertical', 0, 1), ('diagonal', 1, 1), ('diagonal', -1, 1)) AS o(kind, dx, dy) JOIN info b ON b.gx = a.gx + dx AND b.gy = a.gy + dy"))
def neighbour_angles(spark: S, sf: str) -> DataFrame:
    return rounded(weights.angles(layer(spark, sf)[0]))


FOLD_SQL = "tot AS (SELECT gene, sum(c)::DOUBLE AS total FROM counts GROUP BY gene)"


@query("JN08_gene_pairs", with_("counts", "SELECT a.gene AS gene1, b.gene AS gene2, a.total AS total1, b.total AS total2 FROM tot a JOIN tot b ON a.gene < b.gene", FOLD_SQL))
def gene_pairs(spark: S, sf: str) -> DataFrame:
    return pairs.fold_pairs(grids.gene_totals(layer(spark, sf)[1])).drop("fold")


@query("SCL06_fold_ratio", with_("counts", f"SELECT a.gene AS gene1, b.gene AS gene2, {r('greatest(a.total, b.total) / greatest(1, least(a.total, b.total))', 'fold')} FROM tot a JOIN tot b ON a.gene < b.gene", FOLD_SQL))
def folds(spark: S, sf: str) -> DataFrame:
    return rounded(pairs.fold_pairs(grids.gene_totals(layer(spark, sf)[1])).select("gene1", "gene2", "fold"))


@query("JN10_sparse_products", with_("counts", "SELECT a.gene AS gene1, b.gene AS gene2, sum(a.c * b.c)::DOUBLE AS dot FROM counts a JOIN counts b ON a.grid_id = b.grid_id AND a.gene < b.gene GROUP BY ALL"))
def products(spark: S, sf: str) -> DataFrame:
    return pairs.shared(layer(spark, sf)[1].select("grid_id", "gene", F.col("count").cast("double").alias("value")))


@query("JN11_key_alignment", with_("counts", "SELECT count(*) FILTER (WHERE a AND b) AS \"both\", count(*) FILTER (WHERE a AND NOT b) AS left_only, count(*) FILTER (WHERE b AND NOT a) AS right_only FROM (SELECT grid_id, bool_or(gene = 'Brand#11' AND c > 8) AS a, bool_or(gene = 'Brand#12' AND c > 8) AS b FROM counts GROUP BY grid_id)"))
def alignment(spark: S, sf: str) -> DataFrame:
    """Tiles of two genes' frequent counts, which differ."""
    c = layer(spark, sf)[1].where("count > 8")
    return tables.alignment(c.where("gene = 'Brand#11'"), c.where("gene = 'Brand#12'"), "grid_id")


@query("JN12_common_pairs", with_("delta", f"SELECT gene1, gene2, {r('L')}, {r('r')} FROM delta"))
def common(spark: S, sf: str) -> DataFrame:
    """The second table names its genes the other way round."""
    info, z = xz(spark, sf)
    turned = pairs.pearson(z, "grid_id", "z").select(F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2"), "r")
    return rounded(tables.common_pairs(lee_of(info, z), turned).select("gene1", "gene2", "L", "r"))


@query("JN13_barcode_alignment", with_("counts info", "SELECT grid_id, gene, c AS count, center_x FROM counts JOIN info USING (grid_id) SEMI JOIN (SELECT grid_id FROM sz WHERE n >= (SELECT quantile_cont(n, 0.5) FROM sz)) USING (grid_id)", "sz AS (SELECT grid_id, sum(c) AS n FROM counts GROUP BY grid_id)"))
def barcodes(spark: S, sf: str) -> DataFrame:
    """In-tissue tiles are those of the median library size or more."""
    info, c = layer(spark, sf)
    size = c.groupBy("grid_id").agg(F.sum("count").alias("n"))
    tissue = tables.members(info, size.crossJoin(F.broadcast(size.agg(F.percentile("n", F.lit(0.5)).alias("mid")))).where("n >= mid"), "grid_id")
    return tables.positioned(c, tissue, columns=("center_x",)).select("grid_id", "gene", "count", "center_x")


def _multi_sql() -> str:
    one = lambda lg: f"SELECT {lg}::DOUBLE AS length, (floor((x - floor(xmin / {lg}) * {lg}) / {lg}) + 1)::INT AS gx, (floor((y - floor(ymin / {lg}) * {lg}) / {lg}) + 1)::INT AS gy, gene, count(*) AS count FROM good, box GROUP BY ALL"
    return with_("box", " UNION ALL ".join(one(lg) for lg in (30, 50, 100)))


@query("AGG01_multi_size_binning", _multi_sql())
def binning(spark: S, sf: str) -> DataFrame:
    return grids.bin_points(good(spark, sf), [30.0, 50.0, 100.0]).select("length", "gx", "gy", "gene", "count")


@query("AGG02_bounds", with_("box", f"SELECT {r('xmin')}, {r('xmax')}, {r('ymin')}, {r('ymax')} FROM box"))
def bounds(spark: S, sf: str) -> DataFrame:
    return rounded(grids.bounds(good(spark, sf)))


@query("AGG03_partial_counts", with_("cnt0", "SELECT gene, sum(c)::BIGINT AS count FROM cnt0 GROUP BY gene"))
def partial(spark: S, sf: str) -> DataFrame:
    return grids.bin_points(good(spark, sf), [LENGTH]).groupBy("gene").agg(F.sum("count").alias("count"))


@query("AGG04_tile_table", with_("tile0", f"SELECT gx, gy, grid_id, {r('xmin')}, {r('xmax')}, {r('ymin')}, {r('ymax')} FROM tile0"))
def tile_table(spark: S, sf: str) -> DataFrame:
    return rounded(grids.tiles(grids.bounds(good(spark, sf)), LENGTH, keep_partial=True).select("gx", "gy", "grid_id", "xmin", "xmax", "ymin", "ymax"))


@query("AGG05_genes_per_tile", with_("counts", "SELECT grid_id, count(DISTINCT gene) AS n_genes FROM counts GROUP BY grid_id"))
def genes_per_tile(spark: S, sf: str) -> DataFrame:
    return tables.genes_a_tile(layer(spark, sf)[1])


@query("AGG06_library_size", with_("lib", "SELECT grid_id, lib FROM lib"))
def library(spark: S, sf: str) -> DataFrame:
    return grids.library_share(layer(spark, sf)[1]).select("grid_id", "lib").distinct()


@query("AGG07_prescreen", with_("counts info", f"SELECT gene, {r('count(*) / (SELECT count(*) FROM info)', 'detect')}, sum(c)::DOUBLE AS total FROM counts GROUP BY gene HAVING count(*) / (SELECT count(*) FROM info) >= 0.1 ORDER BY total DESC, gene LIMIT 10"))
def prescreen(spark: S, sf: str) -> DataFrame:
    info, c = layer(spark, sf)
    return rounded(grids.prescreen(c, info))


@query("TOP07_target_genes", with_("counts info", "SELECT gene, sum(c)::DOUBLE AS total FROM counts GROUP BY gene HAVING count(*) / (SELECT count(*) FROM info) >= 0.5 ORDER BY total DESC, gene LIMIT 5"))
def targets(spark: S, sf: str) -> DataFrame:
    info, c = layer(spark, sf)
    return grids.prescreen(c, info, 0.5, 5).select("gene", "total")


@query("AGG08_coverage_percent", with_("counts info", "SELECT gene, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM info), 3) AS pct FROM counts GROUP BY gene"))
def coverage(spark: S, sf: str) -> DataFrame:
    info, c = layer(spark, sf)
    return grids.coverage_percent(c, info)


_density = {"none": "c::DOUBLE", "per_grid": "c / lib", "global_gene": "c / tot"}
for _mode, _value in _density.items():
    query(f"AGG09_density_{_mode}", with_("counts info lib", f"SELECT grid_id, {r('coalesce(s, 0) / (width * height) * 1000', 'density')} FROM info LEFT JOIN (SELECT grid_id, sum({_value}) AS s FROM counts JOIN lib USING (grid_id) JOIN (SELECT gene, sum(c)::DOUBLE AS tot FROM counts GROUP BY gene) USING (gene) WHERE gene IN {BRANDS} GROUP BY grid_id) USING (grid_id)"))(
        lambda spark, sf, m=_mode: rounded(grids.density(*layer(spark, sf)[::-1], F.col("gene").isin(*BRANDS), m).select("grid_id", (F.col("density") * 1000).alias("density")))
    )


@query("AGG10_gene_totals", with_("counts", "SELECT gene, sum(c)::DOUBLE AS total FROM counts GROUP BY gene"))
def gene_totals(spark: S, sf: str) -> DataFrame:
    return grids.gene_totals(layer(spark, sf)[1])


@query("AGG17_module_presence", with_("counts mods", "SELECT module, count(DISTINCT grid_id) AS tiles, sum(c)::BIGINT AS total FROM counts JOIN mods USING (gene) GROUP BY module ORDER BY total DESC, module LIMIT 3"))
def presence(spark: S, sf: str) -> DataFrame:
    return tables.module_presence(layer(spark, sf)[1], modules(spark, sf), 3)


@query("WIN04_column_steps", with_("info", f"SELECT gx, {r('quantile_cont(d, 0.5)', 'step')} FROM (SELECT gx, center_y - lag(center_y) OVER (PARTITION BY gx ORDER BY center_y) AS d FROM info) WHERE d IS NOT NULL GROUP BY gx"))
def steps(spark: S, sf: str) -> DataFrame:
    return rounded(weights.cell_sizes(layer(spark, sf)[0]))


@query("WIN05_top_per_cluster", with_("counts mods info", f"SELECT gene, module, {r('d', 'idelta')}, rank::INT AS rank FROM (SELECT *, rank() OVER (PARTITION BY module ORDER BY d DESC) AS rank, count(*) OVER (PARTITION BY module) AS n FROM ({{}}) JOIN mods USING (gene)) WHERE rank <= 3 AND n >= 2".format("SELECT gene, (SELECT count(*) FROM info) * sum(c * (c - 1))::DOUBLE / (sum(c) * (sum(c) - 1)) AS d FROM counts GROUP BY gene HAVING sum(c) >= 2")))
def top_per_cluster(spark: S, sf: str) -> DataFrame:
    met = idelta(spark, sf).where("idelta is not null").join(F.broadcast(modules(spark, sf)), "gene")
    return rounded(ranking.per_group_top(met, "module", "idelta", 3, 2).select("gene", "module", "idelta", "rank"))


def idelta(spark: S, sf: str) -> DataFrame:
    info, c = layer(spark, sf)
    return pairs.idelta(c, info.agg(F.count("*").cast("double").alias("q")))


@query("WIN06_running_median", with_("counts", f"SELECT gene, {r('quantile_cont(total, 0.5) OVER (ORDER BY gene ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'smooth')} FROM tot", FOLD_SQL))
def running(spark: S, sf: str) -> DataFrame:
    return rounded(curve.running_median(grids.gene_totals(layer(spark, sf)[1]), 5, "gene", "total").select("gene", "smooth"))


@query("WIN07_quantile_strata", with_("pear", "SELECT gene1, gene2, greatest(1, len(list_filter(q, lambda v: v < r)))::INT AS stratum FROM pear, (SELECT list_distinct(quantile_cont(r, [i / 10.0 FOR i IN range(0, 11)])) AS q FROM pear)"))
def quantile_strata(spark: S, sf: str) -> DataFrame:
    return curve.strata(pear(spark, sf), 10).select("gene1", "gene2", "stratum")


@query("WIN09_first_occurrence", "SELECT l_partkey, min(l_orderkey * 8 + l_linenumber) AS mol_id, arg_min(l_suppkey, l_orderkey * 8 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def first_occurrence(spark: S, sf: str) -> DataFrame:
    """Of line items that share a number, the first by its place in the files."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = T.table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mol_id"), "l_suppkey", *place)
    return tables.first_of(rows, "l_partkey", "mol_id", ("file", "row"), known=True)


@query("TOP03_variable_genes", with_("xz share", "SELECT gene, round(var_samp(coalesce(s, 0)) * 1000, 6) + 0.0 AS variance FROM (SELECT DISTINCT grid_id, gene FROM xz) LEFT JOIN share USING (grid_id, gene) GROUP BY gene ORDER BY var_samp(coalesce(s, 0)) DESC, gene LIMIT 10"))
def variable(spark: S, sf: str) -> DataFrame:
    info, c = layer(spark, sf)
    m = grids.gene_moments(grids.library_share(c), info).select("gene", (F.col("sd") * F.col("sd") * 1000).alias("variance"))
    return rounded(ranking.top_genes(m, "variance", 10))


@query("TOP04_genes_by_bins", with_("counts", "SELECT gene, count(DISTINCT grid_id) AS n FROM counts GROUP BY gene HAVING count(DISTINCT grid_id) >= 8 ORDER BY n DESC, gene LIMIT 60"))
def by_bins(spark: S, sf: str) -> DataFrame:
    return ranking.top_genes(layer(spark, sf)[1].groupBy("gene").agg(F.count_distinct("grid_id").alias("n")).where("n >= 8"), "n", 60)


@query("SET01_union_with_fill", "SELECT 'cell' AS kind, c_custkey AS id, c_nationkey::INT AS nation, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT 'part', p_partkey, NULL, p_brand FROM part")
def union_fill(spark: S, sf: str) -> DataFrame:
    a = T.table(spark, sf, "customer").select(F.lit("cell").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("int").alias("nation"))
    b = T.table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return tables.stacked([a, b])


_sizes = lambda spark, sf, cond: T.table(spark, sf, "part").where(cond).select(F.col("p_brand").alias("gene"))
query("SET02_common_genes", "SELECT p_brand AS gene FROM part WHERE p_size < 5 INTERSECT SELECT p_brand FROM part WHERE p_size > 48")(lambda spark, sf: tables.common([_sizes(spark, sf, "p_size < 5"), _sizes(spark, sf, "p_size > 48")]))
query("SET03_missing_genes", "SELECT DISTINCT p_brand AS gene FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)")(lambda spark, sf: tables.missing(_sizes(spark, sf, "true"), _sizes(spark, sf, "p_size = 50")))
query("SET04_union_distinct", "SELECT p_brand AS gene FROM part WHERE p_size < 5 UNION SELECT p_brand FROM part WHERE p_size > 48")(lambda spark, sf: tables.either([_sizes(spark, sf, "p_size < 5"), _sizes(spark, sf, "p_size > 48")]))


@query("SCL01_log_cpm", with_("cell", f"SELECT cell, gene, {r('ln(1 + c / sum(c) OVER (PARTITION BY cell) * 1e4)', 'value')} FROM cell"))
def log_cpm(spark: S, sf: str) -> DataFrame:
    return rounded(grids.log_cpm(T.cell_counts(spark, sf)).select("cell", "gene", "value"))


@query("SCL07_winsorised", with_("xz", f"SELECT grid_id, gene, {r('least(z, top)', 'z')} FROM xz JOIN (SELECT gene, quantile_cont(z, 0.95) AS top FROM xz GROUP BY gene) USING (gene)"))
def winsorised(spark: S, sf: str) -> DataFrame:
    return rounded(grids.winsorise(xz(spark, sf)[1], 0.95).select("grid_id", "gene", "z"))


@query("SCL08_block_ids", with_("info", "SELECT grid_id, dense_rank() OVER (ORDER BY (gx - 1) // 4, (gy - 1) // 4)::INT AS block FROM info".replace("// 4", "/ 4").replace("(gx - 1) / 4", "floor((gx - 1) / 4)").replace("(gy - 1) / 4", "floor((gy - 1) / 4)")))
def blocks(spark: S, sf: str) -> DataFrame:
    return grids.block_ids(layer(spark, sf)[0], 4).select("grid_id", "block")


@query("SMP01_downsample", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {md5_sql('(l_orderkey * 8 + l_linenumber)::VARCHAR')} / 4294967296.0 < 0.1")
def sample(spark: S, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"))
    return inference.downsample(rows, "key", 0.1).drop("key")
