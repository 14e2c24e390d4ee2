"""Queries of normalisation, weights, Lee's L, correlation, inference, similarity, curves and rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import beta_interval, signed_z, t_p_value
from ..operators import curve, grids, inference, pairs, ranking, tables, weights
from ..sources import tables as T
from ..storage import stored
from .basic import BH_SQL, P_SQL, delta, idelta, lee, lee_of, modules, pear, with_p
from .registry import layer, md5_int, md5_sql, query, r, rounded, with_, xz

S = SparkSession


@query("NRM01_normalised", with_("xz", f"SELECT grid_id, gene, {r('z')} FROM xz"))
def normalised(spark: S, sf: str) -> DataFrame:
    return rounded(xz(spark, sf)[1])


def edges_of(spark: S, sf: str, **kw) -> DataFrame:
    return weights.weights(layer(spark, sf)[0], **kw)


WN = "wn AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w)"


@query("WGT01_row_normalised", with_("w", f"SELECT i, j, {r('w')} FROM wn", WN))
def weights_w(spark: S, sf: str) -> DataFrame:
    return rounded(edges_of(spark, sf, style="W").select("i", "j", "w"))


@query("WGT02_active_tiles", with_("w info", "SELECT i, count(*) AS degree FROM w GROUP BY i"))
def active(spark: S, sf: str) -> DataFrame:
    return edges_of(spark, sf).groupBy("i").agg(F.count("*").alias("degree"))


@query("WGT03_binary", with_("w", "SELECT i, j, w FROM w"))
def binary(spark: S, sf: str) -> DataFrame:
    return edges_of(spark, sf).select("i", "j", "w")


KERNEL = "k AS (SELECT a.grid_id AS i, b.grid_id AS j, exp(-((a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2) / 2.0) AS w FROM info a JOIN info b ON {on} AND a.grid_id <> b.grid_id)"
for _t, _on in (("queen", "abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2"), ("rook", "abs(a.gx - b.gx) + abs(a.gy - b.gy) <= 2")):
    query(f"WGT04_kernel_{_t}", with_("info", f"SELECT i, j, {r('w / sum(w) OVER (PARTITION BY i)', 'w')} FROM k", KERNEL.format(on=_on)))(lambda spark, sf, t=_t: rounded(edges_of(spark, sf, style="kernel_gaussian", topology=t).select("i", "j", "w")))


def _hex_kernel(by_row: bool) -> str:
    line, along = ("gy", "gx") if by_row else ("gx", "gy")
    cube = f"h AS (SELECT grid_id, {along} - floor(({line} - ({line} - 1) % 2) / 2)::INT AS q, {line} AS s FROM info)"
    dist = "d AS (SELECT a.grid_id AS i, b.grid_id AS j, greatest(abs(a.q - b.q), abs(a.s - b.s), abs(a.q + a.s - b.q - b.s)) AS d FROM h a JOIN h b ON a.grid_id <> b.grid_id)"
    return with_("info", f"SELECT i, j, {r('w / sum(w) OVER (PARTITION BY i)', 'w')} FROM (SELECT i, j, exp(-d * d / 2.0) AS w FROM d WHERE d <= 2)", cube, dist)


query("WGT05_kernel_hex_rows", _hex_kernel(True))(lambda spark, sf: rounded(edges_of(spark, sf, style="kernel_gaussian", topology="hex-oddr").select("i", "j", "w")))
query("WGT06_kernel_hex_columns", _hex_kernel(False))(lambda spark, sf: rounded(edges_of(spark, sf, style="kernel_gaussian", topology="hex-oddq").select("i", "j", "w")))


@query("WGT07_second_order", with_("w", "SELECT DISTINCT i, j FROM (SELECT i, j FROM w UNION ALL SELECT a.i, b.j FROM w a JOIN w b ON a.j = b.i WHERE a.i <> b.j)"))
def second_order(spark: S, sf: str) -> DataFrame:
    return edges_of(spark, sf, order=2).select("i", "j")


_steps = [f"o{n} AS (SELECT DISTINCT i, j FROM (SELECT i, j FROM o{n - 1} UNION ALL SELECT a.i, b.j FROM o{n - 1} a JOIN o1 b ON a.j = b.i WHERE a.i <> b.j))" for n in (2, 3, 4)]


@query("WGT07_expanded", with_("info", "SELECT i, j FROM oo, (SELECT coalesce(min(k) FILTER (WHERE m >= 6.0 * (SELECT count(*) FROM info)), 4) AS least FROM (SELECT k, count(*) AS m FROM oo GROUP BY k)) WHERE k = least", "o1 AS (SELECT a.grid_id AS i, b.grid_id AS j FROM info a JOIN info b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1)", *_steps, "oo AS (SELECT 1 AS k, * FROM o1 UNION ALL SELECT 2, * FROM o2 UNION ALL SELECT 3, * FROM o3 UNION ALL SELECT 4, * FROM o4)"))
def expanded(spark: S, sf: str) -> DataFrame:
    return weights.expanded(layer(spark, sf)[0], "rook", 6.0)[0]


@query("WGT08_hex_evidence", with_("info", f"SELECT {r('avg(CASE WHEN abs(t - 60) <= 10 OR abs(t - 120) <= 10 THEN 1.0 ELSE 0 END)', 'hex_share')}, {r('avg(CASE WHEN abs(t) <= 10 THEN 1.0 ELSE 0 END)', 'horizontal_share')}, {r('avg(CASE WHEN abs(t - 90) <= 10 THEN 1.0 ELSE 0 END)', 'vertical_share')}, {r(chr(97) + 'vg(d) FILTER (WHERE kind = 1) / avg(d) FILTER (WHERE kind = 0)', 'ratio')} FROM (SELECT kind, degrees(atan2(abs(b.center_y - a.center_y), abs(b.center_x - a.center_x))) AS t, sqrt((b.center_x - a.center_x) ** 2 + (b.center_y - a.center_y) ** 2) AS d FROM info a, (VALUES (0, 1, 0), (0, 0, 1), (1, 1, 1), (1, -1, 1)) AS o(kind, dx, dy) JOIN info b ON b.gx = a.gx + dx AND b.gy = a.gy + dy)"))
def evidence(spark: S, sf: str) -> DataFrame:
    return rounded(weights.hex_evidence(layer(spark, sf)[0]))


CHECKED = "ck AS (SELECT 'binary' AS kind, i, w FROM w UNION ALL SELECT 'rows', i, w FROM wn UNION ALL SELECT 'faulty', i, CASE WHEN i = j_ THEN 'NaN'::DOUBLE ELSE 2 * w END FROM wn, (SELECT min(i) AS j_ FROM w))"


@query("WGT09_verification", with_("w", "SELECT kind, sum(n)::BIGINT AS edges, bool_and(f) AS finite, bool_and(z) AS \"binary\", bool_and(abs(s - 1) <= 1e-9 OR abs(s) <= 1e-9) AS rows_sum_to_one FROM (SELECT kind, i, sum(w) AS s, count(*) AS n, bool_and(isfinite(w)) AS f, bool_and(w IN (0.0, 1.0)) AS z FROM ck GROUP BY kind, i) GROUP BY kind", WN, CHECKED))
def verification(spark: S, sf: str) -> DataFrame:
    """Of binary weights, row-normalised ones, and such with weights that aren't numbers and sums that aren't 1."""
    edges = stored(edges_of(spark, sf, style="W"))
    least = edges.agg(F.min("i").alias("least"))
    faulty = edges.crossJoin(F.broadcast(least)).select("i", "j", F.when(F.col("i") == F.col("least"), F.lit(float("nan"))).otherwise(2 * F.col("w")).alias("w"))
    every = {"binary": edges_of(spark, sf), "rows": edges, "faulty": faulty}
    return tables.stacked([weights.check_weights(e, 1e-9).withColumn("kind", F.lit(k)) for k, e in every.items()])


@query("WGT10_lattice_check", with_("info", "SELECT count(*) AS tiles, sum((p > 1)::INT)::BIGINT AS repeated_places, sum((n > 1 OR grid_id IS NULL OR grid_id = '')::INT)::BIGINT AS bad_names, sum((gx < 1 OR gy < 1)::INT)::BIGINT AS out_of_range FROM (SELECT *, count(*) OVER (PARTITION BY gx, gy) AS p, count(*) OVER (PARTITION BY grid_id) AS n FROM fl)", "fl AS (SELECT gx, gy, grid_id FROM info UNION ALL SELECT gx, gy, grid_id || 'b' FROM info WHERE gx = 1 UNION ALL SELECT gx - 3, gy + 1000, CASE WHEN gy % 2 = 0 THEN NULL ELSE grid_id END FROM info WHERE gx <= 3)"))
def lattice(spark: S, sf: str) -> DataFrame:
    """With tiles that share a place, that lack or share a name, and that lie off the lattice."""
    info = layer(spark, sf)[0].select("gx", "gy", "grid_id")
    twice = info.where("gx = 1").select("gx", "gy", F.concat("grid_id", F.lit("b")).alias("grid_id"))
    off = info.where("gx <= 3").select((F.col("gx") - 3).alias("gx"), (F.col("gy") + 1000).alias("gy"), F.when(F.col("gy") % 2 == 0, F.lit(None)).otherwise(F.col("grid_id")).alias("grid_id"))
    return weights.check_lattice(tables.stacked([info, twice, off]))


PRESENT = "v AS (SELECT grid_id AS i, gene, least(1.0, c / 20.0) AS value FROM counts)"


def presence(spark: S, sf: str) -> DataFrame:
    return layer(spark, sf)[1].select(F.col("grid_id").alias("i"), "gene", F.least(F.lit(1.0), F.col("count") / 20.0).alias("value"))


@query("WGT11_fuzzy_diffusion", with_("counts w", f"SELECT i, gene, {r('greatest(0.0, least(1.0, sum(value)))', 'value')} FROM (SELECT * FROM v UNION ALL SELECT w.i, gene, 0.5 * w.w * value FROM wn w JOIN v ON v.i = w.j) GROUP BY i, gene", WN, PRESENT))
def diffusion(spark: S, sf: str) -> DataFrame:
    return rounded(weights.diffuse(presence(spark, sf), edges_of(spark, sf, style="W")))


@query("WGT11_fuzzy_jaccard", with_("counts", f"SELECT a.gene AS gene1, b.gene AS gene2, {r('sum(least(a.value, b.value)) / (t.s + u.s - sum(least(a.value, b.value)))', 'jaccard')} FROM v a JOIN v b ON a.i = b.i AND a.gene < b.gene JOIN (SELECT gene, sum(value) AS s FROM v GROUP BY gene) t ON t.gene = a.gene JOIN (SELECT gene, sum(value) AS s FROM v GROUP BY gene) u ON u.gene = b.gene GROUP BY a.gene, b.gene, t.s, u.s", PRESENT))
def fuzzy(spark: S, sf: str) -> DataFrame:
    return rounded(weights.fuzzy_jaccard(presence(spark, sf)))


@query("AGG16_row_sums", with_("w", f"SELECT i, {r('sum(w)', 's')} FROM wn GROUP BY i", WN))
def row_sums(spark: S, sf: str) -> DataFrame:
    return rounded(edges_of(spark, sf, style="W").groupBy("i").agg(F.sum("w").alias("s")))


@query("LAG01_spatial_lag", with_("lag", f"SELECT grid_id, gene, {r('lag')} FROM lag"))
def lag(spark: S, sf: str) -> DataFrame:
    info, z = xz(spark, sf)
    return rounded(pairs.spatial_lag(z, weights.weights(info)))


LEE = with_("lee", f"SELECT gene1, gene2, {r('L')} FROM lee")


@query("LEE01_lees_l", LEE)
def lees(spark: S, sf: str) -> DataFrame:
    return rounded(lee(spark, sf))


@query("LEE01_lees_l_dense", LEE)
def lees_dense(spark: S, sf: str) -> DataFrame:
    info, z = xz(spark, sf)
    return rounded(pairs.lees_l(z, weights.weights(info), info, dense=True))


def wide_panel(sql: str) -> str:
    """The same of the larger panel, whose genes are brands by type."""
    return sql.replace("p_brand AS gene", "p_brand || '/' || p_type AS gene")


@query("LEE01_lees_l_150_genes", wide_panel(LEE))
def lees_150(spark: S, sf: str) -> DataFrame:
    info, z = xz(spark, sf, "type")
    return rounded(pairs.lees_l(z, stored(weights.weights(info)), info, dense=True))


@query("LEE02_selected_columns", with_("lee", f"SELECT gene1, gene2, {r('L')} FROM lee WHERE gene1 IN ('Brand#11', 'Brand#35') OR gene2 IN ('Brand#11', 'Brand#35')"))
def lees_columns(spark: S, sf: str) -> DataFrame:
    info, z = xz(spark, sf)
    return rounded(pairs.lees_l(z, weights.weights(info), info, genes=["Brand#11", "Brand#35"]))


@query("LEE03_layer_validation", with_("xz", "SELECT gene, bool_and(isfinite(z)) AS finite, bool_and(isfinite(z)) AND (sqrt(avg(z * z)) = 0 OR abs(avg(z)) <= 1e-7 * sqrt(avg(z * z))) AS centred FROM (SELECT gene, CASE WHEN gene = 'Brand#12' AND grid_id = 'g1_1' THEN 'NaN'::DOUBLE WHEN gene LIKE 'Brand#2%' THEN z + 0.001::DOUBLE ELSE z END AS z FROM xz) GROUP BY gene"))
def centred(spark: S, sf: str) -> DataFrame:
    """A layer with a value that isn't a number, and columns that are off their mean."""
    z = F.when((F.col("gene") == "Brand#12") & (F.col("grid_id") == "g1_1"), F.lit(float("nan"))).when(F.col("gene").startswith("Brand#2"), F.col("z") + 0.001).otherwise(F.col("z"))
    return pairs.centring(xz(spark, sf)[1].withColumn("z", z))


@query("LEE04_projection_candidates")
def projections(spark: S, sf: str) -> DataFrame:
    return pairs.candidates(pairs.sign_bits(xz(spark, sf)[1], "grid_id", "z", 6, 8))


@query("TOP05_top_partners", with_("lee", f"SELECT gene, partner, {r('L')}, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY L DESC, partner) AS rank FROM (SELECT gene1 AS gene, gene2 AS partner, L FROM lee UNION ALL SELECT gene2, gene1, L FROM lee)) WHERE rank <= 3"))
def partners(spark: S, sf: str) -> DataFrame:
    return rounded(pairs.top_partners(lee(spark, sf).select("gene1", "gene2", "L"), 3, "L"))


@query("GRD01_plane_slopes", with_("xz info", f"SELECT gene, {r('(xv * yy - yv * xy) / (xx * yy - xy * xy) * 1000', 'slope_x')}, {r('(yv * xx - xv * xy) / (xx * yy - xy * xy) * 1000', 'slope_y')} FROM (SELECT gene, var_pop(center_x) AS xx, var_pop(center_y) AS yy, covar_pop(center_x, center_y) AS xy, covar_pop(center_x, z) AS xv, covar_pop(center_y, z) AS yv FROM xz JOIN info USING (grid_id) GROUP BY gene)"))
def slopes(spark: S, sf: str) -> DataFrame:
    info, z = xz(spark, sf)
    return rounded(pairs.plane_slopes(z, info).select("gene", (F.col("slope_x") * 1000).alias("slope_x"), (F.col("slope_y") * 1000).alias("slope_y")))


@query("COR01_pearson_grid", with_("pear", f"SELECT gene1, gene2, {r('r')} FROM pear"))
def pearson_grid(spark: S, sf: str) -> DataFrame:
    return rounded(pear(spark, sf))


@query("COR01_pearson_sparse_cells", with_("cell", f"SELECT a.gene AS gene1, b.gene AS gene2, {r('(coalesce(d, 0) - a.s * b.s / n) / sqrt((a.q - a.s * a.s / n) * (b.q - b.s * b.s / n))', 'r')} FROM g a JOIN g b ON a.gene < b.gene LEFT JOIN (SELECT x.gene AS g1, y.gene AS g2, sum(x.c * y.c) AS d FROM cell x JOIN cell y ON x.cell = y.cell AND x.gene < y.gene GROUP BY ALL) ON g1 = a.gene AND g2 = b.gene, (SELECT count(DISTINCT cell)::DOUBLE AS n FROM cell)", "g AS (SELECT gene, sum(c) AS s, sum(c * c) AS q FROM cell GROUP BY gene)"))
def pearson_cells(spark: S, sf: str) -> DataFrame:
    return rounded(pairs.pearson(T.cell_counts(spark, sf).withColumnRenamed("count", "value"), "cell"))


EX_R = "SELECT a.gene AS gene1, b.gene AS gene2, corr(a.v, b.v) AS r FROM {0} a JOIN {0} b ON a.sample = b.sample AND a.gene < b.gene GROUP BY a.gene, b.gene"


@query("COR01_pearson_dense", with_("ex", f"SELECT gene1, gene2, {r('r')} FROM ({EX_R.format('ex')})"))
def pearson_dense(spark: S, sf: str) -> DataFrame:
    return rounded(pairs.pearson(T.expression(spark, sf), "sample", dense=True))


#: t of a correlation over all n units; its two-sided p from the closed forms that whole degrees of freedom have, by Abramowitz and
#: Stegun 26.7.3 (odd) and 26.7.4 (even): sums of products of (2i - 1) / 2i or 2i / (2i + 1).
def t_sql(source: str, n: str) -> tuple[str, ...]:
    clipped = "greatest(-0.9999, least(0.9999, r))"
    return (
        f"nn AS ({n})", f"tt AS (SELECT gene1, gene2, r, nu, {clipped} * sqrt(nu / (1 - {clipped} ** 2)) AS t FROM {source}, (SELECT n - 2 AS nu FROM nn))",
        "co AS (SELECT 0 AS j, 1.0::DOUBLE AS even, 1.0::DOUBLE AS odd UNION ALL SELECT i, exp(sum(ln((2 * i - 1) / (2.0 * i))) OVER (ORDER BY i)), exp(sum(ln((2.0 * i) / (2 * i + 1))) OVER (ORDER BY i)) FROM nn, range(1, (n // 2)::BIGINT) AS t(i))",
        "an AS (SELECT gene1, gene2, nu, atan(abs(t) / sqrt(nu)) AS th FROM tt)",
        "pt AS (SELECT gene1, gene2, CASE WHEN nu % 2 = 0 THEN 1 - sin(th) * sum(CASE WHEN j <= (nu - 2) / 2 THEN even * cos(th) ** (2 * j) ELSE 0 END) WHEN nu = 1 THEN 1 - 2 * th / pi() ELSE 1 - 2 / pi() * (th + sin(th) * sum(CASE WHEN j <= (nu - 3) / 2 THEN odd * cos(th) ** (2 * j + 1) ELSE 0 END)) END AS p FROM an, co GROUP BY gene1, gene2, nu, th)",
    )


EX_N = "SELECT count(DISTINCT sample) AS n FROM ex"


def correlation_t(spark: S, sf: str) -> DataFrame:
    x = T.expression(spark, sf)
    return pairs.t_statistics(pairs.pearson(x, "sample", dense=True), x.select("sample").distinct().count())


@query("COR02_t_statistics", with_("ex", f"SELECT gene1, gene2, {r('t')}, nu::INT AS df FROM tt", f"rr AS ({EX_R.format('ex')})", *t_sql("rr", EX_N)[:2]))
def t_values(spark: S, sf: str) -> DataFrame:
    return rounded(correlation_t(spark, sf).select("gene1", "gene2", "t", "df"))


@query("COR02_correlation_fdr", with_("ex", f"SELECT gene1, gene2, {r('p')}, {r('least(1.0, min(p * m / k) OVER (ORDER BY p DESC))', 'fdr')} FROM (SELECT *, count(*) OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM pt)", f"rr AS ({EX_R.format('ex')})", *t_sql("rr", EX_N)))
def correlation_fdr(spark: S, sf: str) -> DataFrame:
    t = correlation_t(spark, sf)
    return rounded(inference.adjusted(t.withColumn("p", t_p_value(F.col("t"), F.col("df")))).select("gene1", "gene2", "p", "fdr"))


KENDALL = "SELECT gene1, gene2, round(tau, 6) + 0.0 AS r FROM (SELECT a.gene AS gene1, b.gene AS gene2, sum(sign(a.v - c.v) * sign(b.v - d.v)) / sqrt(sum(abs(sign(a.v - c.v))) * sum(abs(sign(b.v - d.v)))) AS tau FROM full_ a JOIN full_ b ON a.sample = b.sample AND a.gene < b.gene JOIN full_ c ON c.gene = a.gene AND c.sample > a.sample JOIN full_ d ON d.gene = b.gene AND d.sample = c.sample GROUP BY a.gene, b.gene)"


@query("COR03_spearman", with_("ex", f"SELECT gene1, gene2, {r('r')} FROM ({EX_R.format('rk')})", "rk AS (SELECT sample, gene, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS v FROM ex)"))
def spearman(spark: S, sf: str) -> DataFrame:
    return rounded(pairs.spearman(T.expression(spark, sf), "sample"))


@query("WIN01_bh", with_("lee", f"SELECT gene1, gene2, p, {r('fdr')} FROM bh", P_SQL, BH_SQL))
def bh(spark: S, sf: str) -> DataFrame:
    return rounded(inference.adjusted(with_p(spark, sf)).select("gene1", "gene2", "p", "fdr"))


_raw = "raw AS (SELECT *, min(p * 1000 / k) OVER (ORDER BY p DESC) AS q FROM (SELECT *, count(*) OVER (ORDER BY p) AS k FROM pv))"
_harmonic = "(SELECT sum(1.0 / i) FROM range(1, 1001) AS t(i))"
for _m, _sql in (("BH", "least(1.0, q)"), ("BY", f"least(1.0, q * {_harmonic})"), ("bonferroni", "least(1.0, p * 1000)")):
    query(f"WIN02_universe_{_m}", with_("lee", f"SELECT gene1, gene2, {r(_sql, 'fdr')} FROM raw", P_SQL, _raw))(lambda spark, sf, m=_m: rounded(inference.adjusted(with_p(spark, sf), "p", m, 1000).select("gene1", "gene2", "fdr")))


@query("WIN03_storey", with_("lee", f"SELECT gene1, gene2, {r('least(1.0, fdr * pi0)', 'q')} FROM bh, (SELECT CASE WHEN x > 0 THEN least(1.0, x) ELSE 1.0 END AS pi0 FROM (SELECT min(m) AS x FROM (SELECT j, avg(CASE WHEN p > 0.5::DOUBLE + 0.05::DOUBLE * j THEN 1.0 ELSE 0.0 END) / (1 - 0.5::DOUBLE - 0.05::DOUBLE * j) AS m FROM pv, range(0, 10) AS t(j) GROUP BY j)))", "pv AS (SELECT gene1, gene2, L, (" + md5_sql("gene1", "gene2") + " % 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS p FROM lee)", BH_SQL))
def storey(spark: S, sf: str) -> DataFrame:
    return rounded(inference.storey(with_p(spark, sf).withColumn("p", (md5_int("gene1", "gene2") % 100 + 0.5) / 100.0)).select("gene1", "gene2", "q"))


K_SQL = f"kv AS (SELECT gene1, gene2, {md5_sql('gene1', 'gene2')} % 100 AS k, {md5_sql('gene2', 'gene1')} / 4294967296.0 AS u FROM lee)"


@query("SCL02_signed_z")
def signed(spark: S, sf: str) -> DataFrame:
    p = with_p(spark, sf)
    return rounded(p.select("gene1", "gene2", "L", "p", signed_z(F.col("L"), F.col("p")).alias("z")))


@query("SCL03_t_p_values", with_("pear info", f"SELECT gene1, gene2, {r('p')} FROM pt", *t_sql("pear", "SELECT count(*) AS n FROM info")))
def t_p(spark: S, sf: str) -> DataFrame:
    info, z = xz(spark, sf)
    t = pairs.t_statistics(pairs.pearson(z, "grid_id", "z"), info.count())
    return rounded(t.select("gene1", "gene2", t_p_value(F.col("t"), F.col("df")).alias("p")))


@query("SCL04_p_modes", with_("lee", f"SELECT gene1, gene2, {r('(k + 1) / 100.0', 'exact')}, {r('(k + 1) / 101.0', 'beta')}, {r('(k + 0.5) / 100.0', 'mid')}, {r('(k + u) / 100.0', 'uniform')} FROM kv", K_SQL))
def p_modes(spark: S, sf: str) -> DataFrame:
    k = lee(spark, sf).select("gene1", "gene2", (md5_int("gene1", "gene2") % 100).alias("k"))
    u = inference.uniform("gene2", "gene1")
    return rounded(k.select("gene1", "gene2", *[inference.p_value(F.col("k"), 99, m, u).alias(m) for m in ("exact", "beta", "mid", "uniform")]))


@query("SCL05_p_errors", with_("lee", f"SELECT gene1, gene2, {r('sqrt((k + 1) / 100.0 * (1 - (k + 1) / 100.0) / 99)', 'se')} FROM kv", K_SQL))
def p_errors(spark: S, sf: str) -> DataFrame:
    k = lee(spark, sf).select("gene1", "gene2", inference.p_value(md5_int("gene1", "gene2") % 100, 99, "exact").alias("p"))
    return rounded(k.select("gene1", "gene2", inference.p_error(F.col("p"), 99).alias("se")))


@query("SCL05_p_intervals")
def p_intervals(spark: S, sf: str) -> DataFrame:
    k = lee(spark, sf).select("gene1", "gene2", (md5_int("gene1", "gene2") % 100).alias("k"))
    lo, hi = beta_interval(F.col("k"), F.lit(99))
    return rounded(k.withColumns({"lo": lo, "hi": hi}))


@query("IDX01_idelta", with_("counts info", f"SELECT gene, CASE WHEN sum(c) >= 2 THEN round((SELECT count(*) FROM info) * sum(c * (c - 1))::DOUBLE / (sum(c) * (sum(c) - 1)), 6) + 0.0 END AS idelta FROM counts GROUP BY gene"))
def idelta_query(spark: S, sf: str) -> DataFrame:
    return rounded(idelta(spark, sf))


MH = "a AS (SELECT gene, sum(x) AS n, sum(x * x) AS q, sum((x = 2)::INT) AS f2 FROM v GROUP BY gene), mh AS (SELECT gene1, gene2, CASE WHEN den > 0 THEN 2 * coalesce(dot, 0) / den ELSE 0 END AS m FROM (SELECT g.gene1, g.gene2, dot, (CASE WHEN la = 0 AND lb = 0 THEN a.q / (a.n * a.n) + b.q / (b.n * b.n) ELSE la + lb END) * a.n * b.n AS den FROM graph g JOIN {l} a ON a.gene = g.gene1 JOIN {m} b ON b.gene = g.gene2 LEFT JOIN (SELECT x.gene AS g1, y.gene AS g2, sum(x.x * y.x) AS dot FROM v x JOIN v y ON x.grid_id = y.grid_id AND x.gene < y.gene GROUP BY ALL) ON g1 = g.gene1 AND g2 = g.gene2))"


def _mh_sql(chao: bool, counts: bool = False) -> str:
    raw = "(q - n * (n - 1) * (1 - CASE WHEN n > 1 THEN 2.0 * f2 / (n * (n - 1)) ELSE 0 END)) / (n * n)" if chao else "q / (n * n)"
    lam = f"(SELECT *, greatest({raw}, 0) AS {{0}} FROM a)"
    scale = "CASE WHEN t < 0.001 THEN 1000 WHEN t < 0.01 THEN 100 WHEN t < 0.1 THEN 10 ELSE 1 END"
    return with_("graph counts info", f"SELECT gene1, gene2, {r(f'm * {scale}', 'mh')} FROM mh, (SELECT max(m) AS t FROM mh)", f"v AS (SELECT grid_id, gene, {'c::DOUBLE' if counts else 'c / (width * height)'} AS x FROM counts JOIN info USING (grid_id))", MH.format(l=lam.format("la"), m=lam.format("lb")))


def mh(spark: S, sf: str, chao: bool, counts: bool = False) -> DataFrame:
    info, c = layer(spark, sf)
    value = c.join(info, "grid_id").select("grid_id", "gene", (F.col("count").cast("double") if counts else F.col("count") / (F.col("width") * F.col("height"))).alias("value"))
    z = stored(grids.normalise(c, info))
    return pairs.morisita_horn(value, lee_of(info, z).where("L > 0"), chao)


query("SIM01_morisita_horn", _mh_sql(False))(lambda spark, sf: rounded(mh(spark, sf, False)))
query("SIM01_morisita_horn_chao", _mh_sql(True))(lambda spark, sf: rounded(mh(spark, sf, True)))
query("SIM01_morisita_horn_chao_counts", _mh_sql(True, True))(lambda spark, sf: rounded(mh(spark, sf, True, True)))


JAC = "j AS (SELECT a.gene AS gene1, b.gene AS gene2, coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)) AS jaccard FROM n a JOIN n b ON a.gene < b.gene LEFT JOIN (SELECT x.gene AS g1, y.gene AS g2, count(*) AS k FROM t x JOIN t y ON x.grid_id = y.grid_id AND x.gene < y.gene GROUP BY ALL) ON g1 = a.gene AND g2 = b.gene)"
JACS = ("t AS (SELECT DISTINCT grid_id, gene FROM counts WHERE c > 3)", "n AS (SELECT gene, count(*)::DOUBLE AS n FROM t GROUP BY gene HAVING count(*) >= 8 ORDER BY n DESC, gene LIMIT 60)", JAC)


def jaccard(spark: S, sf: str) -> DataFrame:
    return pairs.jaccard(layer(spark, sf)[1].where("count > 3"))


@query("SIM02_jaccard", with_("counts", f"SELECT gene1, gene2, {r('jaccard')} FROM j", *JACS))
def jaccard_query(spark: S, sf: str) -> DataFrame:
    return rounded(jaccard(spark, sf))


MODD = "d AS (SELECT grid_id, 'm' || module AS gene, sum(c) / 10000.0::DOUBLE AS v FROM counts JOIN mods USING (gene) GROUP BY ALL)"


def module_density(spark: S, sf: str) -> DataFrame:
    met = layer(spark, sf)[1].join(F.broadcast(modules(spark, sf)), "gene")
    return met.groupBy("grid_id", F.concat(F.lit("m"), "module").alias("gene")).agg((F.sum("count") / 10000.0).alias("value"))


@query("SIM03_module_cosine", with_("counts mods", f"SELECT a.gene AS gene1, b.gene AS gene2, {r('sum(a.v * b.v) / sqrt(p.q * q.q)', 'similarity')} FROM d a JOIN d b ON a.grid_id = b.grid_id AND a.gene < b.gene JOIN (SELECT gene, sum(v * v) AS q FROM d GROUP BY gene) p ON p.gene = a.gene JOIN (SELECT gene, sum(v * v) AS q FROM d GROUP BY gene) q ON q.gene = b.gene GROUP BY a.gene, b.gene, p.q, q.q", MODD))
def module_cosine(spark: S, sf: str) -> DataFrame:
    return rounded(pairs.module_similarity(module_density(spark, sf), "cosine"))


FULL = "full_ AS (SELECT u.grid_id AS sample, m.gene, coalesce(v, 0) AS v FROM (SELECT DISTINCT grid_id FROM d) u CROSS JOIN (SELECT DISTINCT gene FROM d) m LEFT JOIN d ON d.grid_id = u.grid_id AND d.gene = m.gene)"
RANKED = "rk AS (SELECT sample, gene, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS v FROM full_)"
_module_sql = {
    "pearson": with_("counts mods", f"SELECT gene1, gene2, {r('r', 'similarity')} FROM ({EX_R.format('full_')})", MODD, FULL),
    "spearman": with_("counts mods", f"SELECT gene1, gene2, {r('r', 'similarity')} FROM ({EX_R.format('rk')})", MODD, FULL, RANKED),
    "jaccard": with_("counts mods", f"SELECT a.gene AS gene1, b.gene AS gene2, {r('sum(CASE WHEN a.v > 0 AND b.v > 0 THEN 1 ELSE 0 END) / sum(CASE WHEN a.v > 0 OR b.v > 0 THEN 1 ELSE 0 END)', 'similarity')} FROM full_ a JOIN full_ b ON a.sample = b.sample AND a.gene < b.gene GROUP BY a.gene, b.gene", MODD, FULL),
}
_module_sql["kendall"] = with_("counts mods", KENDALL.replace("AS r FROM", "AS similarity FROM"), MODD, FULL)
for _m, _sql in _module_sql.items():
    query(f"SIM03_module_{_m}", _sql)(lambda spark, sf, m=_m: rounded(pairs.module_similarity(module_density(spark, sf), m)))


AGG13 = "wb AS (SELECT gene, module, avg(v) FILTER (WHERE same) AS within, avg(v) FILTER (WHERE NOT same) AS between_, count(*) FILTER (WHERE same) AS n_within, count(*) FILTER (WHERE NOT same) AS n_between FROM (SELECT p.gene, m.module, o.module = m.module AS same, v FROM (SELECT gene1 AS gene, gene2 AS other, jaccard AS v FROM j UNION ALL SELECT gene2, gene1, jaccard FROM j) p JOIN mods m ON m.gene = p.gene JOIN mods o ON o.gene = p.other) GROUP BY gene, module HAVING count(*) FILTER (WHERE same) >= 1 AND count(*) FILTER (WHERE NOT same) >= 1)"


def within_between(spark: S, sf: str) -> DataFrame:
    return inference.within_between(jaccard(spark, sf), modules(spark, sf))


@query("AGG13_within_between", with_("counts mods", f'SELECT gene, module, {r("within")}, {r("between_", "between")}, n_within, n_between FROM wb', *JACS, AGG13).replace("AS between,", 'AS "between",').replace("AS within,", 'AS "within",'))
def within_between_query(spark: S, sf: str) -> DataFrame:
    return rounded(within_between(spark, sf))


@query("TST01_signed_rank", with_("counts mods", f"SELECT n::BIGINT AS n, v, {r('(v - n * (n + 1) / 4 - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)', 'z')} FROM (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END)::DOUBLE AS v, (SELECT sum(c * c * c - c)::DOUBLE FROM (SELECT a, count(*) AS c FROM dd GROUP BY a)) AS ties FROM (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS k FROM dd))", *JACS, AGG13, "dd AS (SELECT within - between_ AS d, round(abs(within - between_), 12) AS a FROM wb WHERE within <> between_)"))
def signed_rank(spark: S, sf: str) -> DataFrame:
    return rounded(inference.signed_rank(within_between(spark, sf)).select("n", "v", "z"))


@query("TST01_sign_flips", with_("counts mods", f"SELECT {r('o', 'observed')}, sum(CASE WHEN m >= o - 1e-12 THEN 1 ELSE 0 END)::BIGINT AS k, {r('(sum(CASE WHEN m >= o - 1e-12 THEN 1 ELSE 0 END) + 1) / 201.0', 'p')} FROM (SELECT b, avg(CASE WHEN {md5_sql('b', 'gene')} / 4294967296.0 < 0.5 THEN d ELSE -d END) AS m FROM dd, range(1, 201) AS t(b) GROUP BY b), (SELECT avg(d) AS o FROM dd) GROUP BY o", *JACS, AGG13, "dd AS (SELECT gene, within - between_ AS d FROM wb)"))
def sign_flips(spark: S, sf: str) -> DataFrame:
    return rounded(inference.sign_flips(within_between(spark, sf), 200))


@query("TST01_sign_flips_two_sided", with_("counts mods", f"SELECT {r('o', 'observed')}, sum(CASE WHEN abs(m) >= abs(o) - 1e-12 THEN 1 ELSE 0 END)::BIGINT AS k FROM (SELECT b, avg(CASE WHEN {md5_sql('b', 'gene')} / 4294967296.0 < 0.5 THEN d ELSE -d END) AS m FROM dd, range(1, 501) AS t(b) GROUP BY b), (SELECT avg(d) AS o FROM dd) GROUP BY o", *JACS, AGG13, "dd AS (SELECT gene, within - between_ AS d FROM wb)"))
def sign_flips_two_sided(spark: S, sf: str) -> DataFrame:
    return rounded(inference.sign_flips(within_between(spark, sf), 500, "two.sided").select("observed", "k"))


def _perm_sql(n: int, block: bool, selected: str) -> list[str]:
    blocks = "bi AS (SELECT grid_id, " + ("floor((gx - 1) / 4) * 1000 + floor((gy - 1) / 4)" if block else "0") + " AS block FROM info)"
    perm = f"perm AS (SELECT a.b, a.grid_id, s.grid_id AS src FROM (SELECT b, block, grid_id, row_number() OVER (PARTITION BY b, block ORDER BY grid_id) AS k FROM bi, range(1, {n + 1}) AS t(b)) a JOIN (SELECT b, block, grid_id, row_number() OVER (PARTITION BY b, block ORDER BY md5(b || '_' || grid_id), grid_id) AS k FROM bi, range(1, {n + 1}) AS t(b)) s USING (b, block, k))"
    plag = "plag AS (SELECT b, w.i, gene, sum(w.w * z) AS lag FROM perm JOIN xz ON xz.grid_id = perm.src JOIN w ON w.j = perm.grid_id GROUP BY b, w.i, gene)"
    lb = "lb AS (SELECT a.b, sel.gene1, sel.gene2, L, r, (SELECT count(*) FROM info) / s2 * sum(a.lag * c.lag) / sqrt(p.q * q.q) AS lb FROM sel JOIN plag a ON a.gene = gene1 JOIN plag c ON c.gene = gene2 AND c.b = a.b AND c.i = a.i JOIN norm p ON p.gene = gene1 JOIN norm q ON q.gene = gene2, s2 GROUP BY a.b, sel.gene1, sel.gene2, L, r, s2, p.q, q.q)"
    return [blocks, perm, f"sel AS ({selected})", plag, lb]


def perm_query(name: str, n: int, block: bool, delta_: bool, recompute: bool = False) -> None:
    """All pairs of the panel, by blocks of genes; the SQL draws the same permutations."""
    hit = "abs(lb - r) >= abs(L - r) - 1e-12" if delta_ else "abs(lb) >= abs(L) - 1e-12"
    count = f"sum(CASE WHEN {hit} THEN 1 ELSE 0 END)"
    sql = with_("delta info", f"SELECT gene1, gene2, {count}::BIGINT AS k, {r(f'({count} + 1) / {n + 1}.0', 'p')} FROM lb GROUP BY gene1, gene2", *_perm_sql(n, block, "SELECT gene1, gene2, L, r FROM delta"))

    @query(name, sql)
    def run(spark: S, sf: str) -> DataFrame:
        info, z = xz(spark, sf)
        edges = stored(weights.weights(info))
        seen = stored(pairs.lees_l(z, edges, info))
        if delta_:
            seen = seen.join(pairs.pearson(z, "grid_id", "z"), ["gene1", "gene2"])
        tiles = grids.block_ids(info, 4) if block else info
        out = inference.permutation_test_dense(z, edges, tiles, seen, n, "block" if block else None, "r" if delta_ else None, recompute)
        return rounded(out.select("gene1", "gene2", "k", "p"))


perm_query("PRM01_global_permutations", 999, False, False)
perm_query("PRM02_block_permutations", 99, True, False)
perm_query("PRM03_delta_permutations", 99, False, True)
perm_query("PRM04_delta_recomputed", 49, True, True, True)


@query("PRM01_permutations_by_joins", with_("delta info", f"SELECT gene1, gene2, sum(CASE WHEN abs(lb) >= abs(L) - 1e-12 THEN 1 ELSE 0 END)::BIGINT AS k FROM lb GROUP BY gene1, gene2", *_perm_sql(19, False, "SELECT gene1, gene2, L, r FROM delta")))
def permutations_by_joins(spark: S, sf: str) -> DataFrame:
    info, z = xz(spark, sf)
    perms = stored(inference.permutations(info.select("grid_id"), 19))
    return inference.permutation_test(z, stored(weights.weights(info)), info, lee_of(info, z), perms, 19).select("gene1", "gene2", "k")


FAULTY = "bp AS (SELECT b, grid_id, CASE WHEN b = 3 AND grid_id = (SELECT max(grid_id) FROM perm) THEN (SELECT min(grid_id) FROM perm) ELSE src END AS src FROM perm WHERE b <> 5 OR grid_id <> (SELECT min(grid_id) FROM perm)), bb AS (SELECT p.b, count(DISTINCT src) AS s, count(DISTINCT p.grid_id) AS t, sum(CASE WHEN x.block <> y.block THEN 1 ELSE 0 END) AS across_ FROM bp p JOIN bi x ON x.grid_id = p.grid_id JOIN bi y ON y.grid_id = src GROUP BY p.b)"


@query("PRM05_permutation_guards", with_("delta info", "SELECT count(*) AS permutations, sum(CASE WHEN s <> n OR t <> n THEN 1 ELSE 0 END)::BIGINT AS not_bijective, sum(across_)::BIGINT AS across_blocks FROM bb, (SELECT count(*) AS n FROM info)", *_perm_sql(9, True, "SELECT gene1, gene2, L, r FROM delta")[:2], FAULTY))
def guards(spark: S, sf: str) -> DataFrame:
    """Of nine permutations one has a source twice, across blocks, and one lacks a tile."""
    blocks = stored(grids.block_ids(layer(spark, sf)[0], 4))
    perms = inference.permutations(blocks, 9, "block")
    ends = blocks.agg(F.min("grid_id").alias("lo"), F.max("grid_id").alias("hi"))
    bad = perms.crossJoin(F.broadcast(ends)).where("b <> 5 or grid_id <> lo").select("b", "grid_id", F.when((F.col("b") == 3) & (F.col("grid_id") == F.col("hi")), F.col("lo")).otherwise(F.col("src")).alias("src"))
    return inference.check_permutations(stored(bad), blocks, "block")


TOP = "SELECT gene1, gene2, " + ", ".join(r(c) for c in ("L", "r", "Delta"))


@query("TOP01_top_pairs", with_("delta", f"{TOP} FROM (SELECT *, rank() OVER (ORDER BY Delta DESC) AS a, rank() OVER (ORDER BY Delta) AS b FROM delta) WHERE a <= 10 OR b <= 10"))
def top_pairs(spark: S, sf: str) -> DataFrame:
    return rounded(ranking.top_pairs(delta(spark, sf), 10, "both").select("gene1", "gene2", "L", "r", "Delta"))


@query("TOP02_labelled_extremes", with_("delta", f"SELECT gene1, gene2, {r('Delta')}, 'top' AS \"end\" FROM (SELECT * FROM delta ORDER BY Delta DESC, gene1, gene2 LIMIT 5) UNION ALL SELECT gene1, gene2, {r('Delta')}, 'bottom' FROM (SELECT * FROM delta ORDER BY Delta, gene1, gene2 LIMIT 5)"))
def extremes(spark: S, sf: str) -> DataFrame:
    return rounded(ranking.labelled_extremes(delta(spark, sf), 5))


@query("RNK01_ranked_pairs", with_("delta", f"{TOP} FROM (SELECT *, rank() OVER (ORDER BY Delta DESC) AS a FROM (SELECT gene1, gene2, L, greatest(r, 0) AS r, L - greatest(r, 0) AS Delta FROM delta) WHERE r BETWEEN -1 AND 1 AND L BETWEEN -1 AND 1) WHERE a <= 10"))
def ranked(spark: S, sf: str) -> DataFrame:
    met = ranking.in_ranges(ranking.finite_pairs(delta(spark, sf, "ref_only")))
    return rounded(ranking.top_pairs(met, 10).select("gene1", "gene2", "L", "r", "Delta"))


@query("RNK01_ranked_with_fdr", with_("delta info", f"{TOP}, k, {r('p')}, {r('least(1.0, min(p * m / c) OVER (ORDER BY p DESC))', 'delta_fdr')} FROM (SELECT *, count(*) OVER (ORDER BY p) AS c, (SELECT count(*) FROM delta) AS m FROM (SELECT gene1, gene2, L, r, L - r AS Delta, sum(CASE WHEN abs(lb - r) >= abs(L - r) - 1e-12 THEN 1 ELSE 0 END)::BIGINT AS k, (sum(CASE WHEN abs(lb - r) >= abs(L - r) - 1e-12 THEN 1 ELSE 0 END) + 1) / 50.0 AS p FROM lb GROUP BY gene1, gene2, L, r))", *_perm_sql(49, False, "SELECT gene1, gene2, L, r FROM (SELECT *, rank() OVER (ORDER BY Delta DESC) AS a FROM delta) WHERE a <= 20")))
def ranked_fdr(spark: S, sf: str) -> DataFrame:
    info, z = xz(spark, sf)
    edges = stored(weights.weights(info))
    met = stored(ranking.deltas(pairs.lees_l(z, edges, info), pairs.pearson(z, "grid_id", "z")))
    tested = inference.permutation_test_dense(z, edges, info, ranking.top_pairs(met, 20), 49, reference="r")
    return rounded(ranking.ranked(met, tested, "BH_universe").select("gene1", "gene2", "L", "r", "Delta", "k", "p", "delta_fdr"))


def curve_points(spark: S, sf: str) -> DataFrame:
    met = delta(spark, sf).select(F.col("r").alias("x"), F.col("L").alias("y"))
    return curve.strata(met, 10, "x")


def fit_sql(places: str, out: str, k: str = "greatest(2, ceil(0.45 * (SELECT count(*) FROM pt)))") -> list[str]:
    """out(x0, s0, mean, fit, w2): local fits of pt(x, y) at places(x0) over the k nearest points."""
    return [
        f"{out}_n AS (SELECT x0, x - x0 AS c, y, abs(x - x0) AS d, row_number() OVER (PARTITION BY x0 ORDER BY abs(x - x0)) AS k FROM ({places}), pt)",
        f"{out}_w AS (SELECT x0, c, y, CASE WHEN h > 0 THEN greatest(1 - (d / h) ** 3, 0) ** 3 ELSE (d = 0)::INT END AS w FROM {out}_n JOIN (SELECT x0, max(d) AS h FROM {out}_n WHERE k <= {k} GROUP BY x0) USING (x0))",
        f"{out}_s AS (SELECT x0, sum(w) AS s0, sum(w * c) AS s1, sum(w * c * c) AS s2, sum(w * y) AS t0, sum(w * c * y) AS t1, sum(w * w) AS q FROM {out}_w GROUP BY x0)",
        f"{out} AS (SELECT x0, s0, t0 / s0 AS mean, CASE WHEN abs(s0 * s2 - s1 * s1) >= 1e-14 THEN (t0 - (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) * s1) / s0 ELSE t0 / s0 END AS fit, q / (s0 * s0) AS w2 FROM {out}_s)",
    ]


PT = "pt AS (SELECT r AS x, L AS y FROM delta)"
GRID31 = "SELECT -0.3::DOUBLE + i * 0.02::DOUBLE AS x0 FROM range(0, 31) AS t(i)"


@query("CRV01_local_fit", with_("delta", f"SELECT {r('x0', 'x')}, {r('fit')}, {r('w2')} FROM lf", PT, *fit_sql(GRID31, "lf")))
def local_fit(spark: S, sf: str) -> DataFrame:
    return rounded(curve.local_fit(curve_points(spark, sf), np.linspace(-0.3, 0.3, 31)))


@query("CRV01_local_means", with_("delta", f"SELECT {r('x0', 'x')}, {r('mean', 'fit')} FROM lf", PT, *fit_sql(GRID31, "lf", "least(40, ceil(0.3 * (SELECT count(*) FROM pt)))")))
def local_means(spark: S, sf: str) -> DataFrame:
    return rounded(curve.local_fit(curve_points(spark, sf), np.linspace(-0.3, 0.3, 31), 0.0, 0, 40).select("x", "fit"))


@query("CRV02_bootstrap_bands")
def bands(spark: S, sf: str) -> DataFrame:
    return rounded(curve.bootstrap_curve(curve_points(spark, sf), np.linspace(-0.3, 0.3, 51), b=200))


@query("CRV03_width_floor", f"SELECT i::BIGINT AS i, {r('CASE WHEN i % 3 = 0 THEN 0.5 - 0.2 ELSE 0.5 - 0.01 * i END', 'lo')}, {r('CASE WHEN i % 3 = 0 THEN 0.5 + 0.2 ELSE 0.5 + 0.01 * i END', 'hi')}, i % 3 = 0 AS reapplied, {r('CASE WHEN i % 3 = 0 THEN 0.4 - 0.02 * i ELSE 0 END', 'shortfall')} FROM range(0, 19) AS t(i)")
def floor(spark: S, sf: str) -> DataFrame:
    c = spark.range(19).select(F.col("id").alias("i"), (0.5 - 0.01 * F.col("id")).alias("lo"), (0.5 + 0.01 * F.col("id")).alias("hi"))
    return rounded(curve.width_floor(c, F.when(F.col("i") % 3 == 0, 0.4).otherwise(0.0)))


@query("CRV03_finished_curve")
def finished(spark: S, sf: str) -> DataFrame:
    pts = stored(curve_points(spark, sf))
    return rounded(curve.finished_curve(pts, stored(curve.bootstrap_curve(pts, np.linspace(-0.3, 0.3, 41), b=100)), "bc", 0.05, near=50))


@query("CRV04_hat_diagonal", with_("delta", f"SELECT {r('edf')}, {r('ss / greatest(1, n - greatest(1, edf))', 'sigma2')}, {r('ss / greatest(1, n - 1)', 'sigma2_raw')} FROM (SELECT sum(1 / s0) AS edf, sum((y - fit) ** 2) AS ss, count(*) AS n FROM pt JOIN lf ON x0 = x)", PT, *fit_sql("SELECT DISTINCT x AS x0 FROM pt", "lf")))
def hat(spark: S, sf: str) -> DataFrame:
    return rounded(curve.bootstrap_curve(curve_points(spark, sf), np.linspace(-0.2, 0.2, 5), b=2).select("edf", "sigma2", "sigma2_raw").limit(1))


@query("WIN08_local_mad", with_("delta", f"SELECT {r('x0', 'x')}, {r('1.4826 * quantile_cont(abs(e - mid), 0.5)', 'mad')} FROM (SELECT x0, e, quantile_cont(e, 0.5) OVER (PARTITION BY x0) AS mid FROM nr WHERE k <= 50) GROUP BY x0", PT, *fit_sql(GRID31, "lf"), "g AS (SELECT x0, fit, row_number() OVER (ORDER BY x0) - 1 AS i FROM lf), rs AS (SELECT x, y - (a.fit + (t - a.i) * (b.fit - a.fit)) AS e FROM (SELECT *, least(greatest((x + 0.3::DOUBLE) / 0.02::DOUBLE, 0), 30) AS t FROM pt) p JOIN g a ON a.i = least(floor(t), 29) JOIN g b ON b.i = a.i + 1), nr AS (SELECT x0, e, row_number() OVER (PARTITION BY x0 ORDER BY abs(x - x0), x, e) AS k FROM g, rs)"))
def mad(spark: S, sf: str) -> DataFrame:
    pts = stored(curve_points(spark, sf))
    return rounded(curve.local_mad(pts, curve.local_fit(pts, np.linspace(-0.3, 0.3, 31)), 50))
