"""The tables behind plots; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import finite


def cluster_comparison(metadata: DataFrame, columns: list[str]) -> DataFrame:
    """(gene, clustering, cluster) of several label columns; genes without any label drop."""
    return metadata.unpivot("gene", columns, "clustering", "cluster").where("cluster is not null")


def density_map(info: DataFrame, density: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """Tiles with their density, clipped at the greatest one times cutoff, and its share of that."""
    top = density.agg((F.max("density") * cutoff).alias("top"))
    d = F.least(F.coalesce("density", F.lit(0.0)), F.col("top"))
    return info.join(density, "grid_id", "left").crossJoin(F.broadcast(top)).select("grid_id", "xmin", "xmax", "ymin", "ymax", d.alias("density"), F.coalesce(F.try_divide(d, F.col("top")), F.lit(0.0)).alias("alpha"))


def density_centroids(centroids: DataFrame, density: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """Cells of positive density with their place and the clipped density by its greatest."""
    top = density.agg((F.max("density") * cutoff).alias("top"))
    met = density.where("density > 0").crossJoin(F.broadcast(top)).select("cell", F.try_divide(F.least("density", "top"), F.col("top")).alias("alpha"))
    return centroids.join(met, "cell")


def grid_boundary(info: DataFrame) -> DataFrame:
    """Rectangles of tiles, and the square that holds them all (left, right, bottom, top)."""
    box = info.agg(F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y0"), F.max("ymax").alias("y1"))
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    square = box.select((cx - half).alias("left"), (cx + half).alias("right"), (cy - half).alias("bottom"), (cy + half).alias("top"))
    return info.select("grid_id", "xmin", "xmax", "ymin", "ymax").crossJoin(F.broadcast(square))


def histogram(pairs: DataFrame, value: str = "L", bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of the values between their extremes; the last bin holds the greatest."""
    ends = pairs.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), step)), F.lit(0))).cast("int")
    return pairs.crossJoin(F.broadcast(ends)).withColumns({"bin": at, "step": step}).groupBy("bin", "lo", "step").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"), "n")


def network_edges(pairs: DataFrame, genes: list[str] | None = None, l_min: float = 0.0, l_min_neg: float | None = None, l_max: float | None = None, p_cut: float | None = None, fdr_max: float | None = None, fdr: list[str] = ("fdr",), weight_floor: float = 1e-6) -> DataFrame:
    """Edges of a plotted network: limits on L of both signs, p and the first FDR column there is; weight = |L|, at least the floor."""
    out = pairs if genes is None else pairs.where(F.col("gene1").isin(genes) & F.col("gene2").isin(genes))
    keep: Column = F.col("L") >= l_min
    if l_min_neg is not None:
        keep |= F.col("L") <= -abs(l_min_neg)
    out = out.where(keep & (F.col("L") != 0))
    if l_max is not None:
        out = out.where(F.abs("L") <= l_max)
    if p_cut is not None:
        out = out.where(finite(F.col("p")) & (F.col("p") < p_cut))
    have = [c for c in fdr if c in pairs.columns]
    if fdr_max is not None and have:
        out = out.where(finite(F.col(have[0])) & (F.col(have[0]) <= fdr_max))
    return out.select("gene1", "gene2", "L", F.greatest(F.abs("L"), F.lit(weight_floor)).alias("weight"), F.signum("L").cast("int").alias("sign"))


def hubs(edges: DataFrame, factor: float = 2.0) -> DataFrame:
    """(gene, degree, hub): hubs have over `factor` times the median degree."""
    d = edges.select(F.explode(F.array("gene1", "gene2")).alias("gene")).groupBy("gene").agg(F.count("*").alias("degree"))
    mid = d.agg(F.percentile("degree", F.lit(0.5)).alias("mid"))
    return d.crossJoin(F.broadcast(mid)).select("gene", "degree", (F.col("degree") > factor * F.col("mid")).alias("hub"))
