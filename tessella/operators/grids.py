"""Tiles of one or several sizes, counts a tile and gene, tile quality, densities and normalised values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

EPS = 1e-6


def bounds(points: DataFrame, x: str = "x_location", y: str = "y_location") -> DataFrame:
    """One row: xmin, xmax, ymin, ymax."""
    return points.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def origin(low: Column, length: Column) -> Column:
    return F.floor(low / length) * length


def bin_points(points: DataFrame, lengths: list[float], flipped: bool = False, x: str = "x_location", y: str = "y_location", gene: str = "feature_name", box: DataFrame | None = None) -> DataFrame:
    """(length, gx, gy, grid_id, gene, count) for every tile length in one scan; tiles are numbered from 1 at a multiple of the
    length at or below the least coordinate (y: 0 if flipped). Counts are combined before the shuffle."""
    box = bounds(points, x, y) if box is None else box
    each = points.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(gene).alias("gene")).crossJoin(F.broadcast(box)).withColumn("length", F.explode(F.array(*[F.lit(float(v)) for v in lengths])))
    length = F.col("length")
    y0 = F.lit(0.0) if flipped else origin(F.col("ymin"), length)
    at = lambda c, o: (F.floor((F.col(c) - o) / length) + 1).cast("int")
    out = each.select("length", at("x", origin(F.col("xmin"), length)).alias("gx"), at("y", y0).alias("gy"), "gene")
    return out.groupBy("length", "gx", "gy", "gene").agg(F.count("*").alias("count")).select("length", "gx", "gy", grid_id().alias("grid_id"), "gene", "count")


def grid_id() -> Column:
    return F.concat(F.lit("g"), "gx", F.lit("_"), "gy")


def tiles(box: DataFrame, length: float, flipped: bool = False, keep_partial: bool = False) -> DataFrame:
    """The tile table of a box: gx, gy, grid_id, xmin.., center_x.., width, height. The last tile of a side ends at the box; it is
    partial, and dropped unless asked for."""
    y0 = F.lit(0.0) if flipped else origin(F.col("ymin"), F.lit(length))
    side = box.select(origin(F.col("xmin"), F.lit(length)).alias("x0"), y0.alias("y0"), "xmax", "ymax")
    number = lambda hi, lo: F.greatest(F.ceil((F.col(hi) - F.col(lo)) / length), F.lit(0)).cast("int")
    span = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    each = side.withColumn("gx", F.explode(span(number("xmax", "x0")))).withColumn("gy", F.explode(span(number("ymax", "y0"))))
    low = lambda o, g: F.col(o) + (F.col(g) - 1) * length
    out = each.select("gx", "gy", grid_id().alias("grid_id"), low("x0", "gx").alias("xmin"), F.least(low("x0", "gx") + length, "xmax").alias("xmax"), low("y0", "gy").alias("ymin"), F.least(low("y0", "gy") + length, "ymax").alias("ymax"))
    out = out.withColumns({"center_x": (F.col("xmin") + F.col("xmax")) / 2, "center_y": (F.col("ymin") + F.col("ymax")) / 2, "width": F.col("xmax") - F.col("xmin"), "height": F.col("ymax") - F.col("ymin")})
    return out if keep_partial else whole_tiles(out, length)


def whole_tiles(info: DataFrame, length: float) -> DataFrame:
    return info.where((F.abs(F.col("width") - length) < EPS) & (F.abs(F.col("height") - length) < EPS))


def rich_tiles(counts: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Counts of tiles whose number of genes is within limits."""
    n = counts.groupBy("grid_id").agg(F.count_distinct("gene").alias("n")).where((F.col("n") >= least) & (F.lit(True) if most is None else F.col("n") <= most))
    return counts.join(n.select("grid_id"), "grid_id", "left_semi")


def segmented_tiles(counts: DataFrame, tagged: DataFrame, least: int) -> DataFrame:
    """Counts of tiles that hold at least `least` segmentation vertices (tagged: a grid_id each); all if no tile does."""
    good = tagged.groupBy("grid_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("grid_id")
    some = good.agg((F.count("*") == 0).alias("none"))
    marked = counts.join(good.withColumn("good", F.lit(True)), "grid_id", "left").crossJoin(F.broadcast(some))
    return marked.where(F.col("good") | F.col("none")).drop("good", "none")


def layer(points: DataFrame, length: float, min_genes: int = 1, flipped: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tile table, counts) of one length: quality first, then counts and tiles that both have. Both are stored, as every verb reads
    them several times and they are much smaller than the points."""
    row = bounds(points).first()  # four numbers
    box = points.sparkSession.createDataFrame([tuple(row)], "xmin double, xmax double, ymin double, ymax double")
    counts = stored(rich_tiles(bin_points(points, [length], flipped, box=box), min_genes))
    info = tiles(box, length, flipped).join(counts.select("grid_id").distinct(), "grid_id", "left_semi")
    info = stored(info)
    return info, counts.join(info.select("grid_id"), "grid_id", "left_semi")


def library_share(counts: DataFrame, unit: str = "grid_id", value: str = "count") -> DataFrame:
    """counts with lib, the unit's total (1 if 0), and share = value / lib."""
    lib = F.sum(value).over(Window.partitionBy(unit))
    return counts.withColumn("lib", F.when(lib == 0, 1.0).otherwise(lib.cast("double"))).withColumn("share", F.col(value) / F.col("lib"))


def log_cpm(counts: DataFrame, scale: float = 1e4, unit: str = "cell") -> DataFrame:
    return library_share(counts, unit).withColumn("value", F.log1p(F.col("share") * scale))


def gene_moments(counts: DataFrame, units: DataFrame, unit: str = "grid_id", value: str = "share") -> DataFrame:
    """(gene, mean, sd) over all units (one row: n); absent values are zeros, so sums are enough."""
    n = units.agg(F.count("*").cast("double").alias("n"))
    s = counts.groupBy("gene").agg(F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2")).crossJoin(F.broadcast(n))
    var = F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("n") - 1)
    return s.select("gene", (F.col("s1") / F.col("n")).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def normalise(counts: DataFrame, info: DataFrame, keep_zero: bool = False, row_norm: bool = True, var_eps: float = 0.0) -> DataFrame:
    """(grid_id, gene, z): counts as shares of their tile, then z-scores a gene with the sample deviation over the tiles that have
    counts (all of info with keep_zero). Genes without variance, and tiles without counts, have zeros."""
    share = library_share(counts).withColumn("share", F.col("share") if row_norm else F.col("count").cast("double"))
    counted = counts.select("grid_id").distinct()
    moments = gene_moments(share, info if keep_zero else counted).withColumn("flat", (F.col("sd") <= var_eps + 1e-12) | F.col("sd").isNull())
    every = info.select("grid_id").crossJoin(F.broadcast(moments)).join(counted.withColumn("counted", F.lit(True)), "grid_id", "left")
    z = (F.coalesce("share", F.lit(0.0)) - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    live = ~F.col("flat") & (F.lit(keep_zero) | F.coalesce("counted", F.lit(False)))
    return every.join(share.select("grid_id", "gene", "share"), ["grid_id", "gene"], "left").select("grid_id", "gene", F.when(live, z).otherwise(0.0).alias("z"))


def winsorise(values: DataFrame, p: float, value: str = "z") -> DataFrame:
    """Values above a gene's quantile p become that quantile."""
    top = values.groupBy("gene").agg(F.percentile(value, F.lit(p)).alias("__top"))
    return values.join(F.broadcast(top), "gene").withColumn(value, F.least(value, "__top")).drop("__top")


def coverage_percent(counts: DataFrame, info: DataFrame) -> DataFrame:
    """(gene, pct): share of tiles in which the gene stands, in percent, to three places."""
    n = info.agg(F.count("*").alias("n"))
    return counts.where("count > 0").groupBy("gene").agg(F.count_distinct("grid_id").alias("k")).crossJoin(F.broadcast(n)).select("gene", F.round(100.0 * F.col("k") / F.col("n"), 3).alias("pct"))


def gene_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gene").agg(F.sum("count").cast("double").alias("total"))


def prescreen(counts: DataFrame, info: DataFrame, min_detect: float = 0.1, top: int = 10) -> DataFrame:
    """(gene, detect, total): the genes of the largest totals among those detected in enough tiles."""
    n = info.agg(F.count("*").cast("double").alias("n"))
    rate = counts.where("count > 0").groupBy("gene").agg(F.count_distinct("grid_id").alias("k"), F.sum("count").cast("double").alias("total")).crossJoin(F.broadcast(n))
    return rate.select("gene", (F.col("k") / F.col("n")).alias("detect"), "total").where(F.col("detect") >= min_detect).orderBy(F.desc("total"), "gene").limit(top)


def density(counts: DataFrame, info: DataFrame, genes: Column, mode: str = "none") -> DataFrame:
    """(grid_id, density) of every tile: the genes' counts an area; per_grid counts shares of the tile, global_gene shares of the
    gene's total. A tile without them has 0."""
    part = counts
    value = F.col("count").cast("double")
    if mode != "none":
        by = {"per_grid": "grid_id", "global_gene": "gene"}[mode]
        totals = counts.groupBy(by).agg(F.sum("count").cast("double").alias("total"))
        part, value = counts.join(totals, by), value / F.nullif(F.col("total"), F.lit(0.0))
    some = part.where(genes).groupBy("grid_id").agg(F.sum(value).alias("s"))
    return info.select("grid_id", (F.col("width") * F.col("height")).alias("area")).join(some, "grid_id", "left").select("grid_id", (F.coalesce("s", F.lit(0.0)) / F.col("area")).alias("density"))


def block_ids(info: DataFrame, side: int) -> DataFrame:
    """(grid_id, block): squares of side x side tiles, numbered from 1 without gaps."""
    bx, by = F.expr(f"(gx - 1) div {side}"), F.expr(f"(gy - 1) div {side}")
    keys = info.select("grid_id", bx.alias("bx"), by.alias("by"))
    numbers = keys.select("bx", "by").distinct().withColumn("block", F.row_number().over(Window.orderBy("bx", "by")))
    return keys.join(F.broadcast(numbers), ["bx", "by"]).select("grid_id", "block")
