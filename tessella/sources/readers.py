"""Readers for the files of the supported platforms. Each gives the library's tables; paths may be in any store Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Micrometres of a pixel where a platform's files state none, and a spot's diameter.
PIXEL_UM, SPOT_UM = 0.120280945, 55.0
MOLECULES = T.StructType([T.StructField(c, T.StringType() if c == "feature_name" else T.DoubleType()) for c in ("x_location", "y_location", "qv", "nucleus_distance", "feature_name")])


def listing(spark: SparkSession, path: str) -> set[str]:
    """Names in a folder of any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()


def detect_platform(names: set[str], spatial: set[str] = frozenset(), prefer: str = "auto") -> str:
    """visium, xenium or cosmx by the names in a folder (and in its folder `spatial`); visium is tested first, cosmx last."""
    if prefer != "auto":
        return prefer
    matrices = {"filtered_feature_bc_matrix", "raw_feature_bc_matrix", "filtered_feature_bc_matrix.h5", "raw_feature_bc_matrix.h5"}
    if "spatial" in names and (names & matrices or "scalefactors_json.json" in spatial):
        return "visium"
    if names & {"transcripts.parquet", "cells.parquet"}:
        return "xenium"
    if names & {"flatFiles", "DecodedFiles"}:
        return "cosmx"
    raise ValueError("the folder has the files of no supported platform")


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """Molecule parquet; a missing quality counts as infinite, a missing distance as 0."""
    df = spark.read.parquet(path)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit({"qv": float("inf"), "nucleus_distance": 0.0}.get(f.name))).cast(f.dataType).alias(f.name) for f in MOLECULES.fields])


def centroids(df: DataFrame) -> DataFrame:
    """(cell, x, y); the key joins cell and field of view where there is one."""
    key = F.concat_ws("_", "cell_id", "fov") if "fov" in df.columns else F.col("cell_id").cast("string")
    return df.select(key.alias("cell"), F.col("x_centroid").alias("x"), F.col("y_centroid").alias("y"))


def boundaries(df: DataFrame, keep: DataFrame | None = None, flip_at: Column | None = None) -> DataFrame:
    """(label_id, cell, ring): closed rings of the vertices of each label in the order of `pos`; labels under three vertices drop."""
    df = df.join(keep.select("cell_id").distinct(), "cell_id", "left_semi") if keep is not None else df
    y = flip_at - F.col("vertex_y") if flip_at is not None else F.col("vertex_y")
    points = df.groupBy("label_id").agg(F.first("cell_id").alias("cell"), F.array_sort(F.collect_list(F.struct("pos", F.col("vertex_x").alias("x"), y.alias("y")))).alias("v"))
    ring = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return points.where(F.size("v") >= 3).select("label_id", "cell", F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(ring[0]))).alias("ring"))


def cosmx_molecules(raw: DataFrame, pixel: float = PIXEL_UM) -> DataFrame:
    """Molecules of a decoded-transcript table: by header, else by position (columns 6, 7, 9; 8 distance, 10 quality); pixels to micrometres."""
    c = raw.columns
    pick = lambda name, at: F.col(name) if name in c else F.col(c[at]) if at is not None and len(c) > at and "target" not in c else None
    x, y, target = pick("x_global_px", 5), pick("y_global_px", 6), pick("target", 8)
    near, qv = pick("nucleus_distance", 7), pick("qv", 9)
    scaled = lambda v: v.cast("double") * pixel
    return raw.select(scaled(x).alias("x_location"), scaled(y).alias("y_location"), F.coalesce(qv.cast("double") if qv is not None else F.lit(None).cast("double"), F.lit(float("inf"))).alias("qv"), F.coalesce(near.cast("double") if near is not None else F.lit(None).cast("double"), F.lit(0.0)).alias("nucleus_distance"), target.cast("string").alias("feature_name"))


def cells_from_vertices(df: DataFrame) -> DataFrame:
    """(cell_id, fov, x, y): mean of each cell's vertices."""
    return df.groupBy("cell_id", "fov").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


NOT_GENES = ("fov", "cell_ID", "cell_id", "cell")
NOT_GENE_PREFIXES = ("NegPrb", "Negative", "SystemControl", "FalseCode")


def wide_to_long(df: DataFrame, key: list[str], exclude: tuple[str, ...] = NOT_GENE_PREFIXES) -> DataFrame:
    """(key.., gene, count) of a wide expression table; columns that are no genes, and zeros, drop."""
    genes = [c for c in df.columns if c not in NOT_GENES and c not in key and not c.startswith(exclude)]
    return df.unpivot(key, genes, "gene", "count").where("count <> 0")


def best_key(expr: DataFrame, cells_: DataFrame) -> str:
    """Which of four keys of expr (fov, cell) meets most of the cells' keys: cell_fov, cell, and cell with the next or previous fov."""
    keys = {"cell_fov": F.concat_ws("_", "cell", "fov"), "cell": F.col("cell").cast("string"), "fov_plus": F.concat_ws("_", "cell", F.col("fov") + 1), "fov_minus": F.concat_ws("_", "cell", F.col("fov") - 1)}
    known = cells_.select(F.col("cell").alias("k")).distinct()
    tried = expr.select(F.explode(F.create_map(*[x for n, k in keys.items() for x in (F.lit(n), k)])).alias("name", "k")).distinct()
    got = {r.name: r["count"] for r in tried.join(known, "k", "left_semi").groupBy("name").count().collect()}
    return max(keys, key=lambda n: got.get(n, 0))


def csc_to_long(columns: DataFrame) -> DataFrame:
    """(col, row, value) of a compressed matrix held as one row a column: (col, indices, data)."""
    return columns.select("col", F.explode(F.arrays_zip("indices", "data")).alias("e")).select("col", F.col("e.indices").alias("row"), F.col("e.data").alias("value"))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get .1, .2, ... from their second place on."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn(name, F.when(n > 0, F.concat_ws(".", F.col(name), n)).otherwise(F.col(name)))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value), from 1, of a matrix market file: comments and the size line drop, wherever the file is split."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"), "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    first = parts.agg(F.min("n").alias("n0"))
    return parts.crossJoin(F.broadcast(first)).where("n > n0").select(F.col("p")[0].cast("long").alias("row"), F.col("p")[1].cast("long").alias("col"), F.col("p")[2].cast("double").alias("value"))


def numbered_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines of a tab-separated file without header, numbered from 1 in file order (the file has one partition's size)."""
    from pyspark.sql import Window

    df = spark.read.csv(path, sep="\t").withColumn("n", F.monotonically_increasing_id())
    named = df.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns) if f"_c{i}" in df.columns], "n")
    return named.withColumn("index", F.row_number().over(Window.orderBy("n")).cast("long")).drop("n")


def mtx_counts(matrix: DataFrame, features: DataFrame, barcodes: DataFrame) -> DataFrame:
    """(grid_id, gene, count) of a feature-by-barcode matrix; genes without a count drop."""
    return matrix.join(features.select(F.col("index").alias("row"), F.col("name").alias("gene")), "row").join(barcodes.select(F.col("index").alias("col"), F.col("barcode").alias("grid_id")), "col").where("value <> 0").groupBy("grid_id", "gene").agg(F.sum("value").alias("count"))


ALIASES = {"barcode": ("barcode", "barcodes"), "in_tissue": ("in_tissue", "intissue", "tissue"), "array_row": ("array_row", "row"), "array_col": ("array_col", "col"), "pxl_row_in_fullres": ("pxl_row_in_fullres", "pxl_row", "imagerow"), "pxl_col_in_fullres": ("pxl_col_in_fullres", "pxl_col", "imagecol")}
POSITIONS = ["barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres"]


def positions(df: DataFrame, in_tissue: bool = True) -> DataFrame:
    """Spot positions under canonical names (aliases in any case; without a header by place), cast, and only those in tissue."""
    lower = {c.lower(): c for c in df.columns}
    if "barcode" in lower or "barcodes" in lower:
        df = df.select(*[F.col(lower[next(a for a in ALIASES[p] if a in lower)]).alias(p) for p in POSITIONS])
    else:
        df = df.toDF(*POSITIONS)
    df = df.select("barcode", *[F.col(c).cast("int" if not c.startswith("pxl") else "double").alias(c) for c in POSITIONS[1:]])
    return df.where("in_tissue = 1") if in_tissue else df


def scalefactors(df: DataFrame, default_spot: float = SPOT_UM) -> DataFrame:
    """(microns_per_pixel, spot_um): each derived from the other and the spot's diameter in pixels where it is missing."""
    col = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    px = col("spot_diameter_fullres")
    spot = F.coalesce(col("spot_diameter_microns"), col("microns_per_pixel") * px, F.lit(default_spot))
    return df.select(F.coalesce(col("microns_per_pixel"), F.try_divide(spot, px)).alias("microns_per_pixel"), spot.alias("spot_um"))


def read_scalefactors(spark: SparkSession, path: str) -> DataFrame:
    return scalefactors(spark.read.json(path, multiLine=True))


def crop_box(bbox: DataFrame, width: int, height: int, scale: float) -> DataFrame:
    """Level pixels of a full-resolution box (left, right, top, bottom): floor and ceiling, inside the image."""
    edge = lambda c, f, hi: F.least(F.greatest(f(F.col(c) * scale), F.lit(0)), F.lit(hi)).cast("int")
    return bbox.select(edge("left", F.floor, width).alias("left"), edge("right", F.ceil, width).alias("right"), edge("top", F.floor, height).alias("top"), edge("bottom", F.ceil, height).alias("bottom"))


def histology(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height) of the images in a path; pixels stay in the files."""
    image = spark.read.format("image").load(path)
    return image.select(F.col("image.origin").alias("origin"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def y_origin(choice: str, platform: str | None) -> str:
    """top-left or bottom-left: as chosen, else top-left for Visium, whose spots count pixel rows downwards."""
    if choice in ("top-left", "bottom-left"):
        return choice
    return "top-left" if platform == "Visium" else "bottom-left"


def roi_polygon(df: DataFrame) -> DataFrame:
    """(x, y) of a region file with any case of headers; an error under three rows."""
    lower = {c.lower(): c for c in df.columns}
    out = df.select(F.col(lower["x"]).cast("double").alias("x"), F.col(lower["y"]).cast("double").alias("y"))
    if out.limit(3).count() < 3:
        raise ValueError("a region needs three vertices")
    return out


def bounding_ring(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(pos, x, y): the corners of the points' box, where no region is given."""
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    corner = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))])
    return box.select(F.explode(corner).alias("c")).select("c.*")
