"""Filters and projections of point tables, and their place in polygons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults: largest distance to a nucleus, least quality, prefixes of control features.
MAX_DISTANCE, MIN_QV = 25.0, 20.0
CONTROLS = ("Unassigned", "NegControl", "Background", "DeprecatedCodeword", "SystemControl", "Negative")


def allow_genes(df: DataFrame, genes: list[str] | DataFrame, column: str = "feature_name") -> DataFrame:
    """Rows of listed genes; a table of genes is joined, so it may be of any size."""
    if isinstance(genes, DataFrame):
        return df.join(genes.select(F.col("gene").alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(genes))


def near_nucleus(df: DataFrame, most: float = MAX_DISTANCE) -> DataFrame:
    return df.where(F.col("nucleus_distance") <= most)


def without_controls(df: DataFrame, prefixes: tuple[str, ...] = CONTROLS, column: str = "feature_name") -> DataFrame:
    return df.where(~reduce(Column.__or__, [F.col(column).startswith(p) for p in prefixes]))


def good_quality(df: DataFrame, least: float = MIN_QV) -> DataFrame:
    return df.where(F.col("qv") >= least)


def gene_panel(df: DataFrame, exclude: tuple[str, ...], genes: list[str] | DataFrame | None = None, column: str = "gene") -> DataFrame:
    """Rows of a panel: prefixes go first, then what isn't listed; an error if nothing is left."""
    df = without_controls(df, exclude, column)
    df = df if genes is None else allow_genes(df, genes, column)
    if not df.limit(1).count():
        raise ValueError("no gene is left")
    return df


def flip_y(df: DataFrame, y: str = "y_location") -> DataFrame:
    """y counted from the largest one downwards."""
    top = df.agg(F.max(y).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn(y, F.col("__top") - F.col(y)).drop("__top")


def scaled(df: DataFrame, factor: float, columns: tuple[str, ...] = ("x_location", "y_location")) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in columns})


def to_level_pixels(df: DataFrame, factor: float, height: float, x: str, y: str) -> DataFrame:
    """Full-resolution pixels to those of a level, y upwards."""
    return df.withColumns({x: F.col(x) * factor, y: height - F.col(y) * factor})


def to_image_pixels(df: DataFrame, box: tuple[float, float, float, float], width: float, height: float, x: str, y: str) -> DataFrame:
    """Physical coordinates to pixels of an image that shows the box (x0, x1, y0, y1), y downwards."""
    x0, x1, y0, y1 = box
    return df.withColumns({x: (F.col(x) - x0) / (x1 - x0) * width, y: (y1 - F.col(y)) / (y1 - y0) * height})


def crosses(px: Column, py: Column, ring: Column) -> Column:
    """Whether the point is strictly inside the closed ring array<struct<x,y>>: an odd number of edges to its right, none through it."""
    edges = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(ring[i]["x"].alias("ax"), ring[i]["y"].alias("ay"), ring[i + 1]["x"].alias("bx"), ring[i + 1]["y"].alias("by")))
    turn = lambda e: (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
    within = lambda e: px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
    right = lambda e: ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    hits = F.size(F.filter(edges, lambda e: F.coalesce(right(e), F.lit(False))))
    return ~F.exists(edges, lambda e: (turn(e) == 0) & within(e)) & (hits % 2 == 1)


def in_ring(df: DataFrame, ring: list[tuple[float, float]], x: str, y: str) -> DataFrame:
    """Points strictly inside one polygon (points on its edge are out), behind a test of its box that scans can use."""
    closed = [*ring, ring[0]] if ring[0] != ring[-1] else ring
    xs, ys = [p[0] for p in closed], [p[1] for p in closed]
    literal = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in closed])
    return df.where(F.col(x).between(float(min(xs)), float(max(xs))) & F.col(y).between(float(min(ys)), float(max(ys)))).where(crosses(F.col(x), F.col(y), literal))


def is_box(ring: Column) -> Column:
    """Whether a closed ring is a rectangle along the axes: four edges along them, and both pairs of opposite corners differ in x and in y."""
    at = lambda i: F.get(ring, F.lit(i))
    along = lambda i: (at(i)["x"] == at(i + 1)["x"]) != (at(i)["y"] == at(i + 1)["y"])
    apart = lambda i: (at(i)["x"] != at(i + 2)["x"]) & (at(i)["y"] != at(i + 2)["y"])
    return F.coalesce((F.size(ring) == 5) & (at(0) == at(4)) & reduce(Column.__and__, [along(i) for i in range(4)]) & apart(0) & apart(1), F.lit(False))


#: Bits of the table that tells where polygons lie.
NEAR_BITS = 1 << 20


def near_boxes(points: DataFrame, boxed: DataFrame, x: str, y: str) -> DataFrame:
    """points without most of those that no box (__x0, __x1, __y0, __y1, of a __side near its own) can hold: squares of the largest side that
    boxes touch set bits of a table of 128 KB, by their hash. It is a plain filter, so joins below points take it before they shuffle."""
    top = boxed.select("__side").distinct().agg(F.max("__side").alias("__top"))
    at = lambda c: F.floor(F.col(c) / F.col("__top"))
    bit = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(NEAR_BITS)).cast("int")
    squares = boxed.crossJoin(F.broadcast(top)).withColumn("__sx", F.explode(F.sequence(at("__x0"), at("__x1")))).withColumn("__sy", F.explode(F.sequence(at("__y0"), at("__y1"))))
    words = squares.select(bit("__sx", "__sy").alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, __bit & 63))").alias("__set"))
    every = boxed.sparkSession.range(NEAR_BITS // 64).select(F.col("id").cast("int").alias("__word")).join(words, "__word", "left")
    table = every.agg(F.array_sort(F.collect_list(F.struct("__word", F.coalesce("__set", F.lit(0).cast("long")).alias("__set")))).alias("t")).select(F.col("t")["__set"])
    mine = bit(F.floor(F.col(x) / top.scalar()), F.floor(F.col(y) / top.scalar()))
    word = F.get(table.scalar(), F.shiftright(mine, 6))
    return points.where(F.call_function("shiftright", word, mine.bitwiseAND(63)).bitwiseAND(F.lit(1)) == 1)


def locate(points: DataFrame, polygons: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """points joined with the polygons (label_id, ring) they are strictly inside of. Polygons are dealt to the squares that their boxes
    touch, of a side near their own: `cell` halved or doubled until it is, so that a polygon has nine squares at most. Points stand in
    one square of each side that occurs and meet only polygons of it whose box holds them: an equi-join whatever the numbers. Only rings
    that aren't boxes themselves need a look at their edges; they have a join of their own, so that the other stays compiled. Polygons of
    the same ring are met once and listed after that, and points far from all polygons go before anything is shuffled. A square's points are
    in one task, by their place, so that results have the same lists one after the other, which files hold in little; as the join
    multiplies rows, parts are four times as many as the session's shuffles have and aren't merged."""
    end = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    boxed = polygons.select("label_id", "ring", *[end(f, k).alias(f"__{k}{n}") for k in "xy" for n, f in enumerate((F.array_min, F.array_max))], is_box(F.col("ring")).alias("__box"))
    extent = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"))
    boxed = boxed.where((F.col("__x0") < F.col("__x1")) & (F.col("__y0") < F.col("__y1")) & (extent < float("inf")))
    boxed = boxed.withColumn("__level", F.round(F.log2(extent / cell)).cast("int")).withColumn("__side", cell * F.pow(F.lit(2.0), F.col("__level")))
    at = lambda c: F.floor(F.col(c) / F.col("__side"))
    box = ["__x0", "__x1", "__y0", "__y1", "__level", "__side"]
    once = lambda some, *more: some.groupBy(*box, *more).agg(F.collect_list(F.struct("label_id")).alias("__labels"))  # noqa: E731  # structs, as lists leave out nulls
    dealt = lambda some: some.withColumn("__sx", F.explode(F.sequence(at("__x0"), at("__x1")))).withColumn("__sy", F.explode(F.sequence(at("__y0"), at("__y1"))))
    placed = near_boxes(points, boxed, x, y).crossJoin(F.broadcast(boxed.select("__level", "__side").distinct())).withColumns({"__sx": at(x), "__sy": at(y)}).drop("__side")
    square = ["__sx", "__sy", "__level"]
    placed = placed.repartition(4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *square).sortWithinPartitions(*square, x, y)
    held = (F.col(x) > F.col("__x0")) & (F.col(x) < F.col("__x1")) & (F.col(y) > F.col("__y0")) & (F.col(y) < F.col("__y1"))
    met = lambda some: placed.join(dealt(some), square).where(held)
    boxes = met(once(boxed.where("__box")))
    others = met(once(boxed.where("NOT __box"), "ring")).where(crosses(F.col(x), F.col(y), F.col("ring"))).drop("ring")
    return boxes.union(others).select("*", F.inline("__labels")).drop("__sx", "__sy", "__labels", *box)
