"""Spatial weights as edge tables (i, j, w) over the tiles of a lattice.

Neighbours are found by equi-joins on shifted lattice coordinates, so nothing but the tiles that exist is ever made.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOPOLOGIES = ("rook", "queen", "hex-oddr", "hex-evenr", "hex-oddq", "hex-evenq")


def square_offsets(radius: int, queen: bool) -> list[tuple[int, int, int]]:
    """(dx, dy, d2) of the square (queen) or the diamond (rook) of that radius, without its centre."""
    reach = range(-radius, radius + 1)
    return [(dx, dy, dx * dx + dy * dy) for dx in reach for dy in reach if (dx or dy) and (queen or abs(dx) + abs(dy) <= radius)]


def hex_offsets(radius: int) -> list[tuple[int, int, int]]:
    """(dq, dr, distance) in cube coordinates, up to that distance."""
    reach = range(-radius, radius + 1)
    return [(q, r, max(abs(q), abs(r), abs(q + r))) for q in reach for r in reach if 0 < max(abs(q), abs(r), abs(q + r)) <= radius]


def shifted(info: DataFrame, topology: str, radius: int) -> DataFrame:
    """(i, gx, gy, d2) for each tile i and offset: where its neighbour would stand and the squared distance (hexagons: steps squared)."""
    table = lambda rows: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(c)).alias("d2")) for a, b, c in rows])
    if topology in ("rook", "queen"):
        each = info.select(F.col("grid_id").alias("i"), "gx", "gy", F.explode(table(square_offsets(radius, topology == "queen"))).alias("o"))
        return each.select("i", (F.col("gx") + F.col("o.a")).alias("gx"), (F.col("gy") + F.col("o.b")).alias("gy"), F.col("o.d2").alias("d2"))
    by_row = topology.endswith("r")
    line, along = ("gy", "gx") if by_row else ("gx", "gy")  # rows (or columns) that are pushed by half a tile
    push = lambda c: F.pmod(c - 1, F.lit(2)) if "odd" in topology else F.pmod(c, F.lit(2))  # noqa: E731  tiles count from 1
    each = info.select(F.col("grid_id").alias("i"), F.col(line).alias("l"), F.col(along).alias("c"), F.explode(table([(q, r, d * d) for q, r, d in hex_offsets(radius)])).alias("o"))
    # Offset to axial: q = c - (l - push) / 2; the target line is l + r, its column the inverse.
    half = lambda c: ((c - push(c)) / 2).cast("int")
    to_line = F.col("l") + F.col("o.b")
    to_col = F.col("c") - half(F.col("l")) + F.col("o.a") + half(to_line)
    return each.select("i", to_col.cast("int").alias(along), to_line.cast("int").alias(line), F.col("o.d2").alias("d2"))


def neighbours(info: DataFrame, topology: str = "queen", radius: int = 1) -> DataFrame:
    """(i, j, d2) of all ordered pairs of existing tiles within the radius."""
    if topology not in TOPOLOGIES:
        raise ValueError(f"topology {topology!r}")
    return shifted(info, topology, radius).join(info.select("gx", "gy", F.col("grid_id").alias("j")), ["gx", "gy"]).select("i", "j", "d2")


def row_normalised(edges: DataFrame) -> DataFrame:
    """Weights of each i divided by their sum; rows without weight stay as they are."""
    total = F.sum("w").over(Window.partitionBy("i"))
    return edges.withColumn("w", F.when(total == 0, F.col("w")).otherwise(F.col("w") / total))


def kernel_weights(info: DataFrame, topology: str, kernel: str = "gaussian", radius: int = 2, sigma: float = 1.0) -> DataFrame:
    """Row-normalised weights within a radius: exp(-d2 / (2 sigma^2)) or equal ones."""
    w = F.exp(-F.col("d2") / (2.0 * sigma * sigma)) if kernel == "gaussian" else F.lit(1.0)
    return row_normalised(neighbours(info, topology, radius).select("i", "j", w.alias("w")))


def weights(info: DataFrame, style: str = "B", topology: str = "queen", order: int = 1, radius: int = 2, sigma: float = 1.0) -> DataFrame:
    """Edges (i, j, w). style: B (1 each), W (rows sum to 1), kernel_gaussian, kernel_flat. Tiles without neighbours have no edges."""
    if style.startswith("kernel_"):
        return kernel_weights(info, topology, style.removeprefix("kernel_"), radius, sigma)
    if style not in ("B", "W"):
        raise ValueError(f"style {style!r}")
    edges = higher_order(neighbours(info, topology).select("i", "j"), order).withColumn("w", F.lit(1.0))
    return row_normalised(edges) if style == "W" else edges


def higher_order(edges: DataFrame, order: int) -> DataFrame:
    """(i, j) of tiles within `order` steps."""
    reached = edges.select("i", "j")
    front = reached
    for _ in range(order - 1):
        step = front.withColumnRenamed("j", "k").join(edges.select(F.col("i").alias("k"), "j"), "k").select("i", "j").where("i <> j").distinct()
        front = step.join(reached, ["i", "j"], "left_anti")
        reached = reached.union(front)
    return reached


def expanded(info: DataFrame, topology: str, min_neighbours: float, max_order: int = 4) -> tuple[DataFrame, int]:
    """Edges of the least order at which tiles have min_neighbours on average, max_order at most; the driver sees one number an order."""
    base = neighbours(info, topology).select("i", "j")
    n = info.count()
    for order in range(1, max_order + 1):
        edges = higher_order(base, order)
        if order == max_order or edges.count() >= min_neighbours * max(n, 1):
            return edges, order
    raise ValueError("max_order must be positive")


def check_weights(edges: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: edges, whether all are finite, binary, and all row sums 0 or 1."""
    rows = edges.groupBy("i").agg(F.sum("w").alias("s"), F.count("*").alias("n"), F.min((~F.isnan("w") & (F.abs("w") < float("inf"))).cast("int")).alias("finite"), F.min(F.col("w").isin(0.0, 1.0).cast("int")).alias("binary"))
    return rows.agg(F.sum("n").alias("edges"), (F.min("finite") == 1).alias("finite"), (F.min("binary") == 1).alias("binary"), F.min((F.abs(F.col("s") - 1.0) <= tolerance) | (F.abs("s") <= tolerance)).alias("rows_sum_to_one"))


def check_lattice(info: DataFrame) -> DataFrame:
    """One row: tiles, tiles with repeated places, with repeated or empty names, with places that aren't positive."""
    place = F.count("*").over(Window.partitionBy("gx", "gy"))
    name = F.count("*").over(Window.partitionBy("grid_id"))
    bad = lambda c: F.sum(c.cast("long"))
    return info.select("gx", "gy", "grid_id", (place > 1).alias("again"), (F.coalesce(name > 1, F.lit(True)) | F.col("grid_id").isNull() | (F.col("grid_id") == "")).alias("name"), ((F.col("gx") < 1) | (F.col("gy") < 1)).alias("range")).agg(F.count("*").alias("tiles"), bad(F.col("again")).alias("repeated_places"), bad(F.col("name")).alias("bad_names"), bad(F.col("range")).alias("out_of_range"))


def validated(info: DataFrame) -> DataFrame:
    """info; an error unless check_lattice() finds nothing."""
    row = check_lattice(info).first()
    if row.repeated_places or row.bad_names or row.out_of_range:
        raise ValueError(f"not a lattice: {row.asDict()}")
    return info


def angles(info: DataFrame) -> DataFrame:
    """(kind, angle, distance) between the centres of each tile and its neighbours ahead: right, up, and both diagonals up."""
    ahead = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in (("horizontal", 1, 0), ("vertical", 0, 1), ("diagonal", 1, 1), ("diagonal", -1, 1))])
    each = info.select("gx", "gy", F.col("center_x").alias("ax"), F.col("center_y").alias("ay"), F.explode(ahead).alias("o")).select((F.col("gx") + F.col("o.a")).alias("gx"), (F.col("gy") + F.col("o.b")).alias("gy"), "ax", "ay", F.col("o.kind").alias("kind"))
    met = each.join(info.select("gx", "gy", "center_x", "center_y"), ["gx", "gy"]).withColumns({"dx": F.col("center_x") - F.col("ax"), "dy": F.col("center_y") - F.col("ay")})
    return met.select("kind", F.degrees(F.atan2(F.abs("dy"), F.abs("dx"))).alias("angle"), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("distance"))


def hex_evidence(info: DataFrame) -> DataFrame:
    """One row: share of neighbour angles near 60 or 120 degrees, of flat and of upright ones, and mean diagonal by axis distance."""
    a = angles(info)
    near = lambda at: (F.abs(F.col("angle") - at) <= 10.0).cast("double")
    return a.agg(F.avg(F.greatest(near(60.0), near(120.0))).alias("hex_share"), F.avg(near(0.0)).alias("horizontal_share"), F.avg(near(90.0)).alias("vertical_share"), F.try_divide(F.avg(F.when(F.col("kind") == "diagonal", F.col("distance"))), F.avg(F.when(F.col("kind") != "diagonal", F.col("distance")))).alias("ratio"))


def choose_topology(info: DataFrame, forced: str | None = None, platform: str | None = None) -> str:
    """What is asked for, else by platform (Xenium: queen; Visium: hexagons), else by geometry, else queen."""
    if forced not in (None, "auto"):
        return forced
    if platform == "Xenium":
        return "queen"
    e = hex_evidence(info).first()
    looks = e.hex_share is not None and e.hex_share >= 0.4 and max(e.horizontal_share, e.vertical_share) < 0.8 and e.ratio is not None and abs(e.ratio - 1) <= 0.2
    return hex_variant(info) if platform == "Visium" or looks else "queen"


def hex_variant(info: DataFrame) -> str:
    """Which lines are pushed: rows if a row's centres share their height, else columns; and whether odd or even ones (from 0)."""
    spread = lambda by, c: info.groupBy(by).agg(F.stddev_pop(c).alias("s")).agg(F.avg("s")).first()[0] or 0.0
    by_row = spread("gy", "center_y") <= spread("gx", "center_x")
    line, along = ("gy", "center_x") if by_row else ("gx", "center_y")
    parity = info.groupBy(F.pmod(F.col(line) - 1, F.lit(2)).alias("odd")).agg(F.min(along).alias("low")).collect()
    low = {r.odd: r.low for r in parity}
    return f"hex-{'odd' if low.get(1, math.inf) > low.get(0, -math.inf) else 'even'}{'r' if by_row else 'q'}"


def cell_sizes(info: DataFrame) -> DataFrame:
    """(gx, step): median distance of neighbouring centres in each column."""
    step = F.col("center_y") - F.lag("center_y").over(Window.partitionBy("gx").orderBy("center_y"))
    return info.select("gx", step.alias("step")).where("step is not null").groupBy("gx").agg(F.percentile("step", F.lit(0.5)).alias("step"))


def diffuse(values: DataFrame, edges: DataFrame, alpha: float = 0.5, steps: int = 1) -> DataFrame:
    """(i, gene, value): value + alpha * W value, kept within 0 and 1, so often; tiles that only neighbours reach appear."""
    now = values
    for _ in range(steps):
        lag = edges.join(now.withColumnRenamed("i", "j"), "j").groupBy("i", "gene").agg((F.sum(F.col("w") * F.col("value")) * alpha).alias("value"))
        now = now.select("i", "gene", "value").union(lag.select("i", "gene", "value")).groupBy("i", "gene").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum("value"))).alias("value"))
    return now


def fuzzy_jaccard(values: DataFrame) -> DataFrame:
    """(gene1, gene2, jaccard) = sum of least values / sum of greatest; the greatest are totals less the least, so only shared tiles meet."""
    a, b = values.select("i", F.col("gene").alias("gene1"), F.col("value").alias("u")), values.select("i", F.col("gene").alias("gene2"), F.col("value").alias("v"))
    low = a.join(b, "i").where("gene1 < gene2").groupBy("gene1", "gene2").agg(F.sum(F.least("u", "v")).alias("low"))
    total = values.groupBy("gene").agg(F.sum("value").alias("t"))
    both = low.join(total.select(F.col("gene").alias("gene1"), F.col("t").alias("t1")), "gene1").join(total.select(F.col("gene").alias("gene2"), F.col("t").alias("t2")), "gene2")
    return both.select("gene1", "gene2", F.try_divide(F.col("low"), F.col("t1") + F.col("t2") - F.col("low")).alias("jaccard"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(A + A') / 2, once a pair."""
    key = lambda f: f(F.col("i"), F.col("j"))
    return edges.groupBy(key(F.least).alias("i"), key(F.greatest).alias("j")).agg((F.sum("w") / 2.0).alias("w"))
