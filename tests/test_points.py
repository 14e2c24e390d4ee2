import pytest
from pyspark.sql import functions as F

from tessella.operators import grids, points
from tessella.operators.ranking import parse_quantile
from tessella.sources import readers


def mols(spark, rows):
    return spark.createDataFrame(rows, "feature_name string, x_location double, y_location double, qv double, nucleus_distance double")


def test_filters(spark):
    df = mols(spark, [("A", 1.0, 2.0, 20.0, 25.0), ("A", 1.0, 2.0, 19.9, 0.0), ("B", 1.0, 5.0, 40.0, None), ("NegControlX", 0.0, 0.0, 40.0, 0.0)])
    assert points.good_quality(df).count() == 3
    assert points.near_nucleus(df).count() == 3  # a null distance drops
    assert points.without_controls(df).count() == 3
    assert points.allow_genes(df, spark.createDataFrame([("A",), ("A",)], "gene string")).count() == 2
    assert sorted(r.y_location for r in points.flip_y(df).collect()) == [0.0, 3.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        points.gene_panel(df, ("A", "B", "Neg"), column="feature_name")


@pytest.mark.parametrize(("x", "y", "inside"), [(1, 1, True), (0, 1, False), (4, 4, False), (2, 2, False), (3, 1, True), (1, 3.5, False), (3.9, 3.95, False), (5, 1, False), (3.5, 3, True)])
def test_strictly_inside(spark, x, y, inside):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]
    df = spark.createDataFrame([(float(x), float(y))], "x double, y double")
    want = inside if (x, y) != (1, 3.5) else False
    assert bool(points.in_ring(df, ring, "x", "y").count()) == want


def test_locate_equals_one_by_one(spark):
    import random

    rng = random.Random(1)
    pts = spark.createDataFrame([(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(300)], "id int, x double, y double")
    v = [(c, f"l{c}", 10.0 * c + dx, 5.0 * c + dy, k) for c in range(5) for k, (dx, dy) in enumerate(((0, 0), (9, 1), (7, 8), (2, 6)))]
    poly = readers.boundaries(spark.createDataFrame(v, "cell_id int, label_id string, vertex_x double, vertex_y double, pos int"))
    got = {(r.id, r.label_id) for r in points.locate(pts, poly, 4.0).select("id", "label_id").collect()}
    want = set()
    for r in poly.collect():
        want |= {(p.id, r.label_id) for p in points.in_ring(pts, [(q.x, q.y) for q in r.ring], "x", "y").collect()}
    assert got == want and got


def test_locate_polygons_of_all_sizes(spark):
    """Boxes, diamonds, triangles and flat rings from 0.01 to 10,000 wide, against squares far too small for them."""
    import random

    rng = random.Random(2)
    shapes = [((0, 0), (1, 0), (1, 1), (0, 1)), ((1, 1), (1, 0), (0, 0), (0, 1)), ((0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)), ((0, 0), (1, 0), (0.3, 1)), ((0, 0), (1, 0), (0.5, 0)), ((0, 0), (1, 1), (1, 0), (0, 1))]
    rings = [(f"l{i}", [(x + w * dx, y + w * dy) for dx, dy in shapes[i % 6]]) for i in range(48) for w, x, y in [(10.0 ** (i // 6 % 7 - 2), float(rng.randint(-9, 9)), float(rng.randint(-9, 9)))]]
    xy = [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(150)] + [v for _, ring in rings for v in ring] + [((a + c) / 2 + e, (b + d) / 2 + e / 3) for _, ((a, b), (c, d), *_) in rings for e in (0.0, 1e-3, -1e-3)]
    pts = spark.createDataFrame([(i, *v) for i, v in enumerate(xy)], "id int, x double, y double").withColumn("a.b", F.lit(1))
    poly = spark.createDataFrame([(n, [*ring, ring[0]]) for n, ring in rings], "label_id string, ring array<struct<x: double, y: double>>")
    out = points.locate(pts, poly, 1e-6)
    assert out.columns == ["id", "x", "y", "a.b", "label_id"]
    got = [(r.id, r.label_id) for r in out.select("id", "label_id").collect()]
    want = [(r.id, r.label_id) for r in pts.crossJoin(poly).where(points.crosses(F.col("x"), F.col("y"), F.col("ring"))).select("id", "label_id").collect()]
    assert sorted(got) == sorted(want) and {int(n[1:]) % 6 for _, n in got} == {0, 1, 2, 3, 5}


def written_and_met(df):
    """Rows that shuffles wrote in the run of df, and rows that came out of its joins by sorting or hashing."""
    written, met, todo = [], [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name != "ReusedExchange":
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if name == "Exchange":
                written.append(node.metrics().apply("shuffleRecordsWritten").value())
            if name in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin"):
                met.append(node.metrics().apply("numOutputRows").value())
    return sum(written), sum(met)


def test_locate_shuffles_only_near_points_and_meets_copies_once(spark):
    """2,000 points of a join, 20 of them in forty boxes of one place and twenty diamonds of another; a label that is null is one too."""
    pts = spark.range(2000).select("id", (F.col("id") % 100 + 0.5).alias("x"), (F.floor(F.col("id") / 100) * 1000 + 0.5).alias("y"))
    pts = pts.join(spark.range(2000).hint("merge"), "id")
    box, diamond = [(5.0, 0.0), (15.0, 0.0), (15.0, 10.0), (5.0, 10.0)], [(35.5, -4.5), (40.5, 0.5), (35.5, 5.5), (30.5, 0.5)]
    rings = [(f"b{i}" if i else None, [*box, box[0]]) for i in range(40)] + [(f"d{i}", [*diamond, diamond[0]]) for i in range(20)]
    poly = spark.createDataFrame(rings, "label_id string, ring array<struct<x: double, y: double>>")
    out = points.locate(pts, poly, 8.0).select("id", "label_id")
    got = [(r.id, r.label_id) for r in out.collect()]
    want = [(i, n) for i in range(5, 15) for n, _ in rings[:40]] + [(i, n) for i in range(31, 40) for n, _ in rings[40:]]
    assert sorted(got, key=str) == sorted(want, key=str)
    written, met = written_and_met(out)
    assert written < 2000 + 300 and met < 2 * 100  # the join's other side is all that is shuffled whole


def test_near_boxes_leaves_out_no_held_point(spark):
    pts = spark.createDataFrame([(1.5, 1.5), (1000.5, 7.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (9e5, 9e5)], "x double, y double")
    boxed = spark.createDataFrame([(1.0, 2.0, 1.0, 2.0, 1.0), (990.0, 1010.0, -5.0, 9.0, 16.0)], "__x0 double, __x1 double, __y0 double, __y1 double, __side double")
    assert {(1.5, 1.5), (1000.5, 7.0)} <= (kept := {(r.x, r.y) for r in points.near_boxes(pts, boxed, "x", "y").collect()}) and (9e5, 9e5) not in kept
    assert points.near_boxes(pts, boxed.limit(0), "x", "y").count() == 0 == points.locate(pts, spark.createDataFrame([], "label_id string, ring array<struct<x: double, y: double>>"), 1.0).count()


@pytest.mark.parametrize(("ring", "box"), [("0 0 2 0 2 1 0 1 0 0", True), ("0 1 2 1 2 0 0 0 0 1", True), ("0 0 0 1 2 1 2 0 0 0", True), ("0 0 2 0 2 1 0 2 0 0", False), ("0 0 2 0 0 0 2 0 0 0", False), ("0 0 2 1 2 0 0 1 0 0", False), ("1 0 2 1 1 2 0 1 1 0", False), ("0 0 2 0 2 1 0 0", False), ("0 0 2 0 2 1 0 1 0 2", False), ("0 0 0 0 2 1 2 1 0 0", False)])
def test_which_rings_are_boxes(spark, ring, box):
    v = [float(c) for c in ring.split()]
    df = spark.createDataFrame([(list(zip(v[::2], v[1::2], strict=True)),)], "ring array<struct<x: double, y: double>>")
    assert df.select(points.is_box(F.col("ring")).alias("b")).first().b is box


def test_tiles_and_last_break(spark):
    df = mols(spark, [("A", 0.0, 0.0, 40.0, 0.0), ("B", 25.0, 10.0, 40.0, 0.0), ("B", 19.0, 9.0, 40.0, 0.0)])
    all_tiles = grids.tiles(grids.bounds(df), 10.0, keep_partial=True)
    assert sorted((r.gx, r.gy, r.width) for r in all_tiles.collect()) == [(1, 1, 10.0), (2, 1, 10.0), (3, 1, 5.0)]
    assert grids.tiles(grids.bounds(df), 10.0).count() == 2
    info, counts = grids.layer(df, 10.0)
    # the point on the last break of y is in a tile that the table doesn't have
    assert sorted((r.grid_id, r.gene, r["count"]) for r in counts.collect()) == [("g1_1", "A", 1), ("g2_1", "B", 1)]
    assert {r.grid_id for r in info.collect()} == {"g1_1", "g2_1"}


def test_several_sizes_in_one_scan(spark):
    df = mols(spark, [("A", float(i), float(i % 7), 40.0, 0.0) for i in range(100)])
    out = grids.bin_points(df, [10.0, 20.0])
    assert out.groupBy("length").sum("count").count() == 2
    assert {r["sum(count)"] for r in out.groupBy("length").sum("count").collect()} == {100}


def test_quantile_names():
    assert parse_quantile("q95") == 0.95 and parse_quantile("Q2.5") == 0.025
    with pytest.raises(ValueError):
        parse_quantile("95")


def test_segmented_tiles_are_skipped_when_none_qualifies(spark):
    counts = spark.createDataFrame([("a", "g", 1), ("b", "g", 1)], "grid_id string, gene string, count int")
    tagged = spark.createDataFrame([("a",), ("a",)], "grid_id string")
    assert [r.grid_id for r in grids.segmented_tiles(counts, tagged, 2).collect()] == ["a"]
    assert grids.segmented_tiles(counts, tagged, 3).count() == 2
