import pytest

from tessella.operators import weights


def lattice(spark, nx, ny, center=lambda x, y: (float(x), float(y))):
    return spark.createDataFrame([(f"g{x}_{y}", x, y, *center(x, y)) for x in range(1, nx + 1) for y in range(1, ny + 1)], "grid_id string, gx int, gy int, center_x double, center_y double")


def degree(edges):
    return {r.i: r["count"] for r in edges.groupBy("i").count().collect()}


@pytest.mark.parametrize(("topology", "inner", "corner"), [("rook", 4, 2), ("queen", 8, 3), ("hex-oddr", 6, None), ("hex-evenr", 6, None), ("hex-oddq", 6, None), ("hex-evenq", 6, None)])
def test_degrees(spark, topology, inner, corner):
    e = weights.neighbours(lattice(spark, 5, 5), topology)
    d = degree(e)
    assert d["g3_3"] == inner and (corner is None or d["g1_1"] == corner)
    pairs = {(r.i, r.j) for r in e.collect()}
    assert all((j, i) in pairs for i, j in pairs) and all(i != j for i, j in pairs)


@pytest.mark.parametrize("style", ["W", "kernel_gaussian", "kernel_flat"])
@pytest.mark.parametrize("topology", ["queen", "rook", "hex-oddr", "hex-evenq"])
def test_rows_sum_to_one(spark, style, topology):
    row = weights.check_weights(weights.weights(lattice(spark, 4, 6), style, topology), 1e-12).first()
    assert row.finite and row.rows_sum_to_one


def test_hex_distances(spark):
    e = weights.neighbours(lattice(spark, 7, 7), "hex-oddr", 2)
    d = [r.d2 for r in e.where("i = 'g4_4'").collect()]
    assert sorted(d) == [1.0] * 6 + [4.0] * 12


def test_orders(spark):
    line = lattice(spark, 6, 1)
    base = weights.neighbours(line, "queen").select("i", "j")
    assert degree(weights.higher_order(base, 2))["g3_1"] == 4
    edges, order = weights.expanded(line, "queen", 3.0)
    assert order == 2 and edges.count() == 18
    assert weights.expanded(line, "queen", 99.0, 3)[1] == 3


def test_topologies(spark):
    assert weights.choose_topology(lattice(spark, 6, 6)) == "queen"
    assert weights.choose_topology(lattice(spark, 6, 6), "rook") == "rook"
    assert weights.choose_topology(lattice(spark, 6, 6), None, "Xenium") == "queen"
    pushed = lambda x, y: (x + 0.5 * ((y - 1) % 2), y * 0.8660254)
    assert weights.choose_topology(lattice(spark, 8, 8, pushed), None, "Visium") == "hex-oddr"
    with pytest.raises(ValueError):
        weights.neighbours(lattice(spark, 2, 2), "other")
    with pytest.raises(ValueError):
        weights.weights(lattice(spark, 2, 2), "U")


def test_ambiguous_lattice(spark):
    bad = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), (None, 0, 2)], "grid_id string, gx int, gy int")
    row = weights.check_lattice(bad).first()
    assert (row.repeated_places, row.bad_names, row.out_of_range) == (2, 1, 1)
    with pytest.raises(ValueError):
        weights.validated(bad)
    assert weights.validated(lattice(spark, 2, 2)).count() == 4
