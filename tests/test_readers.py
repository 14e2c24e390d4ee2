import json

import pytest

from tessella.sources import readers


def test_platforms():
    assert readers.detect_platform({"spatial", "raw_feature_bc_matrix", "transcripts.parquet"}) == "visium"
    assert readers.detect_platform({"spatial"}, {"scalefactors_json.json"}) == "visium"
    assert readers.detect_platform({"cells.parquet"}) == "xenium"
    assert readers.detect_platform({"flatFiles"}) == "cosmx"
    assert readers.detect_platform(set(), prefer="cosmx") == "cosmx"
    with pytest.raises(ValueError):
        readers.detect_platform({"other"})


def test_listing_and_molecules(spark, tmp_path):
    path = str(tmp_path / "d" / "transcripts.parquet")
    spark.createDataFrame([(1.0, 2.0, "A")], "x_location double, y_location double, feature_name string").write.parquet(path)
    assert readers.listing(spark, str(tmp_path / "d")) == {"transcripts.parquet"} and readers.listing(spark, str(tmp_path / "no")) == set()
    r = readers.read_molecules(spark, path).first()
    assert r.qv == float("inf") and r.nucleus_distance == 0.0


def test_cosmx_by_header_and_by_place(spark):
    named = spark.createDataFrame([(10.0, 20.0, "A", None)], "x_global_px double, y_global_px double, target string, qv double")
    r = readers.cosmx_molecules(named).first()
    assert r.x_location == pytest.approx(1.20280945) and r.qv == float("inf") and r.feature_name == "A"
    placed = spark.createDataFrame([("1", "2", "3", "4", "5", "10", "20", "7", "B", "30")], ", ".join(f"_c{i} string" for i in range(10)))
    r = readers.cosmx_molecules(placed).first()
    assert (r.feature_name, r.nucleus_distance, r.qv) == ("B", 7.0, 30.0)


def test_wide_and_keys(spark):
    wide = spark.createDataFrame([(1, "7", 2, 0, 5)], "fov int, cell_ID string, A int, B int, NegPrb3 int")
    assert [(r.gene, r["count"]) for r in readers.wide_to_long(wide, ["fov", "cell_ID"]).collect()] == [("A", 2)]
    expr = spark.createDataFrame([(c, f) for c in range(4) for f in (1, 2)], "cell int, fov int")
    cells = spark.createDataFrame([("0_2",), ("1_2",), ("3_3",)], "cell string")
    assert readers.best_key(expr, cells) == "fov_plus"


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% c\n3 2 3\n1 1 5\n3 1 2\n2 2 0\n")
    (tmp_path / "f.tsv").write_text("e1\tG1\tx\ne2\tG2\tx\ne3\tG1\tx\n")
    (tmp_path / "b.tsv").write_text("AA\nBB\n")
    m = readers.read_mtx(spark, str(tmp_path / "m.mtx"))
    assert m.count() == 3
    f = readers.unique_names(readers.numbered_lines(spark, str(tmp_path / "f.tsv"), ["id", "name", "type"]), "name", "index")
    b = readers.numbered_lines(spark, str(tmp_path / "b.tsv"), ["barcode"])
    got = sorted((r.grid_id, r.gene, r["count"]) for r in readers.mtx_counts(m, f, b).collect())
    assert got == [("AA", "G1", 5.0), ("AA", "G1.1", 2.0)]


def test_positions_and_scalefactors(spark, tmp_path):
    named = spark.createDataFrame([("A", "1", "2", "3", "4.5", "5")], "Barcode string, in_tissue string, Row string, array_col string, pxl_row_in_fullres string, imagecol string")
    r = readers.positions(named).first()
    assert (r.barcode, r.array_row, r.pxl_row_in_fullres) == ("A", 2, 4.5)
    assert readers.positions(spark.createDataFrame([("A", "0", "1", "1", "1", "1")], ", ".join(f"_c{i} string" for i in range(6)))).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"spot_diameter_fullres": 110.0}, indent=1))
    r = readers.read_scalefactors(spark, str(tmp_path / "s.json")).first()
    assert (r.microns_per_pixel, r.spot_um) == (0.5, 55.0)


def test_regions(spark):
    assert readers.roi_polygon(spark.createDataFrame([("1", "2")] * 3, "X string, Y string")).count() == 3
    with pytest.raises(ValueError):
        readers.roi_polygon(spark.createDataFrame([("1", "2")] * 2, "X string, Y string"))


def test_sinks_round_trip(spark, tmp_path):
    from tessella.sources import sinks

    m = spark.createDataFrame([(1.0, 2.0, 30.0, 0.5, "A")], "x_location double, y_location double, qv double, nucleus_distance double, feature_name string")
    c = spark.createDataFrame([(1, 2.0, 3.0)], "cell_id int, x_centroid double, y_centroid double")
    sinks.write_tables(str(tmp_path / "t"), m, c)
    assert readers.read_molecules(spark, str(tmp_path / "t/transcripts.parquet")).collect() == m.select([f.name for f in readers.MOLECULES.fields]).collect()
    pairs = spark.createDataFrame([(f"g{i}", f"h{j}", float(i * j)) for i in range(9) for j in range(5)], "gene1 string, gene2 string, weight double")
    sinks.write_pairs(pairs, str(tmp_path / "p"), 4)
    assert sinks.read_pairs(str(tmp_path / "p"), m).count() == 45 and sinks.read_pairs(str(tmp_path / "p"), m, "g3", 4).count() == 5
    sinks.write_edges(pairs.where("gene1 = 'g1'"), str(tmp_path / "e"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "e")).collect()) == [f"g1 h{j} {float(j)}" for j in range(5)]


def test_y_origin():
    assert readers.y_origin("auto", "Visium") == "top-left" == readers.y_origin("top-left", None) and readers.y_origin("auto", "Xenium") == "bottom-left"
