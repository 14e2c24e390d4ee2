import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessella.operators import tables


def test_alignment(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "k string, a int")
    b = spark.createDataFrame([("y", 1), ("z", 2), (None, 3)], "k string, b int")
    assert tuple(tables.alignment(a, b, "k").first()) == (1, 1, 1)
    with pytest.raises(ValueError):
        tables.require_aligned(a, b, "k")
    left, right = tables.aligned(a, b, "k")
    tables.require_aligned(left, right, "k")
    assert [r.a for r in left.collect()] == [3] and [r.b for r in right.collect()] == [1]
    assert tuple(tables.alignment(a.where("false"), b.where("false"), "k").first()) == (0, 0, 0)


def test_pairs_metadata_and_first(spark):
    a = spark.createDataFrame([("b", "a", 1.0), ("a", "c", 2.0)], "gene1 string, gene2 string, L double")
    b = spark.createDataFrame([("a", "b", 3.0), ("c", "d", 4.0)], "gene1 string, gene2 string, r double")
    assert [tuple(r) for r in tables.common_pairs(a, b).collect()] == [("a", "b", 1.0, 3.0)]
    meta = spark.createDataFrame([("a", 2, "q"), ("a", 1, "z")], "gene string, n int, s string")
    got = {r.gene: (r.n, r.s) for r in tables.with_metadata(spark.createDataFrame([("a",), ("b",)], "gene string"), meta).collect()}
    assert got == {"a": (1, "z"), "b": (None, None)}
    rows = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y"), ("a", 3, "w"), ("b", None, "v")], "k string, o int, s string")
    assert {tuple(r) for r in tables.first_of(rows, "k", "o").collect()} == {("a", 3, "w"), ("b", None, "v")}


def test_first_of_nulls_and_ties(spark):
    rows = spark.createDataFrame([("a", None, "x", 1), ("a", 5, None, 2), ("a", 5, "z", 3), ("a", 5, "y", 4), ("a", 6, "a", 0), ("b", None, "v", 5), ("c", 1, None, 6)], "k string, o int, s string, at int")
    got = lambda *a: {tuple(r) for r in tables.first_of(rows, "k", "o", *a).collect()}
    assert got(("at",)) == {("a", 5, None), ("b", None, "v"), ("c", 1, None)}
    assert got(("at",), True) == {("a", 5, "z"), ("b", None, None), ("c", 1, None)}
    assert got() == {("a", 5, None, 2), ("b", None, "v", 5), ("c", 1, None, 6)}


def test_first_occurrence_of_repeated_numbers(spark, tmp_path):
    """Line items with the same number count in the order of the file, as in the SQL on one thread; nulls are passed over."""
    rows = [(1, 1, 9, 2), (1, 1, 3, 2), (2, 1, 1, 1), (1, 2, None, 1), (1, 2, 8, 1), (1, 2, 7, 1), (None, 3, 5, 1), (4, 3, 6, 1), (4, 4, None, 1), (None, 5, 2, 1), (1, None, 4, 1), (1, None, 2, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = set(con.execute(__spark_entry__.oracle_sql()["WIN09_first_occurrence"]).fetchall())
    got = {tuple(r) for r in __spark_entry__.queries()["WIN09_first_occurrence"](spark, str(tmp_path)).collect()}
    assert got == want == {(1, 10, 9), (2, 9, 8), (3, 33, 6), (4, 33, None), (5, None, None), (None, 9, 4)}


def test_sets(spark):
    t = lambda *g: spark.createDataFrame([(x,) for x in g], "gene string")
    names = lambda d: sorted(r.gene for r in d.collect())
    assert names(tables.common([t("a", "b", "b"), t("b", "c"), t("b")])) == ["b"]
    assert names(tables.missing(t("a", "b", "a"), t("b"))) == ["a"] and names(tables.either([t("a", "b"), t("b")])) == ["a", "b"]
    both = tables.stacked([t("a"), t("b").withColumn("n", F.lit(1))]).collect()
    assert sorted((r.gene, r.n) for r in both) == [("a", None), ("b", 1)]


def test_tiles(spark):
    info = spark.createDataFrame([("t1",), ("t2",)], "grid_id string")
    counts = spark.createDataFrame([("t1", "a", 2), ("t1", "b", 3)], "grid_id string, gene string, count int")
    assert {tuple(r) for r in tables.over_tiles(info, counts).collect()} == {("t1", 5), ("t2", 0)}
    assert {tuple(r) for r in tables.over_tiles(info, counts, F.col("gene") == "a").collect()} == {("t1", 2), ("t2", 0)}
    modules = spark.createDataFrame([("a", 1), ("b", 2)], "gene string, module int")
    assert [tuple(r) for r in tables.module_presence(counts, modules, 1).collect()] == [(2, 1, 3)]
