from pyspark.sql import functions as F

from tessella.scope import Scope
from tessella.sources.tables import cell_counts, molecules
from tessella.streaming import binning

SF = "/root/testdata/sf0.001"


def test_workflow(spark):
    scope = Scope.create(molecules(spark, SF), [100.0, 200.0], cells=cell_counts(spark, SF))
    scope = scope.normalise("grid200").compute_weights("grid200").compute_l("grid200", dense=True).compute_correlation("grid200").normalise_cells()
    assert set(scope.grids) == {"grid100", "grid200"}
    assert scope.stats["L_Xz"].count() == 300 == scope.stats["r"].count()
    assert scope.top_l_vs_r(n=5).count() >= 5
    assert scope.compute_l_visium("grid200", top=6).stats["L_Xz_visium"].count() == 15
    scope = scope.compute_density("grid200", "d", F.col("gene") == "Brand#11").compute_idelta("grid200")
    assert scope.density["d"].count() == scope.grids["grid200"].info.count()
    assert scope.cluster_genes(restarts=2).stats["modules"].count() <= 25


def test_stream_equals_table(spark, tmp_path):
    m = molecules(spark, SF).select("feature_name", "x_location", "y_location")
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    q = binning.start(stream, 100.0, 0.0, 0.0, str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination(120)
    want = sorted(map(tuple, binning.tile_counts(m, 100.0, 0.0, 0.0).collect()))
    assert sorted(map(tuple, binning.latest(spark, str(tmp_path / "o")).collect())) == want
    late = binning.tile_counts(m.withColumn("ts", F.lit("2024-01-01 00:30:00").cast("timestamp")), 100.0, 0.0, 0.0, "1 hour")
    assert late.agg(F.sum("count")).first()[0] == m.count()
