"""Domain tables out of the driver's tables, which hold no tissue data: each line item stands for a molecule, each order for a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def molecules(spark: SparkSession, sf_dir: str, panel: str = "brand") -> DataFrame:
    """(mol_id, cell, feature_name, x_location, y_location, qv, nucleus_distance). panel "brand" has 25 genes, "type" 150."""
    return molecules_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), panel)


def molecules_of(lines: DataFrame, parts: DataFrame, panel: str = "brand") -> DataFrame:
    """molecules() of a table or stream of line items."""
    gene = F.col("p_brand") if panel == "brand" else F.concat_ws("/", "p_brand", "p_type")
    part = parts.select("p_partkey", gene.alias("feature_name"))
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mol_id"), F.col("l_orderkey").alias("cell"), "feature_name",
        (F.col("l_extendedprice") / 100.0).alias("x_location"), (F.col("l_quantity") * 20.0).alias("y_location"),
        (40.0 - 2.5 * cents("l_discount")).alias("qv"), (4.0 * cents("l_tax")).alias("nucleus_distance"),
    )


def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, gene, count)."""
    return molecules(spark, sf_dir).groupBy("cell", F.col("feature_name").alias("gene")).agg(F.count("*").cast("double").alias("count"))


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, gene, value): the embeddings as a dense matrix of 64 features."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("gene", "value")).select("sample", F.format_string("f%02d", "gene").alias("gene"), F.col("value").cast("double").alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, fov, x_centroid, y_centroid), one a customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), (F.col("c_custkey") % 4).cast("int").alias("fov"), (F.col("c_acctbal") / 10.0 + 100.0).alias("x_centroid"), (F.col("c_nationkey") * 40.0 + 21.0).alias("y_centroid"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, label_id, vertex_x, vertex_y, pos): a square of 8 around the centroid of each cell."""
    corner = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy")) for i, (dx, dy) in enumerate(((-4, -4), (4, -4), (4, 4), (-4, 4)))])
    return cells(spark, sf_dir).select("cell_id", F.concat(F.lit("c"), "cell_id").alias("label_id"), "x_centroid", "y_centroid", F.explode(corner).alias("c")).select("cell_id", "label_id", (F.col("x_centroid") + F.col("c.dx")).alias("vertex_x"), (F.col("y_centroid") + F.col("c.dy")).alias("vertex_y"), "c.pos")


def memberships(spark: SparkSession, sf_dir: str, runs: int = 8, labels: int = 4) -> DataFrame:
    """(gene, run, label): restarts of a clustering, by a hash of gene (mostly) and run."""
    genes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct()
    hashed = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("_", *c)), 1, 8), 16, 10).cast("long")
    noisy = hashed("run", "gene") % 10 < 2
    return genes.crossJoin(spark.range(1, runs + 1).select(F.col("id").cast("int").alias("run"))).select("gene", "run", F.when(noisy, hashed("gene", "run") % labels).otherwise(hashed("gene") % labels).cast("int").alias("label"))
