"""Writers: tables as Parquet, edges as text for external graph tools, pair tables in place of file-backed matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(folder: str, molecules: DataFrame, cells: DataFrame) -> None:
    """transcripts.parquet and cells.parquet, as read_molecules() and centroids() read them."""
    molecules.write.mode("overwrite").parquet(f"{folder}/transcripts.parquet")
    cells.write.mode("overwrite").parquet(f"{folder}/cells.parquet")


def write_edges(edges: DataFrame, path: str, value: str = "weight") -> None:
    """Lines of `gene1 gene2 value`, without a header."""
    edges.select("gene1", "gene2", value).write.mode("overwrite").csv(path, sep=" ")


def write_pairs(pairs: DataFrame, path: str, parts: int = 64) -> None:
    """A pair table in `parts` folders by the first gene, so that a reader of one gene's row opens one of them."""
    part = F.pmod(F.xxhash64("gene1"), F.lit(parts)).cast("int")
    pairs.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_pairs(pairs_path: str, like: DataFrame, gene: str | None = None, parts: int = 64) -> DataFrame:
    """Pairs that write_pairs() wrote; with a gene, those it comes first in, from its folder alone. like: any table of the session."""
    df = like.sparkSession.read.parquet(pairs_path)
    if gene is None:
        return df.drop("part")
    part = like.sparkSession.range(1).select(F.pmod(F.xxhash64(F.lit(gene)), F.lit(parts)).cast("int").alias("p")).first().p
    return df.where((F.col("part") == part) & (F.col("gene1") == gene)).drop("part")
