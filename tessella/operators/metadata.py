"""Object metadata: its canonical form, its migration, and fingerprints of what results were made from."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
PSEUDO = "__scope_"


def platform_name(c: Column) -> Column:
    """Canonical platform names; others stay as they are."""
    low = F.lower(F.trim(c))
    return F.when(low.contains("xenium"), "Xenium").when(low.contains("cosmx"), "CosMx").when(low.contains("visium"), "Visium").otherwise(c)


def modal(metadata: DataFrame, column: str) -> DataFrame:
    """One row, the most frequent value of a column (the least of equals)."""
    return metadata.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1).select("v")


def migrated(metadata: DataFrame, canonical: dict[str, str | None], scalars: dict[str, str | None], drop_pseudo: bool = True, drop_redundant: bool = True) -> tuple[DataFrame, dict]:
    """(gene table, object metadata). Platform and dataset: the canonical value, else the scalar, else the gene table's most frequent.
    Pseudo rows go, and so do columns that only repeat the object's value. Doing it again changes nothing."""
    rows = metadata.where(~F.col("gene").startswith(PSEUDO)) if drop_pseudo else metadata
    out: dict = {"schema_version": SCHEMA_VERSION}
    for name in ("platform", "dataset"):
        value = canonical.get(name) or scalars.get(name)
        if value is None and name in metadata.columns:
            found = modal(rows, name).first()
            value = found.v if found else None
        if name == "platform" and value is not None:
            value = metadata.sparkSession.range(1).select(platform_name(F.lit(value)).alias("v")).first().v
        out[name] = value
        if drop_redundant and name in rows.columns and rows.select(name).distinct().limit(2).count() <= 1:
            rows = rows.drop(name)
    return rows, out


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (rows, hash): the same for any order and partitioning of the rows."""
    names = sorted(columns or df.columns)
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names])), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).alias("hash"))


FORMULA = "n / S2 * sum(lag lag) / sqrt(sum x^2 sum x^2)"


def source_of(values: DataFrame, edges: DataFrame, layer: str, style: str) -> dict:
    """What a result of a layer and weights is made from: the formula, the layer's name, order-insensitive hashes of both tables, the weight
    style and S2. Permutations aren't part of it: see settings_of()."""
    data, weight = fingerprint(values).first(), fingerprint(edges).first()
    s2 = edges.groupBy("i").agg(F.sum("w").alias("r")).agg(F.sum(F.col("r") * F.col("r"))).first()[0]
    return {"formula": FORMULA, "layer": layer, "data_hash": (data.rows, data["hash"]), "weight_hash": (weight.rows, weight["hash"]), "style": style, "s2": float(s2 or 0.0)}


def settings_of(**values) -> dict:
    """Settings of a run (permutations, blocks, bootstrap samples, span, seed), and a hash of them."""
    text = ",".join(f"{k}={values[k]!r}" for k in sorted(values))
    return values | {"settings_sha256": hashlib.sha256(text.encode()).hexdigest()}


def require_fresh(stored: dict, now: dict, tolerance: float = 1e-12) -> None:
    """An error unless results were made from these inputs: formula, layer, hashes and style equal, S2 within a relative tolerance."""
    for name in ("formula", "layer", "data_hash", "weight_hash", "style"):
        if stored.get(name) != now.get(name):
            raise ValueError(f"stale input: {name} is {now.get(name)!r}, results were made with {stored.get(name)!r}")
    if abs(stored["s2"] - now["s2"]) > tolerance * max(abs(stored["s2"]), 1e-300):
        raise ValueError("stale input: S2 changed")
