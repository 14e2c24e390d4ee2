"""Filters, masks, ranks and rankings of pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inference import adjusted


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_pairs(pairs: DataFrame, columns: tuple[str, ...] = ("L", "r")) -> DataFrame:
    out = pairs
    for c in columns:
        out = out.where(finite(F.col(c)))
    return out


def in_ranges(pairs: DataFrame, r: tuple[float, float] = (-1.0, 1.0), level: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    return pairs.where(F.col("r").between(*r) & F.col("L").between(*level))


def significance_mask(pairs: DataFrame, tested: DataFrame, most: float = 0.05, fdr: str = "fdr") -> DataFrame:
    """L becomes 0 unless the pair has a finite FDR of `most` or less."""
    met = pairs.join(tested.select("gene1", "gene2", F.col(fdr).alias("__q")), ["gene1", "gene2"], "left")
    return met.withColumn("L", F.when(finite(F.col("__q")) & (F.col("__q") <= most), F.col("L")).otherwise(0.0)).drop("__q")


def quantile_filter(pairs: DataFrame, genes: DataFrame, p_low: float, p_high: float, value: str = "L") -> DataFrame:
    """Pairs whose value is between two quantiles of the full symmetric matrix, of its values from 0 up (zeros and diagonal included)
    and of its negatives' sizes. The matrix isn't made: each pair stands for two entries, the diagonal's zeros are counted."""
    n = genes.agg(F.count("*").alias("n"))
    there = pairs.select(F.col(value).alias("v"))
    zeros = there.agg(F.count("*").alias("m")).crossJoin(n).select((F.col("n") * F.col("n") - 2 * F.col("m")).alias("w"), F.lit(0.0).alias("v"))
    entries = there.select(F.lit(2).cast("long").alias("w"), "v").union(zeros.where("w > 0"))
    at = lambda kind, cond, v: entries.where(cond).agg(F.percentile(v, F.array(F.lit(p_low), F.lit(p_high)), F.col("w")).alias(kind))
    cuts = at("up", "v >= 0", F.col("v")).crossJoin(at("down", "v < 0", F.abs("v")))
    inside = lambda v, c: (v >= F.col(c)[0]) & (v <= F.col(c)[1])
    v = F.col(value)
    return pairs.crossJoin(F.broadcast(cuts)).where(F.when(v >= 0, inside(v, "up")).otherwise(inside(F.abs(v), "down"))).drop("up", "down")


def parse_quantile(text: str) -> float:
    """q95 is 0.95, q2.5 is 0.025."""
    value = float(text.lower().removeprefix("q")) / 100
    if not text.lower().startswith("q") or not 0 <= value <= 1:
        raise ValueError(f"not a quantile: {text!r}")
    return value


def matrix_filter(pairs: DataFrame, op: str, value: float, column: str = "L") -> DataFrame:
    c = F.col(column)
    return pairs.where({"gt": c > value, "ge": c >= value, "lt": c < value, "le": c <= value, "eq": c == value, "ne": c != value}[op])


def deltas(levels: DataFrame, r: DataFrame, clamp: str = "none") -> DataFrame:
    """Pairs that both tables have, with Delta = L - r; r below 0 counts as 0 with clamp ref_only or both."""
    met = levels.join(r, ["gene1", "gene2"])
    met = met if clamp == "none" else met.withColumn("r", F.greatest("r", F.lit(0.0)))
    return met.withColumn("Delta", F.col("L") - F.col("r"))


def top_pairs(pairs: DataFrame, n: int = 10, direction: str = "largest", by: str = "Delta") -> DataFrame:
    """Pairs of the n largest or smallest values, or both; equals of the last one stay. Only the n-th value is looked for first, so
    no window runs over all pairs."""
    def side(descending: bool) -> DataFrame:
        order = F.desc(by) if descending else F.asc(by)
        edge = pairs.select(by).orderBy(order).limit(n).agg((F.min if descending else F.max)(by).alias("__edge"))
        met = pairs.crossJoin(F.broadcast(edge))
        return met.where(F.col(by) >= F.col("__edge") if descending else F.col(by) <= F.col("__edge")).drop("__edge")

    parts = {"largest": [True], "smallest": [False], "both": [True, False]}[direction]
    out = side(parts[0])
    for p in parts[1:]:
        out = out.union(side(p))
    return out.dropDuplicates(["gene1", "gene2"])


def ranked(pairs: DataFrame, tested: DataFrame, method: str = "BH") -> DataFrame:
    """Ranked pairs with the adjusted p of their permutation test; the universe is all pairs for _universe methods."""
    name, universe = method.removesuffix("_universe"), pairs.count() if method.endswith("_universe") or method == "bonferroni" else None
    out = adjusted(tested, "p", name, universe, "delta_fdr")
    return out.where("delta_fdr < 0.05") if method == "bonferroni" else out


def top_genes(stats: DataFrame, by: str, n: int) -> DataFrame:
    return stats.orderBy(F.desc(by), "gene").limit(n)


def labelled_extremes(pairs: DataFrame, n: int, by: str = "Delta") -> DataFrame:
    """The n greatest and n least pairs, equals in order of genes."""
    keep = ["gene1", "gene2", by]
    return pairs.select(*keep).orderBy(F.desc(by), "gene1", "gene2").limit(n).withColumn("end", F.lit("top")).union(pairs.select(*keep).orderBy(F.asc(by), "gene1", "gene2").limit(n).withColumn("end", F.lit("bottom")))


def per_group_top(rows: DataFrame, group: str, by: str, n: int, least: int = 1) -> DataFrame:
    """Each group's n greatest with ties and their rank, of groups of `least` rows or more."""
    w = Window.partitionBy(group)
    return rows.withColumns({"__n": F.count("*").over(w), "rank": F.rank().over(w.orderBy(F.desc(by)))}).where((F.col("__n") >= least) & (F.col("rank") <= n)).drop("__n")
