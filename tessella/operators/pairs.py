"""Statistics of gene pairs: spatial lags, Lee's L, correlations, similarities; one row a pair, gene1 before gene2."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spatial_lag(values: DataFrame, edges: DataFrame, value: str = "z") -> DataFrame:
    """(grid_id, gene, lag) = sum over j of w_ij times the value at j."""
    return edges.join(values.withColumnRenamed("grid_id", "j"), "j").groupBy(F.col("i").alias("grid_id"), "gene").agg(F.sum(F.col("w") * F.col(value)).alias("lag"))


def pair_sums(values: DataFrame, unit: str, value: str, genes: list[str] | None = None) -> DataFrame:
    """(gene1, gene2, s): sums of products over shared units, gene1 <= gene2. Units meet once; sums are combined before the shuffle."""
    a = values.select(unit, F.col("gene").alias("gene1"), F.col(value).alias("u"))
    b = values.select(unit, F.col("gene").alias("gene2"), F.col(value).alias("v"))
    met = a.join(b, unit).where("gene1 <= gene2")
    if genes is not None:
        met = met.where(F.col("gene1").isin(genes) | F.col("gene2").isin(genes))
    return met.groupBy("gene1", "gene2").agg(F.sum(F.col("u") * F.col("v")).alias("s"))


#: Genes of a block of the dense products: a task holds the square of it, 128 MB.
GENES = 4096


def pair_sums_dense(values: DataFrame, unit: str, value: str, block: int = 512) -> DataFrame:
    """pair_sums() for many genes: the units of a partition become matrices whose products are summed there, so that each partition
    sends one row a pair. Genes are numbered by the driver, as a panel's are few; every two blocks of GENES genes take a pass of their
    own, so a task never holds more than a square of that size."""
    names = sorted(r.gene for r in values.select("gene").distinct().collect())
    parts = [names[lo : lo + GENES] for lo in range(0, len(names), GENES)] or [[]]
    out = None
    for a in range(len(parts)):
        for b in range(a, len(parts)):
            mine = values if len(parts) == 1 else values.where(F.col("gene").between(parts[a][0], parts[a][-1]) | F.col("gene").between(parts[b][0], parts[b][-1]))
            one = block_products(mine, unit, value, parts[a], parts[b], block)
            out = one if out is None else out.unionByName(one)
    return out.groupBy("gene1", "gene2").agg(F.sum("s").alias("s"))


def block_products(values: DataFrame, unit: str, value: str, left: list[str], right: list[str], block: int) -> DataFrame:
    """Of each partition, the sums of products of the genes of two blocks, gene1 <= gene2."""
    names = left if left is right else left + right
    at = {g: i for i, g in enumerate(names)}
    n, m = len(left), len(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, m))
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                rows = np.stack(held)
                total[...] += rows[:, :n].T @ rows[:, len(names) - m :]
                held.clear()

        for batch in batches:
            for genes, numbers in zip(batch.column("genes").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                row = np.zeros(len(names))
                row[[at[g] for g in genes]] = numbers
                held.append(row)
                if len(held) == block:
                    add()
        add()
        i, j = np.nonzero(np.triu(total) if left is right else total)
        yield pa.RecordBatch.from_arrays([pa.array([left[x] for x in i], pa.string()), pa.array([right[x] for x in j], pa.string()), pa.array(total[i, j])], names=["gene1", "gene2", "s"])

    rows = values.groupBy(unit).agg(F.collect_list("gene").alias("genes"), F.collect_list(value).alias("numbers")).select("genes", "numbers")
    return rows.mapInArrow(run, "gene1 string, gene2 string, s double")


def require_size(genes: DataFrame, limit_gb: float | None) -> None:
    """An error if the full matrix of gene pairs, as doubles, is larger than the limit; None is no limit. For callers that mean to collect
    it: pair tables themselves stay distributed."""
    n = genes.count() if limit_gb is not None else 0
    if limit_gb is not None and 8 * n * n > limit_gb * 2**30:
        raise MemoryError(f"the matrix of {n} genes takes {8 * n * n / 2**30:.1f} GB, more than {limit_gb}")


def lees_l(values: DataFrame, edges: DataFrame, info: DataFrame, value: str = "z", diagonal: bool = False, dense: bool = False, genes: list[str] | None = None) -> DataFrame:
    """(gene1, gene2, L): n / S2 * sum_i lag_f lag_g / sqrt(sum x_f^2 sum x_g^2), S2 the sum of squared row sums of W, n the tiles. A
    gene without variation has L of 0; an error without weights would be a division by zero, so L is then null."""
    s2 = edges.groupBy("i").agg(F.sum("w").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("s2"))
    n = info.agg(F.count("*").cast("double").alias("n"))
    norms = values.groupBy("gene").agg(F.sum(F.col(value) * F.col(value)).alias("q"))
    lag = spatial_lag(values, edges, value)
    top = pair_sums_dense(lag, "grid_id", "lag") if dense else pair_sums(lag, "grid_id", "lag", genes)
    if not diagonal:
        top = top.where("gene1 < gene2")
    both = top.join(F.broadcast(norms.select(F.col("gene").alias("gene1"), F.col("q").alias("q1"))), "gene1").join(F.broadcast(norms.select(F.col("gene").alias("gene2"), F.col("q").alias("q2"))), "gene2")
    both = both.crossJoin(F.broadcast(s2)).crossJoin(F.broadcast(n))
    scale = F.try_divide(F.col("n"), F.col("s2"))
    return both.select("gene1", "gene2", F.when((F.col("q1") <= 0) | (F.col("q2") <= 0), 0.0).otherwise(scale * F.col("s") / F.sqrt(F.nullif(F.col("q1") * F.col("q2"), F.lit(0.0)))).alias("L"))


def centring(values: DataFrame, value: str = "z", limit: float = 1e-7) -> DataFrame:
    """(gene, finite, centred): whether each column of a layer is fit for L: finite, and its mean small against its RMS."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)))
    return values.groupBy("gene").agg(F.min(finite.cast("int")).alias("f"), F.abs(F.avg(value)).alias("m"), rms.alias("r")).select("gene", (F.col("f") == 1).alias("finite"), ((F.col("f") == 1) & ((F.col("r") == 0) | (F.col("m") <= limit * F.col("r")))).alias("centred"))


def plane_slopes(values: DataFrame, info: DataFrame, value: str = "z") -> DataFrame:
    """(gene, slope_x, slope_y) of the least-squares plane over tile centres, from centred sums."""
    v = values.join(info.select("grid_id", F.col("center_x").alias("x"), F.col("center_y").alias("y")), "grid_id")
    c = v.groupBy("gene").agg(*[F.covar_pop(a, b).alias(n) for n, a, b in (("xx", "x", "x"), ("yy", "y", "y"), ("xy", "x", "y"), ("xv", "x", value), ("yv", "y", value))])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return c.select("gene", F.try_divide(F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy"), det).alias("slope_x"), F.try_divide(F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy"), det).alias("slope_y"))


def pearson(values: DataFrame, unit: str, value: str = "value", n: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """(gene1, gene2, r) over all units (n: one row, else those in values); absent values are zeros. Constant genes have 0."""
    n = values.select(unit).distinct().agg(F.count("*").cast("double").alias("n")) if n is None else n
    s = values.groupBy("gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    side = lambda k: F.broadcast(s.select(F.col("gene").alias(f"gene{k}"), F.col("s").alias(f"s{k}"), F.col("q").alias(f"q{k}")))
    pairs = s.select(F.col("gene").alias("gene1")).join(s.select(F.col("gene").alias("gene2")), F.col("gene1") < F.col("gene2"))
    sums = pair_sums_dense(values, unit, value) if dense else pair_sums(values, unit, value)
    both = pairs.join(sums, ["gene1", "gene2"], "left").join(side(1), "gene1").join(side(2), "gene2").crossJoin(F.broadcast(n))
    cov = F.coalesce("s", F.lit(0.0)) - F.col("s1") * F.col("s2") / F.col("n")
    var = lambda k: F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col("n")
    flat = (var(1) <= 1e-12 * F.greatest(F.col("q1"), F.lit(1e-300))) | (var(2) <= 1e-12 * F.greatest(F.col("q2"), F.lit(1e-300)))
    return both.select("gene1", "gene2", F.when(flat, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(F.greatest(var(1), F.lit(1e-300)) * F.greatest(var(2), F.lit(1e-300)))))).alias("r"))


def zero_ranks(values: DataFrame, n: DataFrame, value: str = "value") -> DataFrame:
    """Values other than 0 as average ranks within their gene, less the rank that a zero has; so absent values, which are zeros, stay
    absent. n: one row, the number of units."""
    by = Window.partitionBy("gene")
    v = F.col(value)
    some = values.where(v != 0).crossJoin(F.broadcast(n))
    rank = F.rank().over(by.orderBy(value)) + (F.count("*").over(Window.partitionBy("gene", value)) - 1) / 2.0
    zeros = F.col("n") - F.count("*").over(by)
    below = F.sum((v < 0).cast("int")).over(by)
    out = some.withColumns({"__rank": rank, "__zeros": zeros, "__below": below})
    shifted = F.col("__rank") + F.when(v > 0, F.col("__zeros")).otherwise(0.0) - F.col("__below") - (F.col("__zeros") + 1) / 2.0
    return out.withColumn(value, shifted.cast("double")).drop("__rank", "__zeros", "__below", "n")


def spearman(values: DataFrame, unit: str, value: str = "value", n: DataFrame | None = None) -> DataFrame:
    """(gene1, gene2, r) of ranks over all units; absent values are zeros."""
    n = values.select(unit).distinct().agg(F.count("*").cast("double").alias("n")) if n is None else n
    return pearson(zero_ranks(values, n, value), unit, value, n)


def kendall(values: DataFrame, unit: str, value: str = "value") -> DataFrame:
    """(gene1, gene2, r): Kendall's tau-b over all units, absent values as zeros. For every gene the signs of the differences of every
    two units are taken, in blocks of units, so work is quadratic in units: for tables of a few thousand."""
    units = values.select(unit).distinct()
    every = units.crossJoin(F.broadcast(values.select("gene").distinct())).join(values.select(unit, "gene", F.col(value).alias("v")), [unit, "gene"], "left").na.fill(0.0, ["v"])
    a = every.select(F.col(unit).alias("u1"), "gene", F.col("v").alias("v1"))
    b = every.select(F.col(unit).alias("u2"), "gene", F.col("v").alias("v2"))
    signs = a.join(b, "gene").where("u1 < u2").select(F.struct("u1", "u2").alias("two"), "gene", F.signum(F.col("v1") - F.col("v2")).alias("s")).where("s <> 0")
    norm = signs.groupBy("gene").agg(F.count("*").cast("double").alias("q"))
    sums = pair_sums(signs, "two", "s").where("gene1 < gene2")
    genes = values.select("gene").distinct()
    pairs = genes.select(F.col("gene").alias("gene1")).join(genes.select(F.col("gene").alias("gene2")), F.col("gene1") < F.col("gene2"))
    side = lambda k: F.broadcast(norm.select(F.col("gene").alias(f"gene{k}"), F.col("q").alias(f"q{k}")))
    met = pairs.join(sums, ["gene1", "gene2"], "left").join(side(1), "gene1", "left").join(side(2), "gene2", "left")
    return met.select("gene1", "gene2", F.coalesce(F.col("s") / F.sqrt(F.col("q1") * F.col("q2")), F.lit(0.0)).alias("r"))


def t_statistics(pairs: DataFrame, n: int) -> DataFrame:
    """pairs with t of a correlation over n units, |r| kept below 1, and its degrees of freedom df."""
    r = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.col("r")))
    return pairs.withColumn("t", r * F.sqrt(F.lit(float(n - 2)) / (1.0 - r * r))).withColumn("df", F.lit(n - 2))


def shared(values: DataFrame, unit: str = "grid_id") -> DataFrame:
    """(gene1, gene2, dot): sparse products over shared units."""
    return pair_sums(values, unit, "value").where("gene1 < gene2").withColumnRenamed("s", "dot")


def morisita_horn(values: DataFrame, pairs: DataFrame, chao: bool = True, unit: str = "grid_id", rescale: bool = True) -> DataFrame:
    """(gene1, gene2, mh) of the pairs: 2 sum xy / ((l1 + l2) N1 N2), l = Q / N^2 or, with chao, less what chance gives. If all are
    below a tenth (hundredth, thousandth), all are multiplied by 10 (100, 1000)."""
    n, q = F.col("N"), F.col("Q")
    u = F.when(n > 1, 2.0 * F.col("f2") / F.nullif(n * (n - 1), F.lit(0.0))).otherwise(0.0)
    raw = F.try_divide(q - n * (n - 1) * (1 - u), n * n)
    stats = values.groupBy("gene").agg(F.sum("value").alias("N"), F.sum(F.col("value") * F.col("value")).alias("Q"), F.sum((F.col("value") == 2).cast("double")).alias("f2"))
    stats = stats.select("gene", "N", F.try_divide(q, n * n).alias("plain"), F.when((raw < 0) | raw.isNull(), 0.0).otherwise(raw).alias("least"))
    side = lambda k: F.broadcast(stats.select(F.col("gene").alias(f"gene{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("N", "plain", "least")]))
    met = pairs.select("gene1", "gene2").join(shared(values, unit), ["gene1", "gene2"], "left").join(side(1), "gene1").join(side(2), "gene2")
    plain = F.col("plain1") + F.col("plain2")
    lam = F.when((F.col("least1") == 0) & (F.col("least2") == 0), plain).otherwise(F.col("least1") + F.col("least2")) if chao else plain
    out = met.select("gene1", "gene2", F.coalesce(F.try_divide(2.0 * F.coalesce("dot", F.lit(0.0)), lam * F.col("N1") * F.col("N2")), F.lit(0.0)).alias("mh"))
    if not rescale:
        return out
    top = out.agg(F.max("mh").alias("top")).select(F.when(F.col("top") < 0.001, 1000.0).when(F.col("top") < 0.01, 100.0).when(F.col("top") < 0.1, 10.0).otherwise(1.0).alias("by"))
    return out.crossJoin(F.broadcast(top)).select("gene1", "gene2", (F.col("mh") * F.col("by")).alias("mh"))


def jaccard(counts: DataFrame, min_units: int = 8, top: int = 60, unit: str = "grid_id") -> DataFrame:
    """(gene1, gene2, jaccard) of presence, among the genes present most often (in min_units or more)."""
    there = counts.where("count > 0").select(unit, "gene").distinct()
    n = there.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= min_units).orderBy(F.desc("n"), "gene").limit(top)
    some = there.join(F.broadcast(n.select("gene")), "gene", "left_semi").withColumn("one", F.lit(1.0))
    both = pair_sums(some, unit, "one").where("gene1 < gene2")
    side = lambda k: F.broadcast(n.select(F.col("gene").alias(f"gene{k}"), F.col("n").alias(f"n{k}")))
    pairs = n.select(F.col("gene").alias("gene1"), F.col("n").alias("n1")).join(side(2), F.col("gene1") < F.col("gene2"))
    inter = F.coalesce("s", F.lit(0.0))
    return pairs.join(both, ["gene1", "gene2"], "left").select("gene1", "gene2", (inter / (F.col("n1") + F.col("n2") - inter)).alias("jaccard"))


def idelta(counts: DataFrame, q: DataFrame) -> DataFrame:
    """(gene, idelta) = q sum x (x - 1) / (T (T - 1)); null with under two molecules. q: one row, the number of units."""
    x = F.col("count").cast("double")
    s = counts.groupBy("gene").agg(F.sum(x * (x - 1)).alias("s"), F.sum(x).alias("t")).crossJoin(F.broadcast(q))
    return s.select("gene", F.when(F.col("t") >= 2, F.col("q") * F.col("s") / F.nullif(F.col("t") * (F.col("t") - 1), F.lit(0.0))).alias("idelta"))


def fold_pairs(totals: DataFrame) -> DataFrame:
    """(gene1, gene2, total1, total2, fold): every pair of totals and the greater by the lesser (1 at least)."""
    a, b = totals.select(F.col("gene").alias("gene1"), F.col("total").alias("total1")), totals.select(F.col("gene").alias("gene2"), F.col("total").alias("total2"))
    return a.join(F.broadcast(b), F.col("gene1") < F.col("gene2")).withColumn("fold", F.greatest("total1", "total2") / F.greatest(F.lit(1.0), F.least("total1", "total2")))


def module_similarity(density: DataFrame, method: str = "pearson") -> DataFrame:
    """(gene1, gene2, similarity) of modules by their densities (grid_id, gene, value): jaccard of presence, pearson, spearman, kendall, cosine."""
    if method == "pearson":
        return pearson(density, "grid_id").withColumnRenamed("r", "similarity")
    if method == "spearman":
        return spearman(density, "grid_id").withColumnRenamed("r", "similarity")
    if method == "kendall":
        return kendall(density, "grid_id").withColumnRenamed("r", "similarity")
    if method == "jaccard":
        return jaccard(density.withColumnRenamed("value", "count"), 1, 1 << 30).withColumnRenamed("jaccard", "similarity")
    q = density.groupBy("gene").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("q"))
    side = lambda k: F.broadcast(q.select(F.col("gene").alias(f"gene{k}"), F.col("q").alias(f"q{k}")))
    return shared(density).join(side(1), "gene1").join(side(2), "gene2").select("gene1", "gene2", F.coalesce(F.try_divide("dot", F.col("q1") * F.col("q2")), F.lit(0.0)).alias("similarity"))


def sign_bits(values: DataFrame, unit: str, value: str, bits: int = 12, tables: int = 4) -> DataFrame:
    """(gene, table, bits): signs of random projections; a unit's direction in each is drawn from a hash of unit, table and bit."""
    at = F.explode(F.sequence(F.lit(0), F.lit(bits * tables - 1)))
    sign = F.when(F.xxhash64(unit, "k") % 2 == 0, 1.0).otherwise(-1.0)
    p = values.select(unit, "gene", F.col(value).alias("v"), at.alias("k")).groupBy("gene", "k").agg(F.sum(F.col("v") * sign).alias("p"))
    return p.groupBy("gene", F.expr(f"k div {bits}").alias("table")).agg(F.sum(F.when(F.col("p") >= 0, F.expr(f"shiftleft(1L, cast(k % {bits} as int))")).otherwise(0)).alias("bits"))


def candidates(bits: DataFrame) -> DataFrame:
    """Pairs of genes that share all bits of a table."""
    a, b = bits.withColumnRenamed("gene", "gene1"), bits.withColumnRenamed("gene", "gene2")
    return a.join(b, ["table", "bits"]).where("gene1 < gene2").select("gene1", "gene2").distinct()


def top_partners(pairs: DataFrame, k: int, value: str) -> DataFrame:
    """(gene, partner, value, rank): each gene's k greatest."""
    both = pairs.select(F.col("gene1").alias("gene"), F.col("gene2").alias("partner"), value).union(pairs.select("gene2", "gene1", value))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc(value), "partner"))).where(F.col("rank") <= k)
