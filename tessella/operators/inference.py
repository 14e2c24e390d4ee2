"""Permutation inference and multiple testing.

Random numbers are md5 hashes of logical ids (permutation, tile, seed), so results don't depend on partitions, and SQL engines agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import upper_tail
from .ranks import running, suffix_least

#: Statistics as large as the observed one up to this much count as exceeding it, so that the order of summation doesn't matter.
SLACK = 1e-12


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of the parts joined by _."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def permutations(info: DataFrame, n: int, block: str | None = None) -> DataFrame:
    """(b, grid_id, src): in permutation b, the values of tile src stand at grid_id; within blocks if a block column is given."""
    each = info.crossJoin(F.broadcast(info.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("b"))))
    by = ["b", *([block] if block else [])]
    place = F.row_number().over(Window.partitionBy(*by).orderBy("grid_id"))
    drawn = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("_", "b", "grid_id")), "grid_id"))
    to = each.select(*by, "grid_id", place.alias("k"))
    src = each.select(*by, F.col("grid_id").alias("src"), drawn.alias("k"))
    return to.join(src, [*by, "k"]).select("b", "grid_id", "src")


def check_permutations(perms: DataFrame, info: DataFrame, block: str | None = None) -> DataFrame:
    """One row: permutations, and how many aren't bijections, or move a tile out of its block."""
    n = info.agg(F.count("*").alias("n"))
    per = perms.groupBy("b").agg(F.count_distinct("src").alias("s"), F.count_distinct("grid_id").alias("t")).crossJoin(F.broadcast(n))
    out = per.agg(F.count("*").alias("permutations"), F.sum(((F.col("s") != F.col("n")) | (F.col("t") != F.col("n"))).cast("long")).alias("not_bijective"))
    if block is None:
        return out.withColumn("across_blocks", F.lit(0).cast("long"))
    side = lambda c: info.select(F.col("grid_id").alias(c), F.col(block).alias(f"{c}_block"))
    across = perms.join(side("grid_id"), "grid_id").join(side("src"), "src").agg(F.sum((F.col("grid_id_block") != F.col("src_block")).cast("long")).alias("across_blocks"))
    return out.crossJoin(across)


def permuted_l(values: DataFrame, edges: DataFrame, perms: DataFrame, pairs: DataFrame, value: str = "z") -> DataFrame:
    """(b, gene1, gene2, top): sum of lag products of the pairs in every permutation, in joins alone."""
    moved = perms.join(values.withColumnRenamed("grid_id", "src"), "src").select("b", F.col("grid_id").alias("j"), "gene", value)
    lag = edges.join(moved, "j").groupBy("b", "i", "gene").agg(F.sum(F.col("w") * F.col(value)).alias("lag"))
    a, c = lag.withColumnsRenamed({"gene": "gene1", "lag": "u"}), lag.withColumnsRenamed({"gene": "gene2", "lag": "v"})
    return a.join(pairs.select("gene1", "gene2"), "gene1").join(c, ["b", "i", "gene2"]).groupBy("b", "gene1", "gene2").agg(F.sum(F.col("u") * F.col("v")).alias("top"))


def permutation_test(values: DataFrame, edges: DataFrame, info: DataFrame, observed: DataFrame, perms: DataFrame, n_perm: int, reference: str | None = None, value: str = "z") -> DataFrame:
    """observed (gene1, gene2, L) with k, the number of permutations in which |L_b| >= |L| (with a reference column r: in which
    |L_b - r| >= |L - r|), and p = (k + 1) / (n_perm + 1). perms: any table of permutations (b, grid_id, src), which must pass
    check_permutations(). Joins alone, so no table need fit anywhere; a row for each permutation, tile and pair, so for few pairs."""
    s2 = edges.groupBy("i").agg(F.sum("w").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("s2"))
    n = info.agg(F.count("*").cast("double").alias("n"))
    norms = values.groupBy("gene").agg(F.sum(F.col(value) * F.col(value)).alias("q"))
    side = lambda k: norms.select(F.col("gene").alias(f"gene{k}"), F.col("q").alias(f"q{k}"))
    tops = permuted_l(values, edges, perms, observed, value)
    met = tops.join(observed, ["gene1", "gene2"]).join(side(1), "gene1").join(side(2), "gene2").crossJoin(F.broadcast(s2)).crossJoin(F.broadcast(n))
    lb = F.coalesce(F.col("n") / F.col("s2") * F.try_divide(F.col("top"), F.sqrt(F.col("q1") * F.col("q2"))), F.lit(0.0))
    centre = F.col(reference) if reference else F.lit(0.0)
    k = met.groupBy("gene1", "gene2").agg(F.sum((F.abs(lb - centre) >= F.abs(F.col("L") - centre) - SLACK).cast("long")).alias("k"))
    return observed.join(k, ["gene1", "gene2"], "left").withColumn("k", F.coalesce("k", F.lit(n_perm))).withColumn("p", (F.col("k") + 1) / (n_perm + 1.0))


def order_of(b: int, tiles: list[str]) -> list[int]:
    """The tiles' numbers in the order of permutation b, that of permutations()."""
    return sorted(range(len(tiles)), key=lambda i: (hashlib.md5(f"{b}_{tiles[i]}".encode()).hexdigest(), tiles[i]))


def permutation_test_dense(values: DataFrame, edges: DataFrame, info: DataFrame, observed: DataFrame, n_perm: int, block: str | None = None, reference: str | None = None, recompute: bool = False, value: str = "z", genes_a_block: int = 256, limit: int = 20_000_000) -> DataFrame:
    """permutation_test() with the permutations of permutations(info, n_perm, block), for many pairs: genes are dealt into blocks, and a task
    has the columns of two blocks, the observed values of their pairs, and a share of the permutations. Tiles and weights are sent to
    every executor; with more than `limit` of them the joins of permutation_test() are taken instead, which give the same counts.

    recompute: the reference of each permutation is Pearson's r of the permuted columns (the older Delta test) in the place of a column.
    As all columns move together, r stays what it was up to rounding, and so do the counts."""
    tiles, links = info.count(), edges.count()
    if recompute and reference is None:
        raise ValueError("a recomputed reference replaces that of a column")
    if tiles + links > limit:
        return permutation_test(values, edges, info, observed, permutations(info, n_perm, block), n_perm, reference, value)
    spark = values.sparkSession
    names = info.select("grid_id", *([F.col(block).alias("block")] if block else [F.lit(0).alias("block")])).toPandas().sort_values(["block", "grid_id"])
    tile = names["grid_id"].tolist()
    starts = np.flatnonzero(np.diff(pd.factorize(names["block"])[0], prepend=-1)).tolist()
    at = {t: i for i, t in enumerate(tile)}
    e = edges.select("i", "j", "w").toPandas()
    e = e[e["i"].isin(at) & e["j"].isin(at)]
    rows, cols, w = e["i"].map(at).to_numpy(np.int64), e["j"].map(at).to_numpy(np.int64), e["w"].to_numpy(float)
    pick = np.argsort(rows, kind="stable")
    rows, cols, w = rows[pick], cols[pick], w[pick]
    s2 = float((np.bincount(rows, w, len(tile)) ** 2).sum())
    sent = spark.sparkContext.broadcast((tile, starts, at, rows, cols, w, s2))

    genes = values.select("gene").distinct()
    blocks = max(1, -(-genes.count() // genes_a_block))
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    shares = max(1, min(n_perm, -(-2 * spark.sparkContext.defaultParallelism // (blocks * (blocks + 1) // 2))))
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    columns = values.groupBy("gene").agg(F.collect_list(F.struct("grid_id", F.col(value).alias("v"))).alias("v"))
    columns = columns.select("gene", F.col("v.grid_id").alias("tile"), F.col("v.v").alias("v"), number("gene").alias("own"))
    columns = columns.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("gene", "tile", "v", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2")).withColumn("share", share)
    some = [reference] if reference else []
    asked = observed.select("gene1", "gene2", "L", *[F.col(c).alias("ref") for c in some], F.least(number("gene1"), number("gene2")).alias("b1"), F.greatest(number("gene1"), number("gene2")).alias("b2")).withColumn("share", share)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tile, starts, at, rows, cols, w, s2 = sent.value
        if not len(right) or not len(left):
            return pd.DataFrame({"gene1": [], "gene2": [], "k": []})
        name = {g: i for i, g in enumerate(left["gene"])}
        x = np.zeros((len(tile), len(name)))
        for i, (t, v) in enumerate(zip(left["tile"], left["v"], strict=True)):
            x[[at[u] for u in t], i] = v
        norm = np.sqrt((x**2).sum(axis=0))
        norm[norm == 0] = np.inf
        g1, g2 = right["gene1"].map(name).to_numpy(np.int64), right["gene2"].map(name).to_numpy(np.int64)
        centre = right["ref"].to_numpy(float) if "ref" in right else 0.0
        level = np.abs(right["L"].to_numpy(float) - centre) - SLACK
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        k = np.zeros(len(right), np.int64)
        ends = [*starts[1:], len(tile)]
        for b in range(1 + int(key[2]), n_perm + 1, shares):
            source = np.concatenate([np.array([lo + i for i in order_of(b, tile[lo:hi])], np.int64) for lo, hi in zip(starts, ends, strict=True)]) if tile else np.zeros(0, np.int64)
            moved = x[source]
            lag = np.zeros_like(x)
            if len(first):
                lag[rows[first]] = np.add.reduceat(moved[cols] * w[:, None], first, axis=0)
            if recompute:
                z = moved - moved.mean(axis=0)
                size = np.sqrt((z**2).sum(axis=0))
                z /= np.where(size > 0, size, np.inf)
                centre = np.einsum("ij,ij->j", z[:, g1], z[:, g2])
            top = np.einsum("ij,ij->j", lag[:, g1], lag[:, g2]) if len(right) < 4 * len(name) else (lag.T @ lag)[g1, g2]
            k += np.abs(top * (len(tile) / s2) / (norm[g1] * norm[g2]) - centre) >= level
        return pd.DataFrame({"gene1": right["gene1"], "gene2": right["gene2"], "k": k})

    by = ["b1", "b2", "share"]
    counts = columns.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(run, "gene1 string, gene2 string, k long").groupBy("gene1", "gene2").agg(F.sum("k").alias("k"))
    return observed.join(counts, ["gene1", "gene2"], "left").withColumn("k", F.coalesce("k", F.lit(n_perm))).withColumn("p", (F.col("k") + 1) / (n_perm + 1.0))


def p_value(k: Column, n: int, mode: str, u: Column | None = None) -> Column:
    """exact (k+1)/(n+1), beta (k+1)/(n+2), mid (k+0.5)/(n+1), uniform (k+u)/(n+1)."""
    add, more = {"exact": (F.lit(1.0), 1), "beta": (F.lit(1.0), 2), "mid": (F.lit(0.5), 1), "uniform": (u, 1)}[mode]
    return (k + add) / float(n + more)


def p_error(p: Column, n: int) -> Column:
    """Standard error of a Monte-Carlo p-value."""
    return F.sqrt(p * (1.0 - p) / float(n))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + .. + 1/m: added up to 10,000, beyond that ln m + gamma + 1 / 2m - 1 / 12 m^2, which is as exact as a double."""
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(m, F.lit(10_000.0)).cast("long"))), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return F.when(m <= 10_000, few).otherwise(F.log(m) + 0.5772156649015329 + 0.5 / m - 1.0 / (12.0 * m * m))


def adjusted(pairs: DataFrame, p: str = "p", method: str = "BH", universe: int | None = None, out: str = "fdr", scale: Column | None = None, keys: tuple[str, ...] = ("gene1", "gene2")) -> DataFrame:
    """pairs with adjusted p-values: BH, BY (BH times the harmonic sum) or bonferroni, over the finite ones or a stated universe.

    The distinct p go through range partitions: counts up to each p, and the running minimum from the greatest downwards, are taken
    within partitions and joined by one number a partition, so p may be as many as pairs.
    """
    fine = F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    levels = pairs.where(fine).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("c"))
    if method == "bonferroni":
        m = levels.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("double").alias("m")) if universe is None else pairs.sparkSession.range(1).select(F.lit(float(universe)).alias("m"))
        q = levels.crossJoin(F.broadcast(m)).select("__p", F.least(F.lit(1.0), F.col("__p") * F.col("m")).alias(out))
    else:
        ranked_, total = running(levels, "__p", "c", "__rank")
        m = F.lit(float(total if universe is None else universe))
        least = suffix_least(ranked_.withColumn("__raw", F.col("__p") * m / F.col("__rank")), "__raw", "__least")
        times = harmonic(m) if method == "BY" else F.lit(1.0)
        q = least.select("__p", F.least(F.lit(1.0), F.col("__least") * (times if scale is None else times * scale)).alias(out))
    return pairs.join(q, F.when(fine, F.col(p)) == F.col("__p"), "left").drop("__p")


def storey(pairs: DataFrame, p: str = "p", out: str = "q") -> DataFrame:
    """Storey's q-values; pi0 the least of mean(p > l) / (1 - l) over l = 0.5 .. 0.95, 1 at most and where it isn't positive."""
    steps = [round(0.5 + 0.05 * i, 2) for i in range(10)]
    pi0 = pairs.where(F.col(p).isNotNull()).agg(F.least(F.lit(1.0), *[F.avg((F.col(p) > s).cast("double")) / (1.0 - s) for s in steps]).alias("pi0"))
    pi0 = pi0.select(F.when(F.col("pi0") > 0, F.col("pi0")).otherwise(1.0).alias("pi0"))
    fine = adjusted(pairs, p, "BH", out="__bh").crossJoin(F.broadcast(pi0))
    # BH caps at 1 only after scaling, so the uncapped minimum is wanted: q = min(1, pi0 * BH uncapped); p <= 1 makes BH at most 1.
    return fine.withColumn(out, F.least(F.lit(1.0), F.col("__bh") * F.col("pi0"))).drop("__bh", "pi0")


def within_between(pairs: DataFrame, modules: DataFrame, value: str = "jaccard", min_within: int = 1, min_between: int = 1) -> DataFrame:
    """(gene, module, within, between, n_within, n_between): a gene's mean value with its own module and with others."""
    both = pairs.select(F.col("gene1").alias("gene"), F.col("gene2").alias("other"), value).union(pairs.select("gene2", "gene1", value))
    met = both.join(F.broadcast(modules), "gene").join(F.broadcast(modules.select(F.col("gene").alias("other"), F.col("module").alias("theirs"))), "other")
    same = F.col("module") == F.col("theirs")
    out = met.groupBy("gene", "module").agg(F.avg(F.when(same, F.col(value))).alias("within"), F.avg(F.when(~same, F.col(value))).alias("between"), F.count(F.when(same, 1)).alias("n_within"), F.count(F.when(~same, 1)).alias("n_between"))
    return out.where((F.col("n_within") >= min_within) & (F.col("n_between") >= min_between))


def signed_rank(table: DataFrame, alternative: str = "greater") -> DataFrame:
    """One row (n, v, z, p): Wilcoxon's signed-rank statistic of within - between, zeros dropped, ties at mean ranks, normal approximation
    with tie and continuity correction, for the alternative greater, less or two.sided. Where no difference is left, n is 0 and the others are null."""
    d = table.select((F.col("within") - F.col("between")).alias("d")).where("d <> 0").withColumn("a", F.round(F.abs("d"), 12))
    levels = d.groupBy("a").agg(F.count("*").alias("c"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    ranked_, _ = running(levels, "a", "c", "__upto")
    s = ranked_.select("c", "up", (F.col("__upto") - (F.col("c") - 1) / 2.0).alias("r")).agg(F.coalesce(F.sum("c"), F.lit(0)).cast("double").alias("n"), F.sum(F.col("up") * F.col("r")).alias("v"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).cast("double").alias("ties"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    off = F.col("v") - n * (n + 1) / 4.0
    shift = {"greater": F.lit(0.5), "less": F.lit(-0.5), "two.sided": F.signum(off) * 0.5}[alternative]
    out = s.select(n.cast("long").alias("n"), "v", F.try_divide(off - shift, sd).alias("z"))
    tail = {"greater": upper_tail(F.col("z")), "less": upper_tail(-F.col("z")), "two.sided": F.least(F.lit(1.0), 2.0 * upper_tail(F.abs("z")))}[alternative]
    return out.withColumn("p", F.when(F.col("z").isNotNull(), tail))


def sign_flips(table: DataFrame, n_perm: int, alternative: str = "greater") -> DataFrame:
    """One row (observed, k, p): mean difference, and in how many of n_perm random sign assignments it is as great (as small with less, as
    far from 0 with two.sided); signs are md5 bits."""
    d = table.select("gene", (F.col("within") - F.col("between")).alias("d"))
    each = d.crossJoin(F.broadcast(d.sparkSession.range(1, n_perm + 1).select(F.col("id").alias("b"))))
    flipped = each.groupBy("b").agg(F.avg(F.when(uniform("b", "gene") < 0.5, F.col("d")).otherwise(-F.col("d"))).alias("m"))
    obs = d.agg(F.avg("d").alias("observed"))
    m, o = F.col("m"), F.col("observed")
    hit = {"greater": m >= o - SLACK, "less": m <= o + SLACK, "two.sided": F.abs(m) >= F.abs(o) - SLACK}[alternative]
    return flipped.crossJoin(F.broadcast(obs)).groupBy("observed").agg(F.sum(hit.cast("long")).alias("k")).withColumn("p", (F.col("k") + 1) / (n_perm + 1.0))


def downsample(rows: DataFrame, key: str, amount: float) -> DataFrame:
    """A share (below 1) or a number of rows, those of the least md5 of the key."""
    draw = F.md5(F.col(key).cast("string"))
    return rows.where(uniform(F.col(key).cast("string")) < amount) if amount < 1 else rows.orderBy(draw, key).limit(int(amount))
