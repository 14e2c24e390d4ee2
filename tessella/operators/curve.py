"""The reference curve of L against r: local regression, bootstrap bands, and their use as a filter.

Points may be any number: every step is a pass over them whose result is a number of sums for each place of the curve. Places are the
curve's grid and the knots at which the points' own fits are taken, so their number is bounded whatever that of the points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .ranks import ranked

#: Knots of the points' own fits (with no more distinct x, every one is a knot, so the fits are exact), order statistics of x from
#: which reaches are taken, and of a stratum's residuals from which resampling draws (with no more points, all of them).
KNOTS, ORDER, POOL = 4096, 1 << 17, 1 << 14
#: Points handled at once against the places, samples at once.
BATCH, SAMPLES = 4096, 256


def smoother(x: np.ndarray, out: np.ndarray, k: int, degree: int = 1) -> np.ndarray:
    """The matrix that maps values at x to local fits at `out`: tricube weights over the k nearest of x; degree 0 to 2. For curves, whose
    grids are small."""
    rows = np.zeros((len(out), len(x)))
    for row, x0 in zip(rows, out, strict=True):
        d = np.abs(x - x0)
        reach = np.partition(d, min(k, len(x)) - 1)[min(k, len(x)) - 1]
        w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3 if reach > 0 else (d == 0).astype(float)
        design = np.stack([(x - x0) ** j for j in range(degree + 1)], axis=1)
        row[:] = (np.linalg.pinv(design * np.sqrt(w)[:, None]) * np.sqrt(w))[0]
    return rows


def quantile(v: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    """Quantiles of each row of sorted v at h = p (n + 1), the ends beyond."""
    n = v.shape[1]
    h = np.clip(np.broadcast_to(np.asarray(p, float), v.shape[:1]) * (n + 1), 1, n)
    i = np.minimum(h.astype(int) - 1, n - 1)
    r = np.arange(len(v))
    return v[r, i] + (h - h.astype(int)) * (v[r, np.minimum(i + 1, n - 1)] - v[r, i])


def strata(points: DataFrame, n: int, x: str = "r") -> DataFrame:
    """points with stratum from 1: between the distinct quantiles of x, the lowest included."""
    cuts = points.agg(F.array_distinct(F.percentile(x, F.array(*[F.lit(i / n) for i in range(n + 1)]))).alias("cuts"))
    inner = F.size(F.filter("cuts", lambda c: c < F.col(x)))
    return points.crossJoin(F.broadcast(cuts)).withColumn("stratum", F.greatest(F.lit(1), inner).cast("int")).drop("cuts")


def order_statistics(rows: DataFrame, rank: Column, total: int | Column, most: int) -> DataFrame:
    """Of ranked rows (from 0) those in the middle of `most` equal runs of ranks; all if they are no more."""
    n = F.lit(total) if isinstance(total, int) else total
    share = F.lit(float(most)) / n
    return rows.where((n <= most) | (F.floor((rank + 0.5) * share + 0.5) > F.floor((rank - 0.5) * share + 0.5)))


@dataclass(frozen=True)
class Places:
    """Where local fits are taken, and how far the k nearest points reach from there."""

    at: np.ndarray
    reach: np.ndarray

    def weights(self, x: np.ndarray) -> np.ndarray:
        """Tricube weights (places, points); where the nearest points are all at a place itself, these alone count."""
        d = np.abs(x[None, :] - self.at[:, None])
        flat = self.reach <= 0
        w = np.clip(1 - (d / np.where(flat, 1.0, self.reach)[:, None]) ** 3, 0, None) ** 3
        w[flat] = d[flat] == 0
        return w

    def near(self, x: np.ndarray) -> Places:
        """Those that any of the points can reach."""
        return Places(*(v[self.mask(x)] for v in (self.at, self.reach)))

    def mask(self, x: np.ndarray) -> np.ndarray:
        return (self.at - self.reach <= x.max()) & (self.at + self.reach >= x.min())


def reaches(order: np.ndarray, n: int, at: np.ndarray, k: int) -> np.ndarray:
    """The distance from each place to the k-th nearest of n points, of which `order` has evenly spaced order statistics (or all): k is met
    to within n / len(order). The k nearest lie side by side; of such runs the one with the nearest farther end counts."""
    m = len(order)
    k = min(m, max(2, math.ceil(k * m / n)))
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), m - k)
    while (lo < hi).any():  # the first run whose right end is farther than its left one
        mid = (lo + hi) // 2
        right = order[mid + k - 1] - at >= at - order[mid]
        hi = np.where(right & (lo < hi), mid, hi)
        lo = np.where(~right & (lo < hi), mid + 1, lo)
    ends = lambda i: np.maximum(np.abs(at - order[i]), np.abs(order[i + k - 1] - at))
    return np.minimum(ends(lo), ends(np.maximum(lo - 1, 0)))


def batched(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            yield [batch.column(c).slice(lo, BATCH).to_numpy(zero_copy_only=False) for c in columns]


def local_sums(points: DataFrame, places: Places) -> np.ndarray:
    """Rows (sum w, w c, w c c, w y, w c y, w w) for each place, c = x less the place: a pass over points (x, y)."""
    sent = points.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = sent.value
        total = np.zeros((len(all_.at), 6))
        for x, y in batched(batches, ["x", "y"]):
            for lo in range(0, len(all_.at), 512):  # so many weights at once
                part = Places(all_.at[lo : lo + 512], all_.reach[lo : lo + 512])
                mask = np.flatnonzero(part.mask(x))
                some = Places(part.at[mask], part.reach[mask])
                w = some.weights(x)
                c = x[None, :] - some.at[:, None]
                wc = w * c
                total[lo + mask] += np.stack([w.sum(axis=1), wc.sum(axis=1), (wc * c).sum(axis=1), w @ y, wc @ y, (w * w).sum(axis=1)], axis=1)
        hit = np.flatnonzero(total[:, 0] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(hit), *(pa.array(total[hit, j]) for j in range(6))], names=["i", *"abcdef"])

    out = np.zeros((len(places.at), 6))
    summed = points.select("x", "y").mapInArrow(run, "i long, a double, b double, c double, d double, e double, f double").groupBy("i").agg(*[F.sum(c).alias(c) for c in "abcdef"])
    for r in summed.collect():  # a row a place
        out[r.i] = r[1:]
    return out


def solved(s: np.ndarray, degree: int) -> np.ndarray:
    """Local fits from local_sums(); the weighted mean where there is no slope to fit."""
    s0, s1, s2, t0, t1 = s[:, :5].T
    det = s0 * s2 - s1 * s1
    mean = t0 / s0
    if degree == 0:
        return mean
    fine = np.abs(det) >= 1e-14
    slope = (s0 * t1 - s1 * t0) / np.where(fine, det, 1.0)
    return np.where(fine, (t0 - slope * s1) / s0, mean)


def nearest(n: int, span: float, k_max: int) -> int:
    """Points of a local fit."""
    k = max(2, math.ceil((span if span > 0 else 0.3) * n))
    return min(k, n, k_max) if k_max > 0 else min(k, n)


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def local_fit(points: DataFrame, grid: np.ndarray, span: float = 0.45, degree: int = 1, k_max: int = 0) -> DataFrame:
    """(x, fit, w2): the local fit of y on x at the grid, and the sum of squared normalised weights. points: (x, y)."""
    curve, *_ = fitted(points.select("x", "y"), grid, span, degree, k_max)
    return points.sparkSession.createDataFrame(curve[["x", "fit", "w2"]])


def fitted(points: DataFrame, grid: np.ndarray, span: float, degree: int, k_max: int) -> tuple[pd.DataFrame, DataFrame, np.ndarray, np.ndarray, int]:
    """The curve (x, fit, w2) and its Places, the points by rank, the knots' x and (fit, sum of weights), and the number of points."""
    rows, n = ranked(points, [F.col(c) for c in ("x", "y")])
    rows = stored(rows)
    if n < 5:
        raise ValueError("too few points")
    order = np.sort(order_statistics(rows, F.col("rank"), n, ORDER).select("x").toPandas()["x"].to_numpy(float))  # ORDER at most
    knots = np.unique(order)
    if len(knots) > KNOTS:
        knots = np.unique(order[np.linspace(0, len(order) - 1, KNOTS).round().astype(int)])
    at = np.concatenate([np.asarray(grid, float), knots])
    places = Places(at, reaches(order, n, at, nearest(n, span, k_max)))
    s = local_sums(rows, places)
    with np.errstate(invalid="ignore", divide="ignore"):
        fits, w2 = solved(s, degree), s[:, 5] / s[:, 0] ** 2
    m = len(grid)
    curve = pd.DataFrame({"x": at[:m], "fit": fits[:m], "w2": np.where(places.reach[:m] > 0, w2[:m], 0.0)})
    return curve, rows, np.stack([knots, fits[m:], s[m:, 0], places.reach[m:]]), Places(at[:m], places.reach[:m]), n


def bootstrap_curve(points: DataFrame, grid: np.ndarray, b: int = 1000, span: float = 0.45, degree: int = 1, k_max: int = 0, level: float = 0.95, seed: int = 77) -> DataFrame:
    """(x, fit, lo, hi, lo_basic, hi_basic, lo_bc, hi_bc, edf, sigma2, sigma2_raw, w2): the local fit of y on x at the grid, and bands from
    resampling residuals within strata. points: (x, y, stratum), any number.

    The points' own fits are linear between KNOTS of x. edf is the sum over points of their own kernel weight, normalised, whatever the
    degree. Sample s gives the point of rank i the residual that a hash of (seed, s, i) draws from its stratum's order statistics, so
    results don't depend on the tasks. A pass over the points gives each task's weighted sums of all samples at the grid; they are added
    and solved by grid point."""
    spark = points.sparkSession
    curve, rows, (knots, own, weight, reach), places, n = fitted(points.select("x", "y", "stratum"), grid, span, degree, k_max)
    sent_knots = spark.sparkContext.broadcast((knots, own, np.where(reach > 0, 1 / np.maximum(weight, 1e-300), 1.0)))

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, fits, hats = sent_knots.value
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
            fit = np.interp(x, k, fits)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "stratum", "rank")), pa.array(fit), pa.array(y - fit), pa.array(np.interp(x, k, hats))], names=["x", "stratum", "rank", "fit", "e", "h"])

    every = stored(rows.select("x", "y", F.col("stratum").cast("int").alias("stratum"), "rank").mapInArrow(residuals, "x double, stratum int, rank long, fit double, e double, h double"))
    total = every.agg(F.sum("h").alias("edf"), F.sum(F.col("e") * F.col("e")).alias("ss")).first()
    by, _ = ranked(every.select("stratum", "e"), [F.col("stratum"), F.col("e")])
    first = by.groupBy("stratum").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    pool = order_statistics(by.join(F.broadcast(first), "stratum"), F.col("rank") - F.col("first"), F.col("size"), POOL).select("stratum", "e").toPandas()  # POOL a stratum at most
    pools = {int(s): np.sort(v.to_numpy(float)) for s, v in pool.groupby("stratum")["e"]}
    sent = spark.sparkContext.broadcast((places, pools))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, drawn_from = sent.value
        t = np.zeros((2, len(at.at), b))
        for x, stratum, rank, fit in batched(batches, ["x", "stratum", "rank", "fit"]):
            mask = np.flatnonzero(at.mask(x))
            if not len(mask):
                continue
            w = Places(at.at[mask], at.reach[mask]).weights(x)
            wc = w * (x[None, :] - at.at[mask][:, None])
            for lo in range(0, b, SAMPLES):
                s = np.arange(lo, min(b, lo + SAMPLES), dtype=np.uint64)
                u = (mixed(mixed(rank.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) + s[None, :] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)).astype(float) / (1 << 53)
                y = np.empty_like(u)
                for g in np.unique(stratum).tolist():
                    mine, e = stratum == g, drawn_from[g]
                    y[mine] = fit[mine, None] + e[(u[mine] * len(e)).astype(np.int64)]
                t[0][np.ix_(mask, s.astype(np.int64))] += w @ y
                t[1][np.ix_(mask, s.astype(np.int64))] += wc @ y
        hit = np.flatnonzero((t[0] != 0).any(axis=1) | (t[1] != 0).any(axis=1))
        for i in hit.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t[0][i]]), pa.array([t[1][i]])], names=["i", "t0", "t1"])

    sums = local_sums(rows, places)
    low, high = (1 - level) / 2, (1 + level) / 2
    facts = spark.sparkContext.broadcast((curve, sums))

    def bands(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        t0, t1 = (np.sum(np.stack([np.asarray(v, float) for v in pdf[c]]), axis=0) for c in ("t0", "t1"))
        own, s = facts.value[0].iloc[i], facts.value[1][i]
        boot = solved(np.column_stack([np.tile(s[:3], (b, 1)), t0, t1]), degree)
        centre, boot = float(own["fit"]), np.sort(boot)[None, :]
        lo, hi = quantile(boot, low)[0], quantile(boot, high)[0]
        nd = NormalDist()
        z = nd.inv_cdf(((boot < centre).sum() + 0.5) / (b + 1.0))
        bias = [quantile(boot, nd.cdf(2 * z + nd.inv_cdf(p)))[0] for p in (low, high)]
        return pd.DataFrame([(own["x"], centre, lo, hi, 2 * centre - hi, 2 * centre - lo, *bias, own["w2"])], columns=["x", "fit", "lo", "hi", "lo_basic", "hi_basic", "lo_bc", "hi_bc", "w2"])

    names = ("x", "fit", "lo", "hi", "lo_basic", "hi_basic", "lo_bc", "hi_bc", "w2")
    parts = every.select("x", "stratum", "rank", "fit").mapInArrow(sampled, "i long, t0 array<double>, t1 array<double>")
    out = parts.groupBy("i").applyInPandas(bands, ", ".join(f"{c} double" for c in names))
    edf = float(total.edf)
    out = out.withColumns({"edf": F.lit(edf), "sigma2": F.lit(float(total.ss) / max(1.0, n - max(1.0, edf))), "sigma2_raw": F.lit(float(total.ss) / max(1, n - 1))})
    return out.select(*names[:-1], "edf", "sigma2", "sigma2_raw", "w2")


def width_floor(curve: DataFrame, floor: Column) -> DataFrame:
    """curve with lo and hi apart by the floor at least, around the same centre; reapplied says where, shortfall by how much."""
    width = F.col("hi") - F.col("lo")
    short = F.coalesce((floor > 0) & (width < floor), F.lit(False))
    centre = (F.col("lo") + F.col("hi")) / 2
    return curve.select(*[c for c in curve.columns if c not in ("lo", "hi")], F.when(short, centre - floor / 2).otherwise(F.col("lo")).alias("lo"), F.when(short, centre + floor / 2).otherwise(F.col("hi")).alias("hi"), short.alias("reapplied"), F.when(short, floor - width).otherwise(0.0).alias("shortfall"))


def local_mad(points: DataFrame, curve: DataFrame, k: int = 200) -> DataFrame:
    """(x, mad) for each x of the curve (x, fit): 1.4826 times the median deviation of the residuals of the k points nearest to x (of
    equally near ones those of lesser x, then residual). Each task gives its own k nearest among those that the order statistics of x
    leave in question."""
    spark = points.sparkSession
    rows, n = ranked(interpolate(points.select("x", "y"), curve, "x", ["fit"]).select("x", (F.col("y") - F.col("fit")).alias("e")), [F.col("x"), F.col("e")])
    rows = stored(rows)
    order = np.sort(order_statistics(rows, F.col("rank"), n, ORDER).select("x").toPandas()["x"].to_numpy(float))
    at = np.sort(curve.select("x").toPandas()["x"].to_numpy(float))  # a row a grid point
    k = min(k, n)
    sent = spark.sparkContext.broadcast((at, reaches(order, n, at, min(n, k + 2 * math.ceil(n / max(len(order), 1)))) if n else at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, reach = sent.value
        held = [np.zeros((0, 3))] * len(places)
        for x, e in batched(batches, ["x", "e"]):
            for i in np.flatnonzero((places - reach <= x.max()) & (places + reach >= x.min())).tolist():
                d = np.abs(x - places[i])
                some = d <= reach[i]
                both = np.concatenate([held[i], np.stack([d[some], x[some], e[some]], axis=1)])
                held[i] = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))[:k]]
        for i, v in enumerate(held):
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), places[i])), *(pa.array(v[:, j]) for j in range(3))], names=["at", "d", "x", "e"])

    def mad(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        near = pdf.sort_values(["d", "x", "e"])["e"].to_numpy()[:k]
        return pd.DataFrame({"x": [key[0]], "mad": [1.4826 * float(np.median(np.abs(near - np.median(near))))]})

    return rows.select("x", "e").mapInArrow(run, "at double, d double, x double, e double").groupBy("at").applyInPandas(mad, "x double, mad double")


def finished_curve(points: DataFrame, curve: DataFrame, method: str = "percentile", min_rel_width: float = 0.0, widen_span: float = 0.1, near: int = 200) -> DataFrame:
    """(x, fit, lo, hi, floor, reapplied, shortfall): the band of a method (percentile, basic, bc), made as wide as min_rel_width of the
    fit's range (smoothed) and as twice 1.96 local deviations of the points' residuals, its edges smoothed, and the floors applied again.
    The curve has as many rows as its grid, so the last steps are the driver's."""
    names = {"percentile": ("lo", "hi"), "basic": ("lo_basic", "hi_basic"), "bc": ("lo_bc", "hi_bc")}[method]
    rows = curve.select("x", "fit", *[F.col(c).alias(n) for c, n in zip(names, ("lo", "hi"), strict=True)]).orderBy("x").toPandas()
    x, fit, lo, hi = (rows[c].to_numpy(float) for c in ("x", "fit", "lo", "hi"))
    floor = np.zeros(len(x))

    def widened(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre, width = (lo + hi) / 2, np.maximum(hi - lo, least)
        return centre - width / 2, centre + width / 2

    if min_rel_width > 0:
        spread = float(np.ptp(fit[np.isfinite(fit)])) or 1.0
        floor = np.maximum(floor, min_rel_width * spread)
        width = np.maximum(hi - lo, floor)
        if widen_span > 0 and len(x) > 10:
            smooth = smoother(x, x, max(4, math.floor(widen_span * len(x) + 1e-5)), 2) @ width
            width = np.maximum(smooth, floor) if np.isfinite(smooth).all() else width
        lo, hi = (lo + hi) / 2 - width / 2, (lo + hi) / 2 + width / 2
    if points.count() > 20:
        mad = local_mad(points, curve, near).toPandas().set_index("x")["mad"].reindex(x).to_numpy(float)
        need = np.where(np.isfinite(mad) & (mad > 0), 2 * 1.96 * mad, 0.0)
        floor = np.maximum(floor, need)
        lo, hi = widened(need)
    if len(x) >= 15:
        edges = smoother(x, x, max(2, math.floor((0.06 + 10 / len(x)) * len(x) + 1e-5)))
        width, centre = np.maximum(edges @ hi - edges @ lo, 0), (lo + hi) / 2
        if np.isfinite(width).all():
            lo, hi = centre - width / 2, centre + width / 2
    out = points.sparkSession.createDataFrame(pd.DataFrame({"x": x, "fit": fit, "lo": lo, "hi": hi, "floor": floor}))
    return width_floor(out, F.col("floor"))


def interpolate(points: DataFrame, curve: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """points with the columns of an evenly spaced curve (x, ..) at column `at`, linear in between and constant beyond the ends. The
    step is known, so each point finds its two curve points by number: equi-joins, no range join."""
    nth = Window.orderBy("x")
    numbered = curve.select((F.row_number().over(nth) - 1).cast("long").alias("__i"), "x", *columns)  # as many rows as the curve has
    ends = numbered.agg(F.min("x").alias("__x0"), F.max("x").alias("__x1"), F.max("__i").alias("__n"))
    step = (F.col("__x1") - F.col("__x0")) / F.greatest(F.col("__n"), F.lit(1))
    place = F.least(F.greatest(F.coalesce(F.try_divide(F.col(at) - F.col("__x0"), step), F.lit(0.0)), F.lit(0.0)), F.col("__n").cast("double"))
    low = F.least(F.floor("__t"), F.greatest(F.col("__n") - 1, F.lit(0)))
    placed = points.crossJoin(F.broadcast(ends)).withColumn("__t", place).withColumn("__i", low.cast("long"))
    nxt = numbered.select((F.col("__i") - 1).alias("__i"), *[F.col(c).alias(f"__next_{c}") for c in columns])
    met = placed.join(F.broadcast(numbered.select("__i", *[F.col(c).alias(f"__at_{c}") for c in columns])), "__i").join(F.broadcast(nxt), "__i", "left")
    share = F.col("__t") - F.col("__i")
    values = [(F.col(f"__at_{c}") + share * (F.coalesce(f"__next_{c}", f"__at_{c}") - F.col(f"__at_{c}"))).alias(c) for c in columns]
    return met.select(*points.columns, *values)


def ci_rule(pairs: DataFrame, curve: DataFrame, rule: str) -> DataFrame:
    """Pairs (r, L) outside of the curve's band (remove_within), inside (remove_outside), or all (none), with lo and hi at r."""
    out = interpolate(pairs, curve, "r", ["lo", "hi"])
    outside = (F.col("L") < F.col("lo")) | (F.col("L") > F.col("hi"))
    return out.where({"remove_within": outside, "remove_outside": ~outside, "none": F.lit(True)}[rule])


def running_median(points: DataFrame, k: int, order: str, value: str) -> DataFrame:
    """points with smooth, the median of the k values around each in order (fewer at the ends). Rows go to blocks of many k of their
    rank, with copies of the neighbours at the edges, so no window holds all rows."""
    half = k // 2
    size = max(1024, 16 * k)
    rows, total = ranked(points, [F.col(order), F.col(value)], "__rank")
    blocks = F.filter(F.sequence(F.expr(f"greatest(0L, __rank - {half}) div {size}"), F.expr(f"least({max(total - 1, 0)}L, __rank + {half}) div {size}")), lambda b: b >= 0)
    dealt = rows.withColumn("__block", F.explode(blocks))
    window = Window.partitionBy("__block").orderBy("__rank").rowsBetween(-half, half)
    smooth = dealt.withColumn("smooth", F.percentile(value, F.lit(0.5)).over(window))
    return smooth.where(F.expr(f"__rank div {size}") == F.col("__block")).select(*points.columns, "smooth")
