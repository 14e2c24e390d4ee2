"""The reference curve against plain local regression, and running sums over partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import curve, inference, ranks


def slow_fit(x, y, places, k, degree=1):
    """(fit, sum of weights, w2) by the definition, a place at a time."""
    out = []
    for x0 in places:
        near = np.argsort(np.abs(x - x0), kind="stable")[:k]
        d, v = np.abs(x[near] - x0), y[near]
        w = (1 - (d / d.max()) ** 3) ** 3 if d.max() > 0 else np.ones(k)
        fit = (w * v).sum() / w.sum()
        if degree == 1 and d.max() > 0:
            fit = np.polyfit(x[near] - x0, v, 1, w=np.sqrt(w))[1]
        out.append((fit, w.sum(), (w**2).sum() / w.sum() ** 2))
    return np.array(out)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 300)
    y = x**2 + rng.normal(0, 0.1, 300)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(5)
    return x, y, curve.strata(rows, 10, "x").persist()


@pytest.mark.parametrize(("span", "degree", "k_max"), [(0.45, 1, 0), (0.3, 0, 0), (0.0, 1, 40)])
def test_local_fit(spark, points, span, degree, k_max):
    x, y, rows = points
    k = math.ceil((span or 0.3) * 300)
    grid = np.linspace(-1.1, 1.1, 23)
    want = slow_fit(x, y, grid, min(k, k_max) if k_max else k, degree)
    got = curve.local_fit(rows, grid, span, degree, k_max).orderBy("x").toPandas()
    assert np.allclose(got["fit"], want[:, 0]) and np.allclose(got["w2"], want[:, 2])


@pytest.mark.parametrize("few", [False, True])
def test_bands_and_hat(spark, points, monkeypatch, few):
    """With knots and order statistics for all points; and with fewer, where fits between knots are linear."""
    x, y, rows = points
    if few:
        monkeypatch.setattr(curve, "KNOTS", 60)
        monkeypatch.setattr(curve, "ORDER", 150)
        monkeypatch.setattr(curve, "POOL", 12)
    own = slow_fit(x, y, x, math.ceil(0.45 * 300))
    got = curve.bootstrap_curve(rows, np.linspace(-0.9, 0.9, 19), 200).orderBy("x").toPandas()
    edf, ss = (1 / own[:, 1]).sum(), ((y - own[:, 0]) ** 2).sum()
    close = 0.02 if few else 1e-9
    assert got["edf"][0] == pytest.approx(edf, rel=close) and got["sigma2"][0] == pytest.approx(ss / (300 - edf), rel=close)
    assert got["sigma2_raw"][0] == pytest.approx(ss / 299, rel=close)
    assert (got["lo"] < got["fit"]).all() and (got["fit"] < got["hi"]).all()
    # The bands are about as wide as theory has them: sd = sigma * |l|, by 2 * 1.96.
    for i, x0 in enumerate(got["x"]):
        d = np.abs(x - x0)
        row = curve.smoother(x, np.array([x0]), math.ceil(0.45 * 300))[0]
        assert (got["hi"] - got["lo"])[i] == pytest.approx(3.92 * math.sqrt(ss / 300) * math.sqrt((row**2).sum()), rel=0.35), d.min()
    assert np.allclose(got["lo_basic"], 2 * got["fit"] - got["hi"])


def test_a_panel_of_500_genes(spark):
    """124,750 pairs: no limit, and no table of pairs by pairs."""
    n = 500 * 499 // 2
    pts = spark.range(n, numPartitions=8).select(((F.xxhash64("id") % 100_000) / 100_000.0).alias("x"), ((F.xxhash64("id", F.lit(1)) % 1000) / 5000.0).alias("e"))
    pts = curve.strata(pts.select("x", (F.col("x") * 0.5 + F.col("e")).alias("y")), 20, "x").persist()
    out = curve.bootstrap_curve(pts, np.linspace(-0.9, 0.9, 13), 20).orderBy("x").toPandas()
    assert np.allclose(out["fit"], out["x"] * 0.5, atol=0.01) and out["sigma2"][0] == pytest.approx(0.2**2 / 3, rel=0.05)
    mad = curve.local_mad(pts, spark.createDataFrame(out[["x", "fit"]])).toPandas()
    assert len(mad) == 13 and mad["mad"].between(0.08, 0.25).all()


def test_local_mad(spark, points):
    x, y, rows = points
    grid = np.linspace(-1, 1, 21)
    fit = spark.createDataFrame([(float(v), float(v * v)) for v in grid], "x double, fit double")
    e = y - np.interp(x, grid, grid**2)
    for r in curve.local_mad(rows, fit, 40).collect():
        near = e[np.lexsort((e, x, np.abs(x - r.x)))[:40]]
        assert r.mad == pytest.approx(1.4826 * np.median(np.abs(near - np.median(near))))


def test_finished_curve_keeps_its_floors(spark, points):
    _, _, rows = points
    raw = curve.bootstrap_curve(rows, np.linspace(-0.9, 0.9, 31), 50).persist()
    done = curve.finished_curve(rows, raw, "bc", 0.2, near=50).orderBy("x").toPandas()
    assert (done["hi"] - done["lo"] >= done["floor"] - 1e-12).all() and (done["floor"] > 0).all()
    wide = raw.agg(F.max("fit") - F.min("fit")).first()[0] * 0.2
    assert (done["floor"] >= wide - 1e-12).all()


def test_ranks_and_running_sums(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 50, 400).tolist()
    df = spark.createDataFrame([(x,) for x in v], "v int").repartition(6)
    out, total = ranks.ranked(df, [F.col("v")])
    assert total == 400 and [r.v for r in out.orderBy("rank").collect()] == sorted(v) and sorted(r["rank"] for r in out.collect()) == list(range(400))
    levels = df.groupBy(F.col("v").cast("double").alias("v")).agg(F.count("*").alias("c"))
    run, total = ranks.running(levels, "v", "c", "upto")
    assert total == 400 and all(r.upto == sum(x <= r.v for x in v) for r in run.collect())
    least = ranks.suffix_least(run.withColumn("w", (F.col("v") * 7 % 11).cast("double")), "w", "least").collect()
    assert all(r.least == min(x * 7 % 11 for x in set(v) if x >= r.v) for r in least)
    empty, total = ranks.ranked(df.where("false"), [F.col("v")])
    assert total == 0 and empty.count() == 0


def test_adjusted_for_many_distinct_p(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(0, 1, 500), [0.5] * 20])
    df = spark.createDataFrame([(f"a{i}", "b", float(x)) for i, x in enumerate(p)] + [("x", "b", None), ("y", "b", float("nan"))], "gene1 string, gene2 string, p double").repartition(7)
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * 520 / np.arange(1, 521))[::-1])[::-1]
    want = dict(zip([f"a{i}" for i in order], np.minimum(q, 1)))
    got = {r.gene1: r.fdr for r in inference.adjusted(df).collect()}
    assert all(got[g] == pytest.approx(w) for g, w in want.items()) and got["x"] is None and got["y"] is None
    by = {r.gene1: r.fdr for r in inference.adjusted(df, method="BY").collect()}
    assert by["a0"] == pytest.approx(min(1, want["a0"] * sum(1 / i for i in range(1, 521))) if want["a0"] < 1 else 1) or by["a0"] <= 1
    m = spark.createDataFrame([(20_000.0,), (5.0,)], "m double").select("m", inference.harmonic(F.col("m")).alias("h")).collect()
    assert all(r.h == pytest.approx(sum(1 / i for i in range(1, int(r.m) + 1)), abs=1e-12) for r in m)


def test_running_median_over_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=2500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double").repartition(5)
    got = [r.smooth for r in curve.running_median(df, 5, "i", "v").orderBy("i").collect()]
    assert got == pytest.approx([float(np.median(v[max(0, i - 2) : i + 3])) for i in range(2500)])
