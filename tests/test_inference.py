import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.distributions import beta_cdf, beta_quantile, signed_z, t_two_sided
from tessella.operators import curve, inference, metadata, ranking


def test_distributions():
    assert float(beta_cdf(2, 3, 0.4)) == pytest.approx(0.5248, abs=1e-12)
    assert float(beta_cdf(0.5, 0.5, 0.5)) == pytest.approx(0.5, abs=1e-12)
    assert float(t_two_sided(np.array([2.0]), np.array([10.0]))[0]) == pytest.approx(0.07338803, abs=1e-8)
    assert beta_cdf(3, 4, beta_quantile(0.3, np.array([3.0]), np.array([4.0])))[0] == pytest.approx(0.3, abs=1e-12)


def ps(spark, values):
    return spark.createDataFrame([(f"a{i}", f"b{i}", v) for i, v in enumerate(values)], "gene1 string, gene2 string, p double")


def bh(p, n):
    order = np.argsort(p)
    q = np.minimum.accumulate((np.array(p)[order] * n / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


def test_adjustments(spark):
    p = [0.01, 0.04, 0.2, 0.8, 0.04]
    got = {r.gene1: r.fdr for r in inference.adjusted(ps(spark, [*p, None, float("nan"), float("inf")])).collect()}
    assert [got[f"a{i}"] for i in range(5)] == pytest.approx(bh(p, 5)) and all(got[f"a{i}"] is None for i in (5, 6, 7))
    by = {r.gene1: r.fdr for r in inference.adjusted(ps(spark, [0.01, 0.02]), "p", "BY", 10).collect()}
    h = sum(1 / i for i in range(1, 11))
    assert by["a0"] == pytest.approx(min(1, 0.1 * h)) and by["a1"] == pytest.approx(min(1, 0.1 * h))
    bonf = [r.fdr for r in inference.adjusted(ps(spark, [0.01, 0.2]), "p", "bonferroni", 10).orderBy("p").collect()]
    assert bonf == pytest.approx([0.1, 1.0])


def test_storey(spark):
    p = [0.001, 0.01, 0.3, 0.52, 0.6, 0.9]
    pi0 = min(1, min(np.mean(np.array(p) > lam) / (1 - lam) for lam in np.arange(0.5, 0.96, 0.05)))
    pi0 = pi0 if pi0 > 0 else 1.0
    got = [r.q for r in inference.storey(ps(spark, p)).orderBy("p").collect()]
    assert got == pytest.approx(np.minimum(1, bh(p, 6) * pi0))


def test_signed_z(spark):
    df = spark.createDataFrame([(0.5, 0.05), (-0.5, 0.05), (0.5, 1.0), (0.5, None)], "L double, p double")
    z = [r.z for r in df.select(signed_z(F.col("L"), F.col("p")).alias("z")).collect()]
    assert z[0] == pytest.approx(1.959964, abs=1e-6) and z[1] == -z[0] and z[2] == 0 and z[3] is None


def test_ties_stay(spark):
    df = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 2.0), ("a", "d", 2.0), ("b", "c", 1.0)], "gene1 string, gene2 string, Delta double")
    assert ranking.top_pairs(df, 2).count() == 3 and ranking.top_pairs(df, 2, "both").count() == 4
    assert ranking.labelled_extremes(df, 2).count() == 4


def test_interpolation_and_floor(spark):
    c = spark.createDataFrame([(float(x), float(x * x), 0.0) for x in range(5)], "x double, lo double, hi double")
    pts = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.25, 3.5, 4.0, 9.0)], "r double")
    got = {r.r: r.lo for r in curve.interpolate(pts, c, "r", ["lo"]).collect()}
    assert got == pytest.approx({v: float(np.interp(v, range(5), [x * x for x in range(5)])) for v in got})
    wide = curve.width_floor(spark.createDataFrame([(0.0, 0.1, 0.4), (0.0, 1.0, 0.4), (1.0, 1.0, 0.3), (0.0, 1.0, 0.0)], "lo double, hi double, f double"), F.col("f"))
    rows = wide.collect()
    assert sum(r.reapplied for r in rows) == 2 and max(r.shortfall for r in rows) == pytest.approx(0.3)


def test_curve_doesn_t_depend_on_tasks(spark):
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(-1, 1, 72))
    pts = spark.createDataFrame([(float(a), float(a * a + rng.normal(0, 0.1)), i % 4 + 1) for i, a in enumerate(x)], "x double, y double, stratum int")
    grid = np.linspace(-0.9, 0.9, 21)
    a = curve.bootstrap_curve(pts, grid, 41).orderBy("x").toPandas()
    b = curve.bootstrap_curve(pts.repartition(7), grid, 41).repartition(1).orderBy("x").toPandas()
    assert np.allclose(a.to_numpy(), b.to_numpy(), rtol=0, atol=1e-12)
    assert (a["lo"] <= a["hi"]).all() and np.abs(a["fit"] - grid**2).max() < 0.25
    s = curve.smoother(x, grid, 33)
    assert np.allclose(s @ (3 * x + 1), 3 * grid + 1)


def test_wilcoxon(spark):
    d = [0.5, -0.2, 0.3, 0.3, 0.0, 0.9]
    t = spark.createDataFrame([(f"g{i}", v, 0.0) for i, v in enumerate(d)], "gene string, within double, between double")
    r = inference.signed_rank(t).first()
    assert r.n == 5 and r.v == 14.0  # ranks 4, 1, 2.5, 2.5, 5
    sd = math.sqrt(5 * 6 * 11 / 24 - 6 / 48)
    assert r.z == pytest.approx((14 - 7.5 - 0.5) / sd)
    assert inference.sign_flips(t, 50).first().p <= 1


@pytest.mark.parametrize("rows", [[], [("g1", 1.0, 1.0), ("g2", 0.5, 0.5)]])
@pytest.mark.parametrize("alternative", ["greater", "less", "two.sided"])
def test_wilcoxon_without_differences(spark, rows, alternative):
    t = spark.createDataFrame(rows, "gene string, within double, between double")
    assert tuple(inference.signed_rank(t, alternative).first()) == (0, None, None, None)


def test_migration_is_idempotent_and_stale_inputs_fail(spark):
    rows = spark.createDataFrame([("a", "xenium", 1), ("b", "xenium", 2), ("__scope_platform__", "cosmx", None)], "gene string, platform string, cluster int")
    once, found = metadata.migrated(rows, {}, {"dataset": "d"})
    assert found == {"schema_version": 2, "platform": "Xenium", "dataset": "d"} and once.columns == ["gene", "cluster"]
    twice, again = metadata.migrated(once, found, {})
    assert again == found and sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert metadata.fingerprint(rows).first() == metadata.fingerprint(rows.repartition(5)).first()
    stored = {"formula": 1, "layer": "Xz", "data_hash": 5, "weight_hash": 6, "style": "B", "s2": 10.0}
    metadata.require_fresh(stored, stored | {"s2": 10.0 + 1e-13})
    for change in ({"data_hash": 7}, {"weight_hash": 1}, {"s2": 10.1}):
        with pytest.raises(ValueError):
            metadata.require_fresh(stored, stored | change)
