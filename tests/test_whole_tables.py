"""Queries over whole tables beside those whose SQL selects rows."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tessella.operators import grids, inference, weights
from tessella.plans.basic import lee
from tessella.plans.registry import xz

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "part", "orders", "customer", "supplier", "nation", "region", "events")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize(("name", "rows"), [("SRC04_boundaries", "customer"), ("SRC11_scalefactors", "part"), ("SRC02_molecule_scan", "lineitem"), ("PRM04_delta_recomputed", None), ("WGT10_lattice_check", None), ("GRF18_spanning_trees", None)])
def test_queries_over_whole_tables(spark, con, name, rows):
    """As many rows as the table has where each of its rows gives one, and those of the SQL."""
    df = __spark_entry__.queries()[name](spark, SF)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    order = lambda r: tuple(round(x, 3) if isinstance(x, float) else str(x) for x in r)
    want, got = sorted(map(tuple, found.fetchall()), key=order), sorted((tuple(r[c] for c in names) for r in df.collect()), key=order)
    assert len(got) == len(want) and (rows is None or len(got) == spark.read.parquet(f"{SF}/{rows}.parquet").count())
    for g, w in zip(got, want, strict=True):
        assert all(a == (pytest.approx(b, abs=2e-6) if isinstance(b, float) else b) for a, b in zip(g, w, strict=True))


@pytest.mark.parametrize(("name", "block"), [("PRM01_global_permutations", False), ("PRM02_block_permutations", True)])
def test_permutations_of_all_pairs(spark, name, block):
    got = {(r.gene1, r.gene2): (r.k, r.p) for r in __spark_entry__.queries()[name](spark, SF).collect()}
    info, values = xz(spark, SF)
    tiles = {r.grid_id: i for i, r in enumerate(info.collect())}
    rows = values.collect()
    genes = sorted({r.gene for r in rows})
    z, w = np.zeros((len(tiles), len(genes))), np.zeros((len(tiles), len(tiles)))
    for r in rows:
        z[tiles[r.grid_id], genes.index(r.gene)] = r.z
    for r in weights.weights(info).collect():
        w[tiles[r.i], tiles[r.j]] = r.w
    n = 99 if block else 999
    perms = inference.permutations(grids.block_ids(info, 4), n, "block") if block else inference.permutations(info.select("grid_id"), n)
    source = np.zeros((n + 1, len(tiles)), int)
    for r in perms.collect():
        source[r.b, tiles[r.grid_id]] = tiles[r.src]
    source[0] = np.arange(len(tiles))
    q = (z**2).sum(axis=0)
    lag = [w @ z[at] for at in source]
    values_l = [len(tiles) / (w.sum(axis=1) ** 2).sum() * (x.T @ x) / np.sqrt(np.outer(q, q)) for x in lag]
    want = {}
    for i, a in enumerate(genes):
        for j in range(i + 1, len(genes)):
            k = sum(abs(v[i, j]) >= abs(values_l[0][i, j]) - 1e-12 for v in values_l[1:])
            want[a, genes[j]] = (k, pytest.approx((k + 1) / (n + 1), abs=1e-6))
    assert got == want and len(got) == lee(spark, SF).count() == len(genes) * (len(genes) - 1) // 2
