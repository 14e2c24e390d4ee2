"""Queries by name, with DuckDB SQL for the same rows where there is some; and the pieces of SQL they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids, points
from ..sources.tables import molecules
from ..storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Length of the tiles of all single-size queries, and decimals of floating results.
LENGTH, DIGITS = 100.0, 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floating columns to so many decimals, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def r(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def good(spark: SparkSession, sf: str, panel: str = "brand") -> DataFrame:
    """Molecules after the default filters."""
    return points.good_quality(points.near_nucleus(molecules(spark, sf, panel)))


def layer(spark: SparkSession, sf: str, panel: str = "brand") -> tuple[DataFrame, DataFrame]:
    return grids.layer(good(spark, sf, panel), LENGTH)


def xz(spark: SparkSession, sf: str, panel: str = "brand") -> tuple[DataFrame, DataFrame]:
    """(tile table, normalised values)."""
    info, counts = layer(spark, sf, panel)
    return info, stored(grids.normalise(counts, info))


def md5_int(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("_", *parts)), 1, 8), 16, 10).cast("long")


def md5_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({" || '_' || ".join(parts)}), 1, 8))::BIGINT"


#: Common table expressions, each with what it needs before it.
CTE = {
    "mol": ([], "SELECT l_orderkey * 8 + l_linenumber AS mol_id, l_orderkey AS cell, p_brand AS gene, l_extendedprice / 100.0::DOUBLE AS x, l_quantity * 20.0::DOUBLE AS y, 40.0::DOUBLE - 2.5::DOUBLE * CAST(round(l_discount * 100) AS INT) AS qv, 4.0::DOUBLE * CAST(round(l_tax * 100) AS INT) AS nd FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "good": (["mol"], "SELECT * FROM mol WHERE qv >= 20 AND nd <= 25"),
    "box": (["good"], "SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM good"),
    "org": (["box"], "SELECT floor(xmin / 100) * 100 AS x0, floor(ymin / 100) * 100 AS y0, xmin, xmax, ymin, ymax FROM box"),
    "cnt0": (["org"], "SELECT (floor((x - x0) / 100) + 1)::INT AS gx, (floor((y - y0) / 100) + 1)::INT AS gy, gene, count(*) AS c FROM good, org GROUP BY ALL"),
    "tile0": (["org"], "SELECT a.g::INT AS gx, b.g::INT AS gy, 'g' || a.g || '_' || b.g AS grid_id, x0 + (a.g - 1) * 100 AS xmin, least(x0 + a.g * 100, xmax) AS xmax, y0 + (b.g - 1) * 100 AS ymin, least(y0 + b.g * 100, ymax) AS ymax FROM (SELECT x0, y0, xmax, ymax FROM org), range(1, 1000) AS a(g), range(1, 1000) AS b(g) WHERE a.g <= ceil((xmax - x0) / 100) AND b.g <= ceil((ymax - y0) / 100)"),
    "tile": (["tile0"], "SELECT *, (xmin + xmax) / 2 AS center_x, (ymin + ymax) / 2 AS center_y, xmax - xmin AS width, ymax - ymin AS height FROM tile0 WHERE abs(xmax - xmin - 100) < 1e-6 AND abs(ymax - ymin - 100) < 1e-6"),
    "info": (["tile", "cnt0"], "SELECT * FROM tile SEMI JOIN cnt0 USING (gx, gy)"),
    "counts": (["info", "cnt0"], "SELECT grid_id, gene, c FROM cnt0 JOIN info USING (gx, gy)"),
    "lib": (["counts"], "SELECT grid_id, sum(c)::DOUBLE AS lib FROM counts GROUP BY grid_id"),
    "share": (["lib"], "SELECT grid_id, gene, c / lib AS s FROM counts JOIN lib USING (grid_id)"),
    "mom": (["share"], "SELECT gene, sum(s) / n AS mean, sqrt((sum(s * s) - sum(s) * sum(s) / n) / (n - 1)) AS sd FROM share, (SELECT count(*)::DOUBLE AS n FROM info) GROUP BY gene, n"),
    "xz": (["mom"], "SELECT info.grid_id, mom.gene, CASE WHEN sd > 1e-12 THEN (coalesce(s, 0) - mean) / sd ELSE 0 END AS z FROM info CROSS JOIN mom LEFT JOIN share ON share.grid_id = info.grid_id AND share.gene = mom.gene"),
    "nb": (["info"], "SELECT a.grid_id AS i, b.grid_id AS j, ((a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2)::DOUBLE AS d2 FROM info a JOIN info b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.grid_id <> b.grid_id"),
    "w": (["nb"], "SELECT i, j, 1.0::DOUBLE AS w FROM nb"),
    "lag": (["w", "xz"], "SELECT i AS grid_id, gene, sum(w * z) AS lag FROM w JOIN xz ON j = grid_id GROUP BY i, gene"),
    "s2": (["w"], "SELECT sum(r * r) AS s2 FROM (SELECT sum(w) AS r FROM w GROUP BY i)"),
    "norm": (["xz"], "SELECT gene, sum(z * z) AS q FROM xz GROUP BY gene"),
    "lee": (["lag", "s2", "norm"], "SELECT a.gene AS gene1, b.gene AS gene2, (SELECT count(*) FROM info) / s2 * sum(a.lag * b.lag) / sqrt(p.q * q.q) AS L FROM lag a JOIN lag b ON a.grid_id = b.grid_id AND a.gene < b.gene JOIN norm p ON p.gene = a.gene JOIN norm q ON q.gene = b.gene, s2 GROUP BY a.gene, b.gene, s2, p.q, q.q"),
    "pear": (["xz"], "SELECT a.gene AS gene1, b.gene AS gene2, corr(a.z, b.z) AS r FROM xz a JOIN xz b ON a.grid_id = b.grid_id AND a.gene < b.gene GROUP BY a.gene, b.gene"),
    "delta": (["lee", "pear"], "SELECT gene1, gene2, L, r, L - r AS Delta FROM lee JOIN pear USING (gene1, gene2)"),
    "cell": (["mol"], "SELECT cell, gene, count(*)::DOUBLE AS c FROM mol GROUP BY cell, gene"),
    "ex": ([], "SELECT vec_id AS sample, printf('f%02d', i - 1) AS gene, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)"),
    "ring": ([], "SELECT c_custkey AS cell_id, c_acctbal / 10.0::DOUBLE + 100.0::DOUBLE AS x, c_nationkey * 40.0::DOUBLE + 21.0::DOUBLE AS y FROM customer"),
    "runs": ([], f"SELECT gene, run::INT AS run, CASE WHEN {md5_sql('run', 'gene')} % 10 < 2 THEN {md5_sql('gene', 'run')} % 4 ELSE {md5_sql('gene')} % 4 END AS label FROM (SELECT DISTINCT p_brand AS gene FROM part), range(1, 9) AS t(run)"),
    "cons": (["runs"], "SELECT a.gene AS gene1, b.gene AS gene2, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.label = b.label AND a.gene < b.gene GROUP BY a.gene, b.gene"),
    "graph": (["lee"], "SELECT gene1, gene2, L, ln(1 + L) AS weight FROM lee WHERE L > 0"),
    "mods": ([], f"SELECT DISTINCT p_brand AS gene, ({md5_sql('p_brand')} % 4)::INT AS module FROM part"),
}


def with_(needs: str, select: str, *extra: str) -> str:
    """select, after the common tables it needs (names separated by spaces) and extra ones ("name AS (...)")."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in CTE[name][0]:
            add(n)
        if name not in out:
            out.append(name)

    for n in needs.split():
        add(n)
    parts = [f"{n} AS ({CTE[n][1]})" for n in out] + list(extra)
    recursive = "RECURSIVE " if any("UNION" in e for e in extra) else ""
    return f"WITH {recursive}{', '.join(parts)} {select}" if parts else select
