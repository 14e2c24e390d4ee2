"""All queries of the library's own operators, by the name of the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import basic, networks, registry, spatial

FLAGSHIP = "LEE01_lees_l"
MODULES = (basic, spatial, networks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
