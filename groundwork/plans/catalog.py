"""All registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import editions, retrieval, service, versions_web

MODULES = (retrieval, versions_web, service, editions)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE.items()}
