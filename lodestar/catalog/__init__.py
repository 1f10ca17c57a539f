"""Queries over the driver's tables, one or more for each operator, beside DuckDB SQL that
gives the same rows. Floating-point results are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries, and SQL for those that it can express."""
    from . import checks, features, planning, quality, relations, requests, searches, stores, streams, timeline, vectors

    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for module in (vectors, relations, timeline, quality, planning, streams, checks, features, requests, searches, stores):
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
