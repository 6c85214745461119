"""Registered queries of the graph, text and ledger jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation, events, ledger, repair, retrieval

_FAMILIES = (retrieval, ledger, curation, repair, events)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLE.items()}
