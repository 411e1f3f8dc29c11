"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.plans import corpora, exchange, governance, graphs, measures, numeric, planning, structure, texts

_MODULES = (numeric, texts, graphs, governance, corpora, planning, exchange, structure, measures)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
