"""Named queries over the driver's tables, and SQL twins. A name starts with the id of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagflow.plans import control, items, lifecycle, recursive, streams, texts

GROUPS = (texts, items, lifecycle, recursive, streams, control)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for g in GROUPS for name, f in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.SQL.items()}
