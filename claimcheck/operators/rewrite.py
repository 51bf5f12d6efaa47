"""Picking a row and rewriting one cell, without DML."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import quoted


def pick(df: DataFrame, key: str, offset: int, *, column: str | None = None, named: list[str] = (), low: Any = None, high: Any = None) -> DataFrame:
    """The row at ``offset`` in the order of ``key`` among those whose column is none of ``named`` and whose key lies between."""
    if column is not None:
        df = df.where(~quoted(column).isin(list(named))) if named else df.where(quoted(column).isNotNull())
    if low is not None:
        df = df.where(quoted(key).between(low, high))
    return df.orderBy(quoted(key)).offset(offset).limit(1)


def with_cell(df: DataFrame, key: str, at: Any, column: str, value: Any) -> DataFrame:
    """The table with one cell changed: an immutable rewrite in the scan's own projection."""
    return df.withColumn(column, F.when(quoted(key) == F.lit(at), F.lit(value)).otherwise(quoted(column)))
