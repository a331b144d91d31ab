"""Helpers shared by the column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup(table: dict, key: Column) -> Column:
    """The value of ``key`` in a fixed table, or null."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
