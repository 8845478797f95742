"""Array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_put(column: Column, key: Column, value: Column) -> Column:
    """Map with ``key`` set to ``value``, replacing an existing entry."""
    return F.map_concat(map_remove(column, key), F.create_map(key, value))


def map_remove(column: Column, key: Column) -> Column:
    return F.map_filter(column, lambda k, _: k != key)


def zeros_last(column: Column) -> Column:
    """Zeros moved to the end, the order of the others kept."""
    return F.concat(F.filter(column, lambda x: x != 0), F.filter(column, lambda x: x == 0))


def squares(limit: Column) -> Column:
    """[1, 4, 9, ...] up to ``limit`` squared; empty below 1."""
    return F.when(limit >= 1, F.transform(F.sequence(F.lit(1), limit), lambda x: x * x)).otherwise(
        F.array().cast("array<int>")
    )


def array_total(column: Column) -> Column:
    """Left fold with +, starting at zero."""
    return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)


def nested_at(column: Column, outer: int, inner: int) -> Column:
    """Element of a nested array, 1-based, NULL when out of range."""
    return F.try_element_at(F.try_element_at(column, F.lit(outer)), F.lit(inner))
