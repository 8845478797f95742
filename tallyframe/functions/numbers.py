"""Numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(column: Column, low: Column, high: Column) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, low), high))


def xor_int(column: Column, mask: int) -> Column:
    """Bitwise XOR of the rounded value."""
    return F.round(column).cast("bigint").bitwiseXOR(F.lit(mask).cast("bigint"))


def bin_right_closed(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge, next edge] holding the value, else NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    result = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        result = F.when((column > low) & (column <= high), label).otherwise(result)
    return result


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient; NULL when the denominator is zero."""
    return F.try_divide(numerator, denominator)


def is_leap(year: Column) -> Column:
    return (year % 400 == 0) | ((year % 4 == 0) & (year % 100 != 0))


def leap_label(year: Column) -> Column:
    return F.when(is_leap(year), "Leap Year").otherwise("Not a Leap Year")
