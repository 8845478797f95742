"""Schema changes and row changes as new DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.quantiles import global_rank


def add_column(df: DataFrame, name: str, sql_type: str) -> DataFrame:
    """A new nullable column."""
    return df.withColumn(name, F.lit(None).cast(sql_type))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"no column {old!r}")
    return df.withColumnRenamed(old, new)


def update_where(df: DataFrame, condition: Column, assignments: Mapping[str, Column]) -> DataFrame:
    """Set columns where ``condition`` is true; every expression sees the old row."""
    return df.withColumns({name: F.when(condition, e).otherwise(F.col(name)) for name, e in assignments.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Drop rows where ``condition`` is true; an unknown condition keeps the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def append_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Bag union by name; columns missing on one side become NULL."""
    return df.unionByName(extra, allowMissingColumns=True)


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    """Default for an omitted column; explicit NULLs are kept."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def surrogate_id(df: DataFrame, order_by: Sequence[Column], name: str = "id") -> DataFrame:
    """Gap-free ids from 1 in a stated total order."""
    return global_rank(df, order_by, name)
