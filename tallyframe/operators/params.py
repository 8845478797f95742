"""Parameterised queries."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_for(df: DataFrame, key: str, value, columns: Collection[str]) -> DataFrame:
    """Rows of one key."""
    return df.where(F.col(key) == F.lit(value)).select(*columns)


def total_for(df: DataFrame, key: str, value, measure: str, name: str = "total", sql_type: str = "decimal(10,2)") -> DataFrame:
    """One row holding the sum for one key, NULL when the key has no rows."""
    return df.where(F.col(key) == F.lit(value)).agg(F.sum(measure).cast(sql_type).alias(name))


def count_rows_of(spark: SparkSession, table: str, allowed: Collection[str] | None = None) -> DataFrame:
    """Row count of a table named at run time; only names from the catalog (or ``allowed``) are accepted."""
    known = set(allowed) if allowed is not None else {t.name for t in spark.catalog.listTables()}
    if table not in known:
        raise ValueError(f"unknown table {table!r}")
    return spark.sql("SELECT count(*) AS total_rows FROM IDENTIFIER(:name)", args={"name": table})
