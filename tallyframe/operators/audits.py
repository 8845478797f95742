"""Constraint audits: each returns the rows or keys that break a rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NOT NULL: rows with a NULL in any of ``columns``."""
    return df.where(~_all_present(columns))


def duplicate_keys(df: DataFrame, key: Sequence[str], count_as: str = "copies") -> DataFrame:
    """UNIQUE: keys that occur more than once. Keys containing NULL are allowed."""
    grouped = df.where(_all_present(key)).groupBy(*key).agg(F.count("*").alias(count_as))
    return grouped.where(F.col(count_as) > 1)


def primary_key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """PRIMARY KEY: NULL keys and repeated keys with the rule they break."""
    # one aggregation serves both rules
    grouped = df.groupBy(*key).agg(F.count("*").alias("copies"))
    broken = F.when(~_all_present(key), "null key").when(F.col("copies") > 1, "duplicate key")
    return grouped.withColumn("rule", broken).where(F.col("rule").isNotNull())


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """FOREIGN KEY: child rows whose non-NULL key has no parent."""
    known = parent.select(F.col(parent_key).alias("__parent"))
    return child.where(F.col(child_key).isNotNull()).join(
        known, F.col(child_key) == F.col("__parent"), "left_anti"
    )


def check_violations(df: DataFrame, rule: Column) -> DataFrame:
    """CHECK: rows where the rule is false; unknown passes."""
    return df.where(~rule)


def restrict_deletes(requested: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """ON DELETE RESTRICT: requested parent keys with ``blocked`` true while a child refers to them."""
    used = child.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias("__used")).distinct()
    marked = requested.select(key).join(used, F.col(key) == F.col("__used"), "left")
    return marked.select(key, F.col("__used").isNotNull().alias("blocked"))


def cascade_keys(df: DataFrame, key: str, mapping: DataFrame, old: str = "old_key", new: str = "new_key") -> DataFrame:
    """ON UPDATE CASCADE: rewrite ``key`` through an old-to-new mapping with unique old keys."""
    renames = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    joined = df.join(renames, F.col(key) == F.col("__old"), "left")
    return joined.withColumn(key, F.coalesce("__new", key)).select(*df.columns)
