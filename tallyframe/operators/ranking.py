"""Ordered operators: change over periods, best per key, top and sampled rows per group.

``row_number() <= n`` lets Spark keep only n rows per group in each task before
the shuffle (window group limit), so a hot group does not reach one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_change(totals: DataFrame, period: str, value: str, name: str = "change_pct") -> DataFrame:
    """Percent change against the previous period of an aggregated series (one row per period)."""
    previous = F.lag(value).over(Window.orderBy(period))
    return totals.withColumn(name, F.try_divide(F.col(value) - previous, previous) * 100)


def top_per_group(df: DataFrame, by: Sequence[str], order_by: Sequence[Column], n: int, rank_as: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; end ``order_by`` with a unique key."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order_by)))
    kept = ranked.where(F.col("__rn") <= n)
    return kept.withColumnRenamed("__rn", rank_as) if rank_as else kept.drop("__rn")


def best_per_key(df: DataFrame, key: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    return top_per_group(df, key, order_by, 1)


def sample_per_group(df: DataFrame, by: Sequence[str], n: int, row_key: Sequence[str], seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per group in a seeded pseudo-random order (md5 of seed and key) that any engine repeats."""
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in row_key]))
    return top_per_group(df, by, [shuffled, *[F.col(c) for c in row_key]], n)


def in_label_order(df: DataFrame, label: str, order: Sequence[str], position_as: str = "position") -> DataFrame:
    """One row per label of ``order``, in that order; labels without data carry NULLs."""
    spark = df.sparkSession
    slots = spark.createDataFrame([(i, v) for i, v in enumerate(order, 1)], f"{position_as} int, `{label}` string")
    return slots.join(df, label, "left")
