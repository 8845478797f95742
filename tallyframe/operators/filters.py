"""Filters that need more than one expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialise


def split_by_sign(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(positive rows, negative rows); zero and NULL are in neither."""
    return df.where(F.col(column) > 0), df.where(F.col(column) < 0)


def first_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.asc(c) for c in order_by]).limit(n)


def last_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order_by]).limit(n)


def filter_or_keep(df: DataFrame, condition: Column, by: Sequence[str] = ()) -> DataFrame:
    """Apply ``condition`` where it matches something in the group, else keep the group.

    Whether a group has a match is one aggregated flag per group. The flags are
    written once, so that the join back can broadcast them by known size or split
    a hot group.
    """
    hit = F.coalesce(condition, F.lit(False))
    if not by:
        any_hit = df.agg(F.coalesce(F.bool_or(hit), F.lit(False))).scalar()
        return df.where(hit | ~any_hit)
    names = [f"__by_{i}" for i in range(len(by))]
    flags = materialise(
        df.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names)]).agg(F.bool_or(hit).alias("__any"))
    )
    same = [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names)]
    return df.join(flags, same).where(hit | ~F.col("__any")).drop(*names, "__any")
