"""Joins and subquery shapes composed from Spark joins and scalar subqueries.

Fact tables are grouped by the join key before they meet a dimension wherever
the result allows it, so a key with many rows arrives as one row. Sides are left
to Spark's size-checked broadcast decision; only one-row results are crossed in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialise


def full_union(left: DataFrame, right: DataFrame, on: Column, columns: Sequence[Column], distinct: bool = True) -> DataFrame:
    """Full outer join. ``distinct`` gives the LEFT UNION RIGHT form, which drops repeated rows."""
    joined = left.join(right, on, "full").select(*columns)
    return joined.distinct() if distinct else joined


def tagged_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct rows of two sources side by side, each padded with NULL for the other's columns."""
    return first.unionByName(second, allowMissingColumns=True).distinct()


def keys_with_count(df: DataFrame, key: str, minimum: int, count_as: str = "n_rows") -> DataFrame:
    """Keys with at least ``minimum`` rows."""
    return df.groupBy(key).agg(F.count("*").alias(count_as)).where(F.col(count_as) >= minimum)


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """NULL-aware NOT IN as an equi anti join.

    A NULL on the right leaves no rows; a NULL on the left is dropped unless the
    right side is empty. The distinct right keys are written once and serve both
    the NULL check and the join.
    """
    keys = materialise(other.select(F.col(other_key).alias("__other")).distinct())
    n, has_null = F.count("*"), F.count_if(F.col("__other").isNull()) > 0
    # 2: every row may stay, 1: rows with a key may stay, 0: none
    allowance = keys.agg(F.when(n == 0, 2).when(has_null, 0).otherwise(1)).scalar()
    allowed = df.where(allowance >= F.when(F.col(key).isNull(), 2).otherwise(1))
    return allowed.join(keys, F.col(key) == F.col("__other"), "left_anti")


def with_count(df: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """Each row with the number of matching rows on the other side, 0 when none."""
    counts = other.groupBy(F.col(other_key).alias("__key")).agg(F.count("*").alias("__n"))
    joined = df.join(counts, F.col(key) == F.col("__key"), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("__n", F.lit(0)).alias(name))


def above_overall_average(df: DataFrame, measure: str) -> DataFrame:
    average = df.agg(F.avg(measure)).scalar()
    return df.where(F.col(measure) > average)


def above_group_average(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Rows above their own group's average.

    Averages are combined map-side and written once, then joined back. Read from
    files they are either small enough to broadcast by their known size, or the
    join shuffles both sides plainly and adaptive execution can split a hot key;
    a window partition would gather that key in one task.
    """
    averages = materialise(df.groupBy(F.col(key).alias("__key")).agg(F.avg(measure).alias("__avg")))
    joined = df.join(averages, (F.col(key) == F.col("__key")) & (F.col(measure) > F.col("__avg")))
    return joined.drop("__key", "__avg")


def group_totals_above_average(df: DataFrame, key: str, measure: str, name: str) -> DataFrame:
    """Group totals larger than the average group total; the facts are read once."""
    totals = materialise(df.groupBy(key).agg(F.sum(measure).alias(name)))
    return totals.where(F.col(name) > totals.agg(F.avg(name)).scalar())


def with_share(totals: DataFrame, measure: str, name: str = "share_pct") -> DataFrame:
    """Totals with their percentage of the whole.

    The totals are written once, so what lies below them is not computed again
    for the overall sum.
    """
    kept = materialise(totals)
    whole = kept.agg(F.sum(measure)).scalar()
    return kept.withColumn(name, F.try_divide(F.col(measure), whole) * 100)


def date_spine(df: DataFrame, timestamp: str, days: int, count_as: str = "n_rows", day_as: str = "day") -> DataFrame:
    """Row count for each of the last ``days`` days up to the latest, zero for empty days.

    Facts are read once into one row per day, which also holds the latest day.
    """
    counts = materialise(df.groupBy(F.to_date(timestamp).alias("__day")).agg(F.count("*").alias("__n")))
    latest = counts.agg(F.max("__day").alias("latest"))
    spine = latest.select(F.explode(F.sequence(F.date_sub("latest", days - 1), F.col("latest"))).alias(day_as))
    joined = spine.join(counts, F.col(day_as) == F.col("__day"), "left")
    return joined.select(day_as, F.coalesce("__n", F.lit(0)).alias(count_as))


def same_period_keys(df: DataFrame, key: str, timestamp: str, value, with_year: bool = True) -> DataFrame:
    """Distinct keys with a row in any month in which ``value`` has one.

    ``with_year`` matches year and month; otherwise the month number alone.
    """
    period = F.date_format(timestamp, "yyyy-MM") if with_year else F.month(timestamp)
    periods = df.select(F.col(key), period.alias("__period")).distinct()
    reference = periods.where(F.col(key) == F.lit(value)).select("__period")
    return periods.join(reference, "__period", "left_semi").select(key).distinct()


def aligned(series: Sequence[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Per-key series side by side; ``inner`` keeps keys present in all, ``full`` pads with NULL."""
    result = series[0]
    for other in series[1:]:
        result = result.join(other, key, how)
    return result.dropna() if how == "inner" else result
