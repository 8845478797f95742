"""Sales and returns analytics.

``order_totals`` sums one scan into additive measures per key. Totals of a fine
key (such as an item id) can be joined to a dimension and re-summed with
``combine_totals``, so order lines are never shuffled by a coarse, hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.dates import WEEKDAYS
from tallyframe.operators.joins import with_share
from tallyframe.operators.ranking import in_label_order


@dataclass(frozen=True)
class OrderColumns:
    """Column names of an order-line frame. A positive quantity is a sale, a negative one a return."""

    quantity: str = "quantity"
    revenue: str = "revenue"
    refunds: str = "refunds"
    units_sold: str = "units_sold"
    units_returned: str = "units_returned"


MEASURES = ("n_sales", "n_returns", "gross", "refunds", "units", "returned_units")


def order_totals(lines: DataFrame, by: Sequence = (), columns: OrderColumns = OrderColumns()) -> DataFrame:
    """Additive measures per key from one conditional aggregation.

    A side without rows is NULL, as it would be absent from that side's series.
    Refunds and returned units are reported as positive amounts.
    """
    c = columns
    sale, back = F.col(c.quantity) > 0, F.col(c.quantity) < 0
    return lines.groupBy(*by).agg(
        F.count_if(sale).alias("n_sales"),
        F.count_if(back).alias("n_returns"),
        F.sum(F.when(sale, F.col(c.revenue))).alias("gross"),
        F.abs(F.sum(F.when(back, F.col(c.refunds)))).alias("refunds"),
        F.sum(F.when(sale, F.col(c.units_sold))).alias("units"),
        F.abs(F.sum(F.when(back, F.col(c.units_returned)))).alias("returned_units"),
    )


def combine_totals(totals: DataFrame, by: Sequence = ()) -> DataFrame:
    """Re-sum totals to a coarser key."""
    return totals.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MEASURES])


def financial_summary(totals: DataFrame) -> DataFrame:
    """Gross, refunds, net and returns per 100 sales over all keys."""
    whole = combine_totals(totals)
    return whole.select(
        "n_sales",
        "n_returns",
        "gross",
        "refunds",
        (F.coalesce("gross", F.lit(0.0)) - F.coalesce("refunds", F.lit(0.0))).alias("net"),
        (F.try_divide(F.col("n_returns").cast("double"), F.col("n_sales")) * 100).alias("return_ratio_pct"),
    )


def period_net(totals: DataFrame, period: str) -> DataFrame:
    """Gross, refunds and both nets per period; a net is NULL when one side has no rows."""
    return totals.select(
        period,
        "gross",
        "refunds",
        (F.col("gross") - F.col("refunds")).alias("net"),
        "units",
        "returned_units",
        (F.col("units") - F.col("returned_units")).alias("net_units"),
    )


def weekday_totals(totals: DataFrame, weekday: str) -> DataFrame:
    """Revenue and units from Monday to Sunday with the peak and slowest day marked."""
    week = in_label_order(totals.select(weekday, "gross", "units"), weekday, WEEKDAYS)
    all_days = Window.partitionBy(F.lit(0))  # seven rows
    is_top = F.col("gross") == F.max("gross").over(all_days)
    is_bottom = F.col("gross") == F.min("gross").over(all_days)
    return week.withColumn("mark", F.when(is_top, "peak").when(is_bottom, "slowest"))


def top_totals(totals: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """The ``n`` keys with the largest measure, with its share of the whole in percent."""
    shares = with_share(totals.where(F.col(measure).isNotNull()).select(key, measure), measure)
    return shares.orderBy(F.desc(measure), key).limit(n)


def return_rates(totals: DataFrame) -> DataFrame:
    """Totals with ``return_rate`` in percent, for keys that have both sales and returns."""
    both = (F.col("n_sales") > 0) & (F.col("n_returns") > 0)
    rated = totals.where(both).withColumn("return_rate", F.try_divide("returned_units", "units") * 100)
    return rated.where(F.col("return_rate").isNotNull())


def rate_summary(rates: DataFrame, key: str) -> DataFrame:
    """Mean rate and the keys with the highest and lowest one (ties: smallest key)."""
    return rates.agg(
        F.avg("return_rate").alias("mean_rate"),
        F.min_by(key, F.struct(-F.col("return_rate"), F.col(key))).alias("highest_key"),
        F.max("return_rate").alias("highest_rate"),
        F.min_by(key, F.struct(F.col("return_rate"), F.col(key))).alias("lowest_key"),
        F.min("return_rate").alias("lowest_rate"),
    )


def rate_correlations(rates: DataFrame) -> DataFrame:
    """Correlation of units sold and of revenue with the return rate over keys."""
    return rates.agg(
        F.corr("units", "return_rate").alias("units_vs_rate"), F.corr("gross", "return_rate").alias("revenue_vs_rate")
    )
