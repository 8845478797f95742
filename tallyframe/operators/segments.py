"""Recency, frequency and monetary segmentation of buyers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import bin_right_closed
from tallyframe.operators.quantiles import global_rank, quartile_edges, quartile_of_rank, score_by_edges
from tallyframe.session import materialise

# Segment edges on the mean score and their names, and the report order.
SEGMENT_EDGES = (0, 1.5, 2.5, 3.5, 4.1)
SEGMENT_NAMES = ("At Risk", "Needs Attention", "Loyal", "Champions")
SEGMENT_ORDER = ("Champions", "Loyal", "Needs Attention", "At Risk")


def rfm_table(lines: DataFrame, buyer: str, date: str, n_sales: str, revenue: str) -> DataFrame:
    """Recency, number of sale lines and revenue per buyer with at least one sale.

    ``n_sales`` and ``revenue`` hold 1 (0 for a return) and the paid amount of a
    line, or their sums when lines are already summed, e.g. per order. Recency is
    in days to the day after the latest date over sales and returns. The buyers
    are written once; the latest date is then read from them.
    """
    is_sale = F.col(n_sales) > 0
    buyers = materialise(
        lines.groupBy(F.col(buyer).alias("buyer")).agg(
            F.to_date(F.max(date)).alias("last_any"),
            F.to_date(F.max(F.when(is_sale, F.col(date)))).alias("last_sale"),
            F.sum(n_sales).alias("frequency"),
            F.sum(F.when(is_sale, F.col(revenue))).alias("monetary"),
        )
    )
    latest = buyers.agg(F.max("last_any")).scalar()
    return buyers.where(F.col("frequency") > 0).select(
        "buyer", (F.datediff(latest, F.col("last_sale")) + 1).alias("recency"), "frequency", "monetary"
    )


def rfm_scores(rfm: DataFrame, **options) -> DataFrame:
    """Quartile scores, their mean and the segment.

    Recency and monetary are cut at value quartiles (recent is best); frequency
    is cut on its rank with ties in buyer order.
    """
    ranked = global_rank(rfm, [F.col("frequency"), F.col("buyer")], "frequency_rank")
    n = ranked.count()
    if n < 2:
        raise ValueError("at least two buyers are needed for quartiles")
    edges = quartile_edges(ranked, ["recency", "monetary"], **{"rows": n, **options})
    scored = ranked.withColumns(
        {
            "r_score": score_by_edges(F.col("recency"), edges["recency"], descending=True),
            "f_score": quartile_of_rank(F.col("frequency_rank"), F.lit(n)),
            "m_score": score_by_edges(F.col("monetary"), edges["monetary"]),
        }
    )
    mean = (F.col("r_score") + F.col("f_score") + F.col("m_score")) / 3
    return scored.withColumn("mean_score", mean).withColumn(
        "segment", bin_right_closed(F.col("mean_score"), SEGMENT_EDGES, SEGMENT_NAMES)
    )


def segment_summary(scores: DataFrame) -> DataFrame:
    """Buyers, mean recency, frequency and monetary, and revenue contribution per segment."""
    return scores.groupBy("segment").agg(
        F.count("*").alias("n_buyers"),
        F.avg("recency").alias("mean_recency"),
        F.avg("frequency").alias("mean_frequency"),
        F.avg("monetary").alias("mean_monetary"),
        (F.count("*") * F.avg("monetary")).alias("revenue"),
    )
