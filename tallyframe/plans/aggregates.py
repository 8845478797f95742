"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import numbers, text
from tallyframe.operators import audits, joins
from tallyframe.plans.registry import Tables, plan


def _n(name: str):
    return F.count("*").alias(name)


@plan("top_categories", "J2 A5 A11 S4 IO11 J21", """
SELECT p.p_type AS category, CAST(count(*) AS BIGINT) AS n_lines
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY p.p_type ORDER BY n_lines DESC, category LIMIT 5""")
def top_categories(t: Tables):
    # the fact table is shuffled once, by order; after that only one count per task and part moves
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    known = lines.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    per_part = known.groupBy("l_partkey").agg(_n("n"))
    typed = per_part.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return (
        typed.groupBy(F.col("p_type").alias("category"))
        .agg(F.sum("n").alias("n_lines"))
        .orderBy(F.desc("n_lines"), "category")
        .limit(5)
    )


@plan("count_forms", "A1 A2 A3", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(p_name) AS BIGINT) AS n_names,
       CAST(count(DISTINCT p_name) AS BIGINT) AS n_distinct_names, round(sum(p_retailprice), 2) AS total_price,
       round(avg(p_size), 4) AS avg_size, max(p_retailprice) AS max_price, min(p_retailprice) AS min_price
FROM part""")
def count_forms(t: Tables):
    return t.part.agg(
        _n("n_rows"),
        F.count("p_name").alias("n_names"),
        F.countDistinct("p_name").alias("n_distinct_names"),
        F.round(F.sum("p_retailprice"), 2).alias("total_price"),
        F.round(F.avg("p_size"), 4).alias("avg_size"),
        F.max("p_retailprice").alias("max_price"),
        F.min("p_retailprice").alias("min_price"),
    )


@plan("payment_ratio", "A4 A3", """
SELECT o_custkey, CAST(count(o_orderkey) AS BIGINT) AS payments, round(sum(o_totalprice), 2) AS total_paid,
       round(sum(o_totalprice) / count(o_orderkey), 6) AS avg_payment FROM orders GROUP BY o_custkey""")
def payment_ratio(t: Tables):
    paid, n = F.sum("o_totalprice"), F.count("o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        n.alias("payments"), F.round(paid, 2).alias("total_paid"), F.round(numbers.ratio(paid, n), 6).alias("avg_payment")
    )


@plan("group_by_expression", "A5 ST9", """
SELECT left(p_name, 1) AS first_letter, right(p_name, 1) AS last_letter, CAST(count(*) AS BIGINT) AS n_parts
FROM part GROUP BY left(p_name, 1), right(p_name, 1)""")
def group_by_expression(t: Tables):
    name = F.col("p_name")
    return t.part.groupBy(
        F.left(name, F.lit(1)).alias("first_letter"), F.right(name, F.lit(1)).alias("last_letter")
    ).agg(_n("n_parts"))


@plan("having_sum", "A6 PF5", """
SELECT o_custkey, round(sum(o_totalprice), 2) AS total_amount FROM orders
GROUP BY o_custkey HAVING sum(o_totalprice) > 2500000 AND o_custkey BETWEEN 1 AND 1000""")
def having_sum(t: Tables):
    # the key condition is written before the aggregation, where it is pushed to the scan
    totals = t.orders.where(F.col("o_custkey").between(1, 1000)).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return totals.where(F.col("s") > 2500000).select("o_custkey", F.round("s", 2).alias("total_amount"))


@plan("having_count", "A6 S1", """
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) <= 8""")
def having_count(t: Tables):
    counts = t.orders.groupBy("o_custkey").agg(_n("n_orders"))
    return counts.where(F.col("n_orders") <= 8).orderBy(F.desc("n_orders"), "o_custkey")


@plan("having_avg", "A6 A3", """
SELECT p_brand, round(avg(p_size), 4) AS avg_size FROM part GROUP BY p_brand HAVING avg(p_size) > 25""")
def having_avg(t: Tables):
    sizes = t.part.groupBy("p_brand").agg(F.avg("p_size").alias("a"))
    return sizes.where(F.col("a") > 25).select("p_brand", F.round("a", 4).alias("avg_size"))


@plan("daily_totals", "D6 A6", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, round(sum(o_totalprice), 2) AS total_amount FROM orders
GROUP BY CAST(o_orderdate AS DATE) HAVING count(*) > 10""")
def daily_totals(t: Tables):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        _n("n"), F.round(F.sum("o_totalprice"), 2).alias("total_amount")
    )
    return daily.where(F.col("n") > 10).select(F.col("day").cast("string"), "total_amount").orderBy(F.desc("day"))


@plan("timestamp_totals", "A5 D6", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 2) AS total_value FROM events GROUP BY ts, CAST(ts AS DATE)""")
def timestamp_totals(t: Tables):
    totals = t.events.groupBy("ts", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("total_value"))
    moment = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return totals.select(moment.alias("ts"), F.col("day").cast("string"), "total_value")


@plan("count_with_details", "A7 J1", """
SELECT c.*, r.n_orders FROM customer c
JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) >= 12) r
  ON c.c_custkey = r.o_custkey""")
def count_with_details(t: Tables):
    counts = joins.keys_with_count(t.orders, "o_custkey", 12, "n_orders")
    return t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


@plan("duplicates", "A9", """
SELECT p_name, p_brand, p_type, CAST(count(*) AS BIGINT) AS copies FROM part
GROUP BY p_name, p_brand, p_type HAVING count(*) > 1""")
def duplicates(t: Tables):
    return audits.duplicate_keys(t.part, ["p_name", "p_brand", "p_type"])


@plan("left_count_zero", "A10 J3 PF10", """
SELECT c.c_custkey, c.c_name, CAST(count(o.o_orderkey) AS BIGINT) AS n_urgent FROM customer c
LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey, c.c_name""")
def left_count_zero(t: Tables):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    return joins.with_count(t.customer.select("c_custkey", "c_name"), "c_custkey", urgent, "o_custkey", "n_urgent")


@plan("repeat_pairs", "A12", """
SELECT o.o_custkey, l.l_partkey, CAST(count(*) AS BIGINT) AS times FROM orders o
JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, l.l_partkey HAVING count(*) >= 2""")
def repeat_pairs(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    bought = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = bought.groupBy("o_custkey", "l_partkey").agg(_n("times"))
    return pairs.where(F.col("times") >= 2)


@plan("open_items", "A13 PF8", """
SELECT s.s_nationkey, CAST(count(*) AS BIGINT) AS n_open FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
WHERE l.l_linestatus = 'O' GROUP BY s.s_nationkey""")
def open_items(t: Tables):
    per_supplier = t.lineitem.where(F.col("l_linestatus") == "O").groupBy("l_suppkey").agg(_n("n"))
    placed = per_supplier.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return placed.groupBy("s_nationkey").agg(F.sum("n").alias("n_open"))


@plan("char_counts", "A14 ST5 ST10", """
SELECT CAST(sum(length(text) - length(replace(lower(text), 'a', ''))) AS BIGINT) AS count_of_a,
       CAST(sum(length(text) - length(replace(lower(text), 'e', ''))) AS BIGINT) AS count_of_e,
       CAST(sum(length(text) - length(replace(lower(text), 'i', ''))) AS BIGINT) AS count_of_i,
       CAST(sum(length(text) - length(replace(lower(text), 'o', ''))) AS BIGINT) AS count_of_o,
       CAST(sum(length(text) - length(replace(lower(text), 'u', ''))) AS BIGINT) AS count_of_u
FROM documents""")
def char_counts(t: Tables):
    return t.documents.agg(
        *[F.sum(text.char_occurrences(F.col("text"), v)).cast("bigint").alias(f"count_of_{v}") for v in "aeiou"]
    )


@plan("group_stats", "A16 A17", """
SELECT event_type, round(avg(value), 3) AS mean_value, round(median(value), 3) AS median_value,
       round(stddev_samp(value), 3) AS std_value FROM events GROUP BY event_type""")
def group_stats(t: Tables):
    from tallyframe.operators.cluster import group_profile

    return (
        group_profile(t.events, "event_type", ["value"])
        .select("event_type", F.col("mean").alias("mean_value"), F.col("median").alias("median_value"), F.col("std").alias("std_value"))
        .orderBy(F.desc("mean_value"), "event_type")
    )


@plan("value_counts", "A18 AN8", """
SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY ALL""")
def value_counts(t: Tables):
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(_n("n_orders"))
    return counts.orderBy(F.desc("n_orders"), "o_orderpriority", "o_orderstatus")


@plan("key_of_extremes", "A19", """
WITH b AS (SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY p_brand)
SELECT (SELECT p_brand FROM b ORDER BY total DESC, p_brand LIMIT 1) AS top_brand, max(total) AS top_total,
       (SELECT p_brand FROM b ORDER BY total, p_brand LIMIT 1) AS bottom_brand, min(total) AS bottom_total FROM b""")
def key_of_extremes(t: Tables):
    totals = t.part.groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("total"))
    return totals.agg(
        F.min_by("p_brand", F.struct(-F.col("total"), "p_brand")).alias("top_brand"),
        F.max("total").alias("top_total"),
        F.min_by("p_brand", F.struct("total", "p_brand")).alias("bottom_brand"),
        F.min("total").alias("bottom_total"),
    )


@plan("share_of_total", "A20", """
SELECT p_type, round(sum(p_retailprice), 2) AS revenue,
       round(100 * sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 4) AS share_pct FROM part GROUP BY p_type""")
def share_of_total(t: Tables):
    totals = joins.with_share(t.part.groupBy("p_type").agg(F.sum("p_retailprice").alias("s")), "s")
    return totals.select("p_type", F.round("s", 2).alias("revenue"), F.round("share_pct", 4).alias("share_pct"))


@plan("crosstab_long", "A21 A22", """
SELECT lang, quality, CAST(count(*) AS BIGINT) AS n_docs,
       round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS row_share
FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality""")
def crosstab_long(t: Tables):
    from tallyframe.operators.association import row_shares

    labelled = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return row_shares(labelled, "lang", "quality", count_as="n_docs").withColumn("row_share", F.round("row_share", 6))


@plan("column_fold", "A23", "SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def column_fold(t: Tables):
    return t.orders.agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
