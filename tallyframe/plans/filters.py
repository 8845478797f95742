"""Projection, filter, sort, limit and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import filters as ops
from tallyframe.plans.registry import Tables, plan


@plan("scan_columns", "IO1 PF1", """
SELECT p_partkey, p_name, p_size * p_retailprice AS size_value FROM part""")
def scan_columns(t: Tables):
    return t.part.select("p_partkey", "p_name", (F.col("p_size") * F.col("p_retailprice")).alias("size_value"))


@plan("compare_filter", "PF2 A8", """
SELECT DISTINCT p_brand FROM part WHERE p_type = 'PROMO' AND p_size >= 25 AND p_brand <> 'Brand#1'""")
def compare_filter(t: Tables):
    return (
        t.part.where((F.col("p_type") == "PROMO") & (F.col("p_size") >= 25) & (F.col("p_brand") != "Brand#1"))
        .select("p_brand")
        .distinct()
    )


@plan("bool_logic", "PF3 S1", """
SELECT p_partkey, p_type, p_size FROM part
WHERE (p_size = 6 AND (p_type = 'PROMO' OR p_type = 'SMALL')) OR NOT (p_size < 45)""")
def bool_logic(t: Tables):
    size, kind = F.col("p_size"), F.col("p_type")
    keep = ((size == 6) & ((kind == "PROMO") | (kind == "SMALL"))) | ~(size < 45)
    return t.part.where(keep).select("p_partkey", "p_type", "p_size").orderBy("p_size", "p_partkey")


@plan("in_list", "PF4 S1", """
SELECT p_partkey, p_type, p_retailprice FROM part WHERE p_type IN ('PROMO', 'LARGE') AND p_size NOT IN (6, 7, 3)""")
def in_list(t: Tables):
    kept = t.part.where(F.col("p_type").isin("PROMO", "LARGE") & ~F.col("p_size").isin(6, 7, 3))
    return kept.select("p_partkey", "p_type", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey")


@plan("filter_between", "PF5", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate BETWEEN DATE '1996-05-26' AND DATE '1996-06-30' AND o_custkey BETWEEN 1 AND 1000""")
def filter_between(t: Tables):
    window = F.col("o_orderdate").between(F.lit("1996-05-26").cast("timestamp_ntz"), F.lit("1996-06-30").cast("timestamp_ntz"))
    return t.orders.where(window & F.col("o_custkey").between(1, 1000)).select("o_orderkey", "o_custkey", "o_totalprice")


@plan("like_patterns", "PF6 ST8", """
SELECT p_partkey, p_name FROM part
WHERE p_name LIKE 'b%t' OR p_name LIKE '_r__n%' OR upper(p_name) LIKE '%WIDGET%' OR p_name ILIKE '%RING'""")
def like_patterns(t: Tables):
    name = F.col("p_name")
    keep = (
        text.matches_like(name, "b%t")
        | text.matches_like(name, "_r__n%")
        | F.upper(name).like("%WIDGET%")
        | text.matches_like(name, "%RING", ci=True)
    )
    return t.part.where(keep).select("p_partkey", "p_name")


@plan("regexp_non_vowels", "PF7", """
SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[^aeiouAEIOU]{3}')""")
def regexp_non_vowels(t: Tables):
    return t.part.where(F.col("p_name").rlike(text.THREE_NON_VOWELS)).select("p_partkey", "p_name")


@plan("regexp_tail", "PF7 ST9 A5", """
SELECT right(p_name, 1) AS ending, CAST(count(*) AS BIGINT) AS n_parts,
       CAST(count(CASE WHEN regexp_matches(p_name, '[eE]$') THEN 1 END) AS BIGINT) AS n_ending_e
FROM part WHERE regexp_matches(p_name, '[aeiouAEIOU]$') GROUP BY right(p_name, 1)""")
def regexp_tail(t: Tables):
    name = F.col("p_name")
    return (
        t.part.where(name.rlike(text.ENDS_WITH_VOWEL))
        .groupBy(F.right(name, F.lit(1)).alias("ending"))
        .agg(F.count("*").alias("n_parts"), F.count_if(name.rlike(text.ENDS_WITH_E)).alias("n_ending_e"))
    )


@plan("null_tests", "PF8 PF10 J3", """
SELECT c.c_custkey, coalesce(o.o_orderkey, -1) AS order_or_default FROM customer c
LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01') o
  ON c.c_custkey = o.o_custkey
WHERE o.o_orderkey IS NULL OR c.c_mktsegment IS NOT NULL""")
def null_tests(t: Tables):
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    joined = t.customer.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left")
    kept = joined.where(F.col("o_orderkey").isNull() | F.col("c_mktsegment").isNotNull())
    return kept.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("order_or_default"))


@plan("searched_case", "PF9", """
SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium'
       ELSE 'large' END AS size_label FROM orders""")
def searched_case(t: Tables):
    price = F.col("o_totalprice")
    label = F.when(price < 100000, "small").when(price < 300000, "medium").otherwise("large")
    return t.orders.select("o_orderkey", label.alias("size_label"))


@plan("sign_split", "PF11 U3", """
SELECT 'positive' AS side, CAST(count(*) AS BIGINT) AS n_rows, round(sum(c_acctbal), 2) AS total
FROM customer WHERE c_acctbal > 0
UNION ALL
SELECT 'negative', CAST(count(*) AS BIGINT), round(sum(c_acctbal), 2) FROM customer WHERE c_acctbal < 0""")
def sign_split(t: Tables):
    positive, negative = ops.split_by_sign(t.customer, "c_acctbal")
    sides = [
        part.agg(F.count("*").alias("n_rows"), F.round(F.sum("c_acctbal"), 2).alias("total")).select(
            F.lit(tag).alias("side"), "n_rows", "total"
        )
        for tag, part in (("positive", positive), ("negative", negative))
    ]
    return sides[0].unionByName(sides[1])


@plan("non_blank", "PF12 ST13", """
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs FROM documents
WHERE text IS NOT NULL AND trim(text) <> '' AND lower(trim(lang)) = lower('EN') GROUP BY lang""")
def non_blank(t: Tables):
    kept = t.documents.where(text.is_present(F.col("text")) & (F.lower(F.trim("lang")) == F.lower(F.lit("EN"))))
    return kept.groupBy("lang").agg(F.count("*").alias("n_docs"))


@plan("filter_fallback", "PF13", """
WITH flags AS (SELECT p_brand AS b, bool_or(p_size > 49) AS any_hit FROM part GROUP BY p_brand)
SELECT p_partkey, p_brand, p_size FROM part JOIN flags ON p_brand = b WHERE p_size > 49 OR NOT any_hit""")
def filter_fallback(t: Tables):
    return ops.filter_or_keep(t.part, F.col("p_size") > 49, by=["p_brand"]).select("p_partkey", "p_brand", "p_size")


@plan("drop_nulls", "PF14", """
SELECT c.c_custkey, t.total FROM customer c
LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders
           WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) t ON c.c_custkey = t.o_custkey
WHERE t.total IS NOT NULL""")
def drop_nulls(t: Tables):
    totals = (
        t.orders.where(F.col("o_orderpriority") == "1-URGENT")
        .groupBy("o_custkey")
        .agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    )
    joined = t.customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "total").dropna(subset=["total"])


@plan("head_tail", "PF15", """
(SELECT 'head' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL
(SELECT 'tail', o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5)""")
def head_tail(t: Tables):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    head = ops.first_rows(rows, ["o_orderkey"]).select(F.lit("head").alias("part"), "*")
    tail = ops.last_rows(rows, ["o_orderkey"]).select(F.lit("tail").alias("part"), "*")
    return head.unionByName(tail)


@plan("distinct_values", "A8", "SELECT DISTINCT p_type, p_size FROM part")
def distinct_values(t: Tables):
    return t.part.select("p_type", "p_size").distinct()


@plan("sort_by_abs", "S2", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey""")
def sort_by_abs(t: Tables):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey")


@plan("limit_rows", "S3", """
SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5""")
def limit_rows(t: Tables):
    return t.part.select("p_partkey", "p_name").orderBy("p_partkey").limit(5)


@plan("topk_multi", "S4 S1", """
SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_size DESC, p_partkey LIMIT 5""")
def topk_multi(t: Tables):
    return (
        t.part.select("p_partkey", "p_retailprice", "p_size")
        .orderBy(F.desc("p_retailprice"), F.desc("p_size"), "p_partkey")
        .limit(5)
    )


@plan("union_distinct", "U1", """
SELECT c_nationkey AS nation_key FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_distinct(t: Tables):
    return (
        t.customer.select(F.col("c_nationkey").alias("nation_key"))
        .union(t.supplier.select(F.col("s_nationkey")))
        .distinct()
    )


@plan("union_all", "U2", """
SELECT n_name AS holder, n_nationkey AS nation_key FROM nation
UNION ALL SELECT s_name, s_nationkey FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer""")
def union_all(t: Tables):
    parts = [
        t.nation.select(F.col("n_name").alias("holder"), F.col("n_nationkey").alias("nation_key")),
        t.supplier.select(F.col("s_name").alias("holder"), F.col("s_nationkey").alias("nation_key")),
        t.customer.select(F.col("c_name").alias("holder"), F.col("c_nationkey").alias("nation_key")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@plan("key_intersection", "U4", """
SELECT l_partkey AS part_key FROM lineitem WHERE l_returnflag = 'R'
INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'""")
def key_intersection(t: Tables):
    flagged = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("part_key")).distinct()
    return flagged("R").intersect(flagged("A"))
