"""Join, subquery, common-table and recursive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import joins as ops
from tallyframe.plans.registry import Tables, plan


def _links(t: Tables):
    """Distinct supplier-part links."""
    return t.lineitem.select("l_suppkey", "l_partkey").distinct()


@plan("inner_join", "J1", """
SELECT n.n_name, r.r_name, c.c_custkey FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def inner_join(t: Tables):
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_name", "r_name", "c_custkey")
    )


@plan("join_chain", "J2 A6", """
SELECT c.c_custkey, c.c_name, CAST(count(p.p_type) AS BIGINT) AS n_promo FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey
JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_type = 'PROMO'
GROUP BY c.c_custkey, c.c_name HAVING count(p.p_type) >= 1""")
def join_chain(t: Tables):
    promo = t.part.where(F.col("p_type") == "PROMO").select("p_partkey")
    lines = t.lineitem.join(promo, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    bought = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = bought.groupBy("o_custkey").agg(F.sum("n").alias("n_promo"))
    return counts.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "n_promo")


@plan("customer_items", "J2", """
SELECT c.c_custkey, c.c_name, p.p_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey""")
def customer_items(t: Tables):
    return (
        t.lineitem.select("l_orderkey", "l_partkey")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .select("c_custkey", "c_name", "p_name")
    )


@plan("city_payments", "J2 J21", """
SELECT n.n_name, o.* EXCLUDE (o_orderdate), CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey
JOIN orders o ON o.o_custkey = c.c_custkey WHERE n.n_name = 'NATION_7'""")
def city_payments(t: Tables):
    home = t.nation.where(F.col("n_name") == "NATION_7").select("n_nationkey", "n_name")
    people = t.customer.select("c_custkey", "c_nationkey").join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        "n_name", *[c for c in t.orders.columns if c != "o_orderdate"], F.to_date("o_orderdate").cast("string").alias("day")
    )


@plan("left_chain", "J3 IO12", """
SELECT p.p_partkey, p.p_name, s.s_name FROM part p
LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') f ON p.p_partkey = f.l_partkey
LEFT JOIN supplier s ON f.l_suppkey = s.s_suppkey""")
def left_chain(t: Tables):
    links = t.lineitem.where(F.col("l_returnflag") == "R").select("l_partkey", "l_suppkey").distinct()
    return (
        t.part.select("p_partkey", "p_name")
        .join(links, F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .select("p_partkey", "p_name", "s_name")
    )


@plan("right_join", "J4", """
SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o
RIGHT JOIN customer c ON o.o_custkey = c.c_custkey""")
def right_join(t: Tables):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")
    return urgent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


FULL_SIDES = """
WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000),
     c AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0)
"""


def _full_sides(t: Tables):
    rich = t.supplier.where(F.col("s_acctbal") > 5000).select("s_suppkey", "s_nationkey")
    owing = t.customer.where(F.col("c_acctbal") < 0).select("c_custkey", "c_nationkey", "c_mktsegment")
    return rich, owing


@plan("full_by_union", "J5 U1", FULL_SIDES + """
SELECT s.s_suppkey, c.c_mktsegment FROM s LEFT JOIN c ON s.s_nationkey = c.c_nationkey
UNION SELECT s.s_suppkey, c.c_mktsegment FROM s RIGHT JOIN c ON s.s_nationkey = c.c_nationkey""")
def full_by_union(t: Tables):
    rich, owing = _full_sides(t)
    # repeated (nation, segment) rows are dropped before the join: the result is a set
    owing = owing.select("c_nationkey", "c_mktsegment").distinct()
    return ops.full_union(
        rich, owing, F.col("s_nationkey") == F.col("c_nationkey"), [F.col("s_suppkey"), F.col("c_mktsegment")]
    )


@plan("full_outer_bag", "J5", """
WITH a AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
     b AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS low FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey, urgent, low FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def full_outer_bag(t: Tables):
    side = lambda priority, name: (
        t.orders.where(F.col("o_orderpriority") == priority)
        .groupBy(F.col("o_custkey").alias(f"key_{name}"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias(name))
    )
    urgent, low = side("1-URGENT", "urgent"), side("5-LOW", "low")
    columns = [F.coalesce("key_urgent", "key_low").alias("custkey"), F.col("urgent"), F.col("low")]
    return ops.full_union(urgent, low, F.col("key_urgent") == F.col("key_low"), columns, distinct=False)


@plan("tagged_union", "J6 U1", """
SELECT c_name AS customer_name, NULL AS supplier_name FROM customer
UNION SELECT NULL, s_name FROM supplier""")
def tagged_union(t: Tables):
    return ops.tagged_union(
        t.customer.select(F.col("c_name").alias("customer_name")), t.supplier.select(F.col("s_name").alias("supplier_name"))
    )


@plan("self_join_same", "J7", """
SELECT a.s_suppkey AS first_key, b.s_suppkey AS second_key, a.s_nationkey FROM supplier a
JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey = b.s_suppkey""")
def self_join_same(t: Tables):
    # both equalities are join keys, so only a row and itself meet
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    same = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") == F.col("b.s_suppkey"))
    return a.join(b, same).select(
        F.col("a.s_suppkey").alias("first_key"), F.col("b.s_suppkey").alias("second_key"), F.col("a.s_nationkey")
    )


@plan("cross_one_row", "J8 J14", """
WITH a AS (SELECT avg(p_size) AS avg_size FROM part)
SELECT p.p_partkey, p.p_size, round(a.avg_size, 4) AS avg_size FROM part p CROSS JOIN a WHERE p.p_size > a.avg_size""")
def cross_one_row(t: Tables):
    average = t.part.agg(F.avg("p_size").alias("a"))  # one row by construction
    joined = t.part.select("p_partkey", "p_size").crossJoin(F.broadcast(average))
    return joined.where(F.col("p_size") > F.col("a")).select("p_partkey", "p_size", F.round("a", 4).alias("avg_size"))


@plan("theta_one_row", "J9", """
SELECT p_partkey, p_name, p_retailprice FROM part
JOIN (SELECT avg(p_retailprice) AS a FROM part) x ON p_retailprice > x.a""")
def theta_one_row(t: Tables):
    average = t.part.agg(F.avg("p_retailprice").alias("a"))  # one row by construction
    return t.part.join(F.broadcast(average), F.col("p_retailprice") > F.col("a")).select("p_partkey", "p_name", "p_retailprice")


@plan("semi_in", "J10", """
SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)""")
def semi_in(t: Tables):
    busy = ops.keys_with_count(t.orders, "o_custkey", 13)
    return t.customer.join(busy, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@plan("suppliers_many_parts", "J10 J19 A7", """
SELECT s.s_suppkey, s.s_name, f.n_parts FROM supplier s
JOIN (SELECT l_suppkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_parts FROM lineitem GROUP BY l_suppkey
      HAVING count(DISTINCT l_partkey) > 10) f ON s.s_suppkey = f.l_suppkey""")
def suppliers_many_parts(t: Tables):
    counts = ops.keys_with_count(_links(t), "l_suppkey", 11, "n_parts")
    return t.supplier.join(counts, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name", "n_parts")


@plan("nested_in_scalar", "J11 J14 IO11", """
SELECT * FROM supplier WHERE s_suppkey IN
 (SELECT l_suppkey FROM lineitem WHERE l_extendedprice * l_tax > (SELECT 2.4 * avg(l_extendedprice * l_tax) FROM lineitem))""")
def nested_in_scalar(t: Tables):
    tax_paid = F.col("l_extendedprice") * F.col("l_tax")
    bar = t.lineitem.agg(2.4 * F.avg(tax_paid)).scalar()
    above = t.lineitem.where(tax_paid > bar).select("l_suppkey").distinct()
    return t.supplier.join(above, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")


@plan("anti_not_in", "J12", """
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def anti_not_in(t: Tables):
    return ops.not_in(t.customer, "c_custkey", t.orders.where(F.col("o_orderpriority") == "1-URGENT"), "o_custkey")


@plan("never_stocked", "J12", """
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN
 (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))""")
def never_stocked(t: Tables):
    bulk = t.lineitem.where(F.col("l_quantity") > 49).select("l_orderkey").distinct()
    stocked = t.lineitem.join(bulk, "l_orderkey", "left_semi").select("l_partkey").distinct()
    return ops.not_in(t.part, "p_partkey", stocked, "l_partkey").select("p_partkey", "p_name")


@plan("anti_left_null", "J13", """
SELECT p.p_partkey, p.p_name FROM part p
LEFT JOIN (SELECT l.l_partkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
           WHERE o.o_orderdate >= TIMESTAMP '2001-01-01' AND o.o_orderpriority = '1-URGENT') r
  ON p.p_partkey = r.l_partkey WHERE r.l_partkey IS NULL""")
def anti_left_null(t: Tables):
    late = t.orders.where(
        (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")) & (F.col("o_orderpriority") == "1-URGENT")
    )
    ordered = t.lineitem.select("l_orderkey", "l_partkey").join(
        late.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"
    )
    keys = ordered.select("l_partkey").distinct()
    return t.part.join(keys, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@plan("scalar_gt_avg", "J14", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)""")
def scalar_gt_avg(t: Tables):
    return ops.above_overall_average(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice")


@plan("same_as_row_one", "J15", """
SELECT * FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 1)""")
def same_as_row_one(t: Tables):
    reference = t.customer.where(F.col("c_custkey") == 1).select("c_nationkey").scalar()
    return t.customer.where(F.col("c_nationkey") == reference)


@plan("correlated_count", "J16", """
SELECT s.s_suppkey, s.s_name, CAST((SELECT count(*) FROM lineitem l WHERE l.l_suppkey = s.s_suppkey
       AND l.l_discount = 0 AND l.l_quantity > 49) AS BIGINT) AS n_lines FROM supplier s""")
def correlated_count(t: Tables):
    lines = t.lineitem.where((F.col("l_discount") == 0) & (F.col("l_quantity") > 49))
    return ops.with_count(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", lines, "l_suppkey", "n_lines")


@plan("own_group_avg", "J17", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders a
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)""")
def own_group_avg(t: Tables):
    return ops.above_group_average(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice")


@plan("scalar_single_row", "J18 J15", """
SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = 3) AS fixed_nation FROM customer""")
def scalar_single_row(t: Tables):
    one = t.nation.where(F.col("n_nationkey") == 3).select("n_name")
    return t.customer.select("c_custkey", one.scalar().alias("fixed_nation"))


@plan("derived_top", "J19 S4", """
SELECT c.c_name, t.total_spent FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total_spent FROM orders
 GROUP BY o_custkey ORDER BY total_spent DESC, o_custkey LIMIT 5) t JOIN customer c ON c.c_custkey = t.o_custkey""")
def derived_top(t: Tables):
    totals = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total_spent"))
    top = totals.orderBy(F.desc("total_spent"), "o_custkey").limit(5)
    return t.customer.join(F.broadcast(top), F.col("c_custkey") == F.col("o_custkey")).select("c_name", "total_spent")


@plan("agg_of_agg", "J20 J21", """
WITH s AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders GROUP BY o_custkey)
SELECT o_custkey, c.c_name, round(x, 2) AS total_spent FROM s JOIN customer c ON c.c_custkey = s.o_custkey
WHERE x > (SELECT avg(x) FROM s)""")
def agg_of_agg(t: Tables):
    totals = ops.group_totals_above_average(t.orders, "o_custkey", "o_totalprice", "x")
    named = totals.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return named.select("o_custkey", "c_name", F.round("x", 2).alias("total_spent"))


@plan("two_ctes", "J21 J3", """
WITH a AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total_amount FROM orders GROUP BY o_custkey),
     b AS (SELECT o_custkey, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, a.total_amount, b.last_day FROM customer c
LEFT JOIN a ON c.c_custkey = a.o_custkey LEFT JOIN b ON c.c_custkey = b.o_custkey""")
def two_ctes(t: Tables):
    # both blocks group the same rows by the same key: one aggregation serves them
    both = t.orders.groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total_amount"), F.to_date(F.max("o_orderdate")).cast("string").alias("last_day")
    )
    joined = t.customer.join(both, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", "total_amount", "last_day")


@plan("number_series", "J22 AR10", """
WITH RECURSIVE numbers(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM numbers WHERE n < 50)
SELECT CAST(n AS BIGINT) AS n, CAST(count(p_partkey) AS BIGINT) AS n_parts FROM numbers LEFT JOIN part ON p_size = n GROUP BY n""")
def number_series(t: Tables):
    sizes = t.part.groupBy(F.col("p_size").cast("bigint").alias("size")).agg(F.count("*").alias("c"))
    series = t.spark.range(1, 51).select(F.col("id").alias("n"))
    return series.join(sizes, F.col("n") == F.col("size"), "left").select("n", F.coalesce("c", F.lit(0)).alias("n_parts"))


@plan("recursive_series", "J22", """
WITH RECURSIVE numbers(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM numbers WHERE n < 20)
SELECT n, CAST(count(p_partkey) AS BIGINT) AS n_parts FROM numbers LEFT JOIN part ON p_size = n GROUP BY n""")
def recursive_series(t: Tables):
    return t.spark.sql(
        """WITH RECURSIVE numbers(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM numbers WHERE n < 20),
                sizes AS (SELECT p_size, count(*) AS c FROM {part} GROUP BY p_size)
           SELECT n, coalesce(c, 0) AS n_parts FROM numbers LEFT JOIN sizes ON p_size = n""",
        part=t.part,
    )


@plan("date_spine", "J23 D11", """
WITH d AS (SELECT CAST(unnest(generate_series(max(CAST(o_orderdate AS DATE)) - INTERVAL 9 DAY,
                  max(CAST(o_orderdate AS DATE))::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM orders)
SELECT CAST(d.day AS VARCHAR) AS day, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM d
LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d.day GROUP BY d.day""")
def date_spine(t: Tables):
    return ops.date_spine(t.orders, "o_orderdate", 10, "n_orders").withColumn("day", F.col("day").cast("string"))


@plan("same_month_as", "J24 D7 J21", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders
 WHERE strftime(o_orderdate, '%Y-%m') IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_custkey = 5))""")
def same_month_as(t: Tables):
    keys = ops.same_period_keys(t.orders, "o_custkey", "o_orderdate", 5)
    return t.customer.join(keys, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@plan("same_month_number", "J10 D2", """
SELECT DISTINCT o_custkey FROM orders
WHERE month(o_orderdate) IN (SELECT month(o_orderdate) FROM orders WHERE o_custkey = 5)""")
def same_month_number(t: Tables):
    return ops.same_period_keys(t.orders, "o_custkey", "o_orderdate", 5, with_year=False)


@plan("aligned_series", "J25 PF14", """
WITH a AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
     b AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS done_total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey, n_urgent, done_total FROM a JOIN b USING (o_custkey)""")
def aligned_series(t: Tables):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").groupBy("o_custkey").agg(F.count("*").alias("n_urgent"))
    done = t.orders.where(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("done_total")
    )
    return ops.aligned([urgent, done], "o_custkey")
