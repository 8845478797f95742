"""Row-change and constraint-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import audits, rows
from tallyframe.plans.registry import Tables, plan


@plan("add_and_rename", "DM1 DM2", """
SELECT s_suppkey, s_name AS supplier_name, CAST(NULL AS VARCHAR) AS email_id FROM supplier""")
def add_and_rename(t: Tables):
    added = rows.add_column(t.supplier.select("s_suppkey", "s_name"), "email", "string")
    return rows.rename_column(rows.rename_column(added, "email", "email_id"), "s_name", "supplier_name")


@plan("update_where", "DM3 DM1", """
SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size * 2::DOUBLE END AS efficiency FROM part""")
def update_where(t: Tables):
    extended = rows.add_column(t.part.select("p_partkey", "p_size"), "efficiency", "double")
    return rows.update_where(extended, F.col("p_size") > 10, {"efficiency": F.col("p_size") * 2.0}).drop("p_size")


@plan("delete_where", "DM4", """
SELECT o_orderkey, o_totalprice FROM orders WHERE NOT coalesce(nullif(o_totalprice, o_totalprice) > 1 OR o_totalprice < 200000, false)""")
def delete_where(t: Tables):
    unknown = F.lit(None).cast("boolean")
    kept = rows.delete_where(t.orders, unknown | (F.col("o_totalprice") < 200000))
    return kept.select("o_orderkey", "o_totalprice")


@plan("append_rows", "DM5 DM6", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'new york' AS city FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, 'new york' FROM supplier""")
def append_rows(t: Tables):
    people = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    more = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return rows.with_default(rows.append_rows(people, more), "city", "new york")


@plan("surrogate_id", "DM7", """
SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS BIGINT) AS id FROM orders""")
def surrogate_id(t: Tables):
    return rows.surrogate_id(t.orders.select("o_orderkey", "o_orderpriority"), [F.col("o_orderpriority"), F.col("o_orderkey")])


@plan("null_violations", "DQ1", """
SELECT c.c_custkey, c.c_name, t.total FROM customer c LEFT JOIN
 (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) t
  ON c_custkey = o_custkey WHERE t.total IS NULL OR c.c_name IS NULL""")
def null_violations(t: Tables):
    totals = t.orders.where(F.col("o_orderpriority") == "1-URGENT").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    joined = t.customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "total")
    return audits.null_rows(joined, ["total", "c_name"])


@plan("unique_violations", "DQ2", """
SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS copies FROM events
GROUP BY ALL HAVING count(*) > 1""")
def unique_violations(t: Tables):
    keyed = t.events.select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    return audits.duplicate_keys(keyed, ["user_id", "event_type", "day"])


@plan("pk_violations", "DQ3", """
SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS copies, 'duplicate key' AS rule FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def pk_violations(t: Tables):
    return audits.primary_key_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@plan("fk_orphans", "DQ4", """
SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS
 (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)""")
def fk_orphans(t: Tables):
    solvent = t.customer.where(F.col("c_acctbal") > 0)
    return audits.orphans(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", solvent, "c_custkey")


@plan("check_violations", "DQ5", """
SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT (s_acctbal >= 0)""")
def check_violations(t: Tables):
    return audits.check_violations(t.supplier.select("s_suppkey", "s_acctbal"), F.col("s_acctbal") >= 0)


@plan("restrict_deletes", "DQ6", """
SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AS blocked FROM part""")
def restrict_deletes(t: Tables):
    return audits.restrict_deletes(t.part, "p_partkey", t.lineitem.where(F.col("l_quantity") > 48), "l_partkey")


@plan("cascade_remap", "DQ7", """
SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer""")
def cascade_remap(t: Tables):
    moved = t.nation.where(F.col("n_nationkey") < 5).select(
        F.col("n_nationkey").alias("old_key"), (F.col("n_nationkey") + 100).alias("new_key")
    )
    return audits.cascade_keys(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", moved)
