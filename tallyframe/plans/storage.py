"""Source, sink, catalog and parameterised queries.

Round trips write to fresh paths in the shared folder.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import constraints, group_functions, joins, params
from tallyframe.plans.registry import TABLE_NAMES, Tables, fresh_name, plan
from tallyframe.session import scratch_path
from tallyframe.sources import files, tables

CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@plan("csv_round_trip", "IO2 IO3", "SELECT * FROM customer")
def csv_round_trip(t: Tables):
    path = scratch_path(t.spark, "csv")
    files.write_csv(t.customer, path)
    return files.read_csv(t.spark, path, CUSTOMER_SCHEMA)


@plan("csv_documents", "IO2 IO3", "SELECT doc_id, text, n_chars FROM documents")
def csv_documents(t: Tables):
    """Texts with line breaks, quotes and commas; the columns are read in another order than they are written."""
    path = scratch_path(t.spark, "csv")
    files.write_csv(t.documents, path)
    return files.read_csv(t.spark, path, "n_chars bigint, text string, doc_id bigint")


@plan("csv_ingest", "IO5", """
SELECT c_mktsegment, CAST(2 * count(*) AS BIGINT) AS n_rows FROM customer GROUP BY c_mktsegment""")
def csv_ingest(t: Tables):
    source, target = scratch_path(t.spark, "csv"), scratch_path(t.spark, "ingest")
    files.write_csv(t.customer, source)
    files.ingest_csv(t.spark, source, CUSTOMER_SCHEMA, target, "replace")
    loaded = files.ingest_csv(t.spark, source, CUSTOMER_SCHEMA, target, "append")
    return loaded.groupBy("c_mktsegment").agg(F.count("*").alias("n_rows"))


@plan("text_lines", "IO6 IO7 IO8", """
SELECT line, CAST(count(*) AS BIGINT) AS n FROM
 (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents
  UNION ALL SELECT source FROM documents) GROUP BY line""")
def text_lines(t: Tables):
    first, copy = scratch_path(t.spark, "text"), scratch_path(t.spark, "text")
    files.write_lines(t.documents, "text", first)
    files.write_lines(t.documents, "source", first, mode="append")
    files.copy_lines(t.spark, first, copy)
    return files.read_lines(t.spark, copy).groupBy("line").agg(F.count("*").alias("n"))


@plan("inline_join", "IO9", """
SELECT o_orderkey, m.days FROM orders JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 3), ('3-MEDIUM', 7)) m(priority, days)
  ON o_orderpriority = m.priority""")
def inline_join(t: Tables):
    rows = tables.inline_rows(t.spark, [("1-URGENT", 1), ("2-HIGH", 3), ("3-MEDIUM", 7)], "priority string, days int")
    return t.orders.join(F.broadcast(rows), F.col("o_orderpriority") == F.col("priority")).select("o_orderkey", "days")


@plan("table_create", "IO10", """
SELECT p_type, CAST(count(*) AS BIGINT) AS n_parts FROM part GROUP BY p_type""")
def table_create(t: Tables):
    name = fresh_name("parts")
    created = tables.create_table(t.part.select("p_partkey", "p_type"), name, scratch_path(t.spark, "table"))
    rebuilt = tables.create_table(created.where(F.col("p_partkey").isNotNull()), name, scratch_path(t.spark, "table"))
    counts = rebuilt.groupBy("p_type").agg(F.count("*").alias("n_parts"))
    tables.drop_table(t.spark, name)  # the files stay for the lazy result
    return counts


@plan("snapshot_join", "IO11 J8", """
WITH a AS (SELECT avg(o_totalprice) AS m FROM orders)
SELECT c.* FROM customer c WHERE c_custkey IN (SELECT o_custkey FROM orders, a WHERE o_totalprice > 1.95 * a.m)""")
def snapshot_join(t: Tables):
    bar = 1.95 * t.orders.agg(F.avg("o_totalprice")).scalar()
    keys = t.orders.where(F.col("o_totalprice") > bar).select("o_custkey").distinct()
    snapshot = tables.create_snapshot(keys, fresh_name("customers_above_average"))
    return t.customer.join(snapshot, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@plan("view_latest", "IO12 J1", """
SELECT c.c_name, r.last_day FROM customer c
JOIN (SELECT o_custkey, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day FROM orders GROUP BY o_custkey) r ON c.c_custkey = r.o_custkey""")
def view_latest(t: Tables):
    latest = t.orders.groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).cast("string").alias("last_day"))
    view = tables.create_view(latest, fresh_name("recent_orders"))
    return t.customer.join(view, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "last_day")


@plan("public_view", "IO13", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def public_view(t: Tables):
    return tables.create_view(t.customer, fresh_name("customer_public"), ["c_custkey", "c_name", "c_mktsegment"])


@plan("catalog_counts", "IO14", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, 'SELECT count(*) FROM {n}' AS statement_text, CAST(count(*) AS BIGINT) AS row_count FROM {n}"
    for n in TABLE_NAMES))
def catalog_counts(t: Tables):
    with t.views() as names:
        counts = tables.table_counts(t.spark, names.values())
    short = F.create_map(*[F.lit(x) for pair in names.items() for x in reversed(pair)])
    name = F.element_at(short, F.col("table_name"))
    return counts.select(
        name.alias("table_name"), F.replace("statement_text", F.col("table_name"), name).alias("statement_text"), "row_count"
    )


@plan("catalog_columns", "IO14", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST(row_number() OVER () AS INTEGER) AS position, column_name FROM (DESCRIBE {n})" for n in TABLE_NAMES))
def catalog_columns(t: Tables):
    with t.views() as names:
        listed = tables.table_columns(t.spark, names.values())
    short = F.create_map(*[F.lit(x) for pair in names.items() for x in reversed(pair)])
    return listed.select(F.element_at(short, F.col("table_name")).alias("table_name"), "position", "column_name")


RULES = [
    constraints.primary_key("orders", "o_orderkey"),
    constraints.primary_key("lineitem", "l_orderkey", "l_linenumber"),
    constraints.unique("lineitem", "l_orderkey", "l_partkey"),
    constraints.not_null("customer", "c_name"),
    constraints.foreign_key("orders", ["o_custkey"], "customer", ["c_custkey"]),
    constraints.foreign_key("lineitem", ["l_orderkey"], "orders", ["o_orderkey"], on_delete="CASCADE"),
    constraints.foreign_key("labels", ["doc_id"], "documents", ["doc_id"], on_delete="SET NULL", on_update="NO ACTION"),
    constraints.foreign_key("orders", ["o_custkey"], "supplier", ["s_suppkey"], name="fk_orders_supplier"),
    constraints.check("customer", "c_acctbal >= 0", "ck_customer_acctbal"),
    constraints.check("lineitem", "l_quantity <= 45 OR l_discount < 0.05", "ck_lineitem_quantity"),
]


def _listed(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@plan("constraint_catalog", "IO14 DQ1 DQ2 DQ3 DQ4 DQ5", "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(_listed(v) for v in (r.name, r.table, r.rule, ", ".join(r.columns) or None, r.parent, ", ".join(r.parent_columns) or None,
                                         r.on_delete, r.on_update, r.expression)) + ")" for r in RULES)
    + ") v(constraint_name, table_name, rule, columns, referenced_table, referenced_columns, on_delete, on_update, expression)"
    + " SEMI JOIN (SELECT DISTINCT 'orders' AS t FROM orders UNION ALL SELECT DISTINCT 'lineitem' FROM lineitem UNION ALL SELECT DISTINCT 'customer' FROM customer"
    + " UNION ALL SELECT DISTINCT 'labels' FROM labels) h ON table_name = t")
def constraint_catalog(t: Tables):
    """The declared constraints of the tables that hold rows."""
    held = [getattr(t, n).limit(1).select(F.lit(n).alias("table_name")) for n in sorted({r.table for r in RULES})]
    return constraints.listing(t.spark, RULES).join(reduce(DataFrame.unionByName, held), "table_name", "left_semi")


def _surplus(table: str, key: str) -> str:
    present = " AND ".join(f"{k} IS NOT NULL" for k in key.split(", "))
    return f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {table} WHERE {present} GROUP BY {key})"


def _orphan(table: str, key: str, parent: str, parent_key: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {parent_key} FROM {parent} WHERE {parent_key} IS NOT NULL)"


AUDITS = [
    _surplus("orders", "o_orderkey"),
    _surplus("lineitem", "l_orderkey, l_linenumber"),
    _surplus("lineitem", "l_orderkey, l_partkey"),
    "SELECT count(*) FROM customer WHERE c_name IS NULL",
    _orphan("orders", "o_custkey", "customer", "c_custkey"),
    _orphan("lineitem", "l_orderkey", "orders", "o_orderkey"),
    _orphan("labels", "doc_id", "documents", "doc_id"),
    _orphan("orders", "o_custkey", "supplier", "s_suppkey"),
    "SELECT count(*) FROM customer WHERE NOT c_acctbal >= 0",
    "SELECT count(*) FROM lineitem WHERE NOT (l_quantity <= 45 OR l_discount < 0.05)",
]


@plan("constraint_audit", "IO14 DQ1 DQ2 DQ3 DQ4 DQ5", " UNION ALL ".join(
    f"SELECT '{r.name}' AS constraint_name, '{r.table}' AS table_name, '{r.rule}' AS rule, CAST(({sql}) AS BIGINT) AS violations"
    for r, sql in zip(RULES, AUDITS, strict=True)))
def constraint_audit(t: Tables):
    used = {name for r in RULES for name in (r.table, r.parent) if name}
    return constraints.audit({name: getattr(t, name) for name in used}, RULES)


@plan("param_rows", "P1", """
SELECT o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_custkey = 7""")
def param_rows(t: Tables):
    return t.spark.sql(
        "SELECT o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM {orders} WHERE o_custkey = :cid",
        args={"cid": 7},
        orders=t.orders,
    )


@plan("param_total", "P2", """
SELECT CAST(sum(o_totalprice) AS DECIMAL(10, 2))::DOUBLE AS total FROM orders WHERE o_custkey = 6""")
def param_total(t: Tables):
    return params.total_for(t.orders, "o_custkey", 6, "o_totalprice").select(F.col("total").cast("double"))


@plan("param_table", "P3", "SELECT CAST(count(*) AS BIGINT) AS total_rows FROM customer")
def param_table(t: Tables):
    with t.views("customer") as names:
        return params.count_rows_of(t.spark, names["customer"], names.values())


@plan("grouped_lambda", "P4", """
SELECT o_custkey, CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2002-01-01') AS BIGINT) AS days_since
FROM orders GROUP BY o_custkey""")
def grouped_lambda(t: Tables):
    # the per-group function of the workload is a max and a subtraction: native expressions
    return t.orders.groupBy("o_custkey").agg(
        F.datediff(F.lit("2002-01-01").cast("date"), F.to_date(F.max("o_orderdate"))).cast("bigint").alias("days_since")
    )


@plan("grouped_function", "P4", """
WITH r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS place FROM lineitem)
SELECT l_suppkey, CAST(coalesce(max(place) FILTER (l_quantity >= place), 0) AS BIGINT) AS h_index, CAST(count(*) AS BIGINT) AS n_lines FROM r GROUP BY l_suppkey""")
def grouped_function(t: Tables):
    """Per supplier the largest h such that h lines have a quantity of at least h: a caller's function without a native form."""

    def update(state, rows):
        state.update(rows["l_quantity"].clip(lower=0).astype(int).tolist())
        return state

    def finish(state):
        upto, h = 0, 0
        for quantity in sorted(state, reverse=True):
            upto += state[quantity]
            h = max(h, min(upto, quantity))
        return {"h_index": h, "n_lines": sum(state.values())}

    return group_functions.fold_groups(
        t.lineitem, ["l_suppkey"], ["l_quantity"], Counter, update, lambda a, b: a + b, finish, "h_index bigint, n_lines bigint"
    )
